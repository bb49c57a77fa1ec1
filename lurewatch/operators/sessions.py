"""Session rules over the activity log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.operators import steps
from lurewatch.operators.prefix import running_sum
from lurewatch.operators.spacing import DAY, mark_accepted

HOUR = 3_600
REQUEST, LOGIN, ADMIN_LOGIN, LOGOUT = range(4)
#: Expiry of an account without a session.
NO_SESSION = -steps.EVERY


def sliding_sessions(df: DataFrame, user: str = "user_id", when: str = "timestamp",
                     gap: int = DAY) -> DataFrame:
    """Sessions whose expiry slides ``gap`` seconds past every request.

    Requests of one hour always share a session, so they are combined before the window; a user
    then has at most one row per hour.
    """
    hour = F.floor(F.unix_seconds(when) / min(HOUR, gap))
    spans = df.groupBy(user, hour.alias("hour")).agg(
        F.min(when).alias("lo"), F.max(when).alias("hi"), F.count("*").alias("n"))
    along = Window.partitionBy(user).orderBy("hour")
    silent = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(along)) > gap * 1_000_000
    flagged = spans.withColumn("new", F.when(silent | F.lag("hi").over(along).isNull(), 1).otherwise(0))
    numbered = flagged.withColumn("session", F.sum("new").over(along))
    return numbered.groupBy(user, "session").agg(
        F.min("lo").alias("started"), F.max("hi").alias("last_request"),
        F.sum("n").alias("requests")).withColumn(
        "expires", F.col("last_request") + F.make_dt_interval(secs=F.lit(gap)))


def single_session(df: DataFrame, user: str = "user_id", when: str = "timestamp",
                   row_id: str = "id", lifetime: int = DAY) -> DataFrame:
    """Add ``outcome``: a login is refused while a session lives, unless the user is an admin.

    A logout always frees the account, so the logins between two logouts stand alone: the first is
    accepted, later ones only a lifetime after the last accepted one.
    """
    seconds = F.unix_seconds(when)
    counted = running_sum(df, [user], F.floor(seconds / DAY), [seconds, F.col(row_id)],
                          {"logouts": F.when(F.col("action") == "logout", 1).otherwise(0)})
    logins = counted.filter((F.col("action") == "login") & ~F.col("is_admin")).select(
        row_id, user, when, "logouts")
    judged = mark_accepted(logins, [user, "logouts"], when, row_id, lifetime).select(
        row_id, "accepted")
    return df.join(judged, row_id, "left").withColumn(
        "outcome", F.when(F.col("action") == "logout", F.lit("logout"))
        .when(F.coalesce("accepted", F.lit(True)), F.lit("accepted"))
        .otherwise(F.lit("refused"))).drop("accepted")


def kind_of() -> Column:
    """Number of an account event's kind, from ``action`` and ``is_admin``."""
    login = F.when(F.coalesce("is_admin", F.lit(False)), ADMIN_LOGIN).otherwise(LOGIN)
    return (F.when(F.col("action") == "login", login).when(F.col("action") == "logout", LOGOUT)
            .otherwise(REQUEST))


def _effect(kind: int, first: int, last: int, logins: np.ndarray, lifetime: int):
    """What a run of events of one kind does to the expiry."""
    if kind == REQUEST:
        return np.array([first - 1, steps.EVERY]), np.array([NO_SESSION, last + lifetime])
    if kind == LOGIN:
        return logins, logins + lifetime
    return np.array([steps.EVERY]), np.array([NO_SESSION if kind == LOGOUT else last + lifetime])


def _run_udfs(lifetime: int, chunk: int):
    """Summary of a chunk's runs, and the expiry in which each of its runs is entered."""
    def effects(runs):
        for r in runs:
            yield r, _effect(r["kind"], r["first"], r["last"], np.asarray(r["logins"], np.int64), lifetime)

    @F.pandas_udf(steps.FUNCTION)
    def summary(cells: pd.Series) -> pd.DataFrame:
        heads, nexts = [], []
        for runs in cells:
            f = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for _, effect in effects(runs):
                f = steps.then(*f, *effect)
            f = steps.within(*f, runs[0]["first"] // chunk * chunk + lifetime)
            heads.append(f[0].tolist())
            nexts.append(f[1].tolist())
        return pd.DataFrame({"heads": heads, "nexts": nexts})

    @F.pandas_udf("array<struct<cell:bigint,run:bigint,first:bigint,expiry:bigint>>")
    def entered(cells: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for runs, expiry in zip(cells, entry):
            found = []
            for r, effect in effects(runs):
                found.append({"cell": r["cell"], "run": r["run"], "first": r["first"], "expiry": int(expiry)})
                expiry = steps.value(*effect, int(expiry))
            out.append(found)
        return pd.Series(out)

    return summary, entered


def account_outcomes(df: DataFrame, user: str = "user_id", when: str = "timestamp", row_id: str = "id",
                     lifetime: int = DAY) -> DataFrame:
    """Add ``outcome`` to logins, logouts and requests (any other action), in order of (second, id).

    A session ends ``lifetime`` seconds after its login or its last valid request. A login is refused
    while a session lives (before its expiry), unless the user is an admin; a request is valid up to the
    expiry and then moves it; a logout frees the account. Outcomes: accepted, refused, valid, invalid,
    logout. A row without user or time stands alone: no session lives.

    Neighbouring events of one kind are reduced to a run per hour, with the different seconds of its
    logins; a day of runs is summarised as a step function of the expiry, and these are combined in a
    tree. So a hot account is cut at hours for its rows and at days for its runs.
    """
    sec, length = F.unix_seconds(when), min(HOUR, lifetime)
    per_chunk = -(-max(DAY, lifetime) // length)
    chunk = per_chunk * length
    summary, entered = _run_udfs(lifetime, chunk)
    along = Window.partitionBy(user, "_cell").orderBy("_sec", row_id)
    placed = df.withColumns({"_sec": sec, "_kind": kind_of(), "_cell": F.floor(sec / length)})
    known = placed.filter(F.col(user).isNotNull() & F.col("_sec").isNotNull())
    same = F.lag("_kind").over(along).eqNullSafe(F.col("_kind"))
    marked = known.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn(
        "_before", F.when(F.col("_new") == 0, F.lag("_sec").over(along))).withColumn(
        "_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(user, "_cell", "_run").agg(
        F.min("_kind").alias("kind"), F.min("_sec").alias("first"), F.max("_sec").alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("_kind") == LOGIN, F.col("_sec")))).alias("logins"))
    chunks = runs.groupBy(user, F.floor(F.col("_cell") / per_chunk).alias("place")).agg(F.array_sort(
        F.collect_list(F.struct(F.col("_cell").alias("cell"), F.col("_run").alias("run"), "kind", "first",
                                "last", "logins"))).alias("runs"))
    functions = chunks.select(user, "place", summary("runs").alias("f"), (
        F.col("place") * chunk + lifetime).alias("most")).select(user, "place", "most", "f.heads", "f.nexts")
    ends = df.agg(F.min(sec).alias("lo"), F.max(sec).alias("hi")).first()
    entries = steps.entries(functions, [user], NO_SESSION, (ends.lo or 0) // chunk, (ends.hi or 0) // chunk)
    judged = chunks.join(entries, [user, "place"]).select(user, F.explode(entered("runs", "entry")).alias(
        "o")).select(user, F.col("o.cell").alias("_cell"), F.col("o.run").alias("_run"),
                     F.col("o.first").alias("_first"), F.col("o.expiry").alias("_expiry"))
    alone = placed.filter(F.col(user).isNull() | F.col("_sec").isNull()).select(
        *df.columns, "_kind", "_sec", F.lit(None).cast("bigint").alias("_before"), "_sec",
        F.lit(NO_SESSION).alias("_expiry"))
    told = marked.join(judged, [user, "_cell", "_run"]).select(
        *df.columns, "_kind", "_sec", "_before", "_first", "_expiry").union(alone)
    opens = (F.col("_sec") >= F.col("_expiry")) & F.coalesce(F.col("_before") < F.col("_expiry"), F.lit(True))
    outcome = (F.when(F.col("_kind") == LOGOUT, "logout").when(F.col("_kind") == ADMIN_LOGIN, "accepted")
               .when(F.col("_kind") == LOGIN, F.when(F.coalesce(opens, F.lit(True)), "accepted").otherwise("refused"))
               .when(F.coalesce(F.col("_first") <= F.col("_expiry"), F.lit(False)), "valid").otherwise("invalid"))
    return told.select(*df.columns, outcome.alias("outcome"))
