"""Account sessions and sliding sessions: tables and streams against a walk over every event."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.operators import sessions, steps
from lurewatch.streaming import runner
from lurewatch.streaming import sessions as stream_sessions

T0 = dt.datetime(2024, 1, 1)
EVENT = "id bigint, user_id bigint, is_admin boolean, action string, timestamp timestamp"
DAY = 86_400


def walk(rows, lifetime):
    expiry, out = {}, {}
    for i, user, admin, action, t in sorted(rows, key=lambda r: (r[4] is None, r[4] and int((r[4] - T0).total_seconds()), r[0])):
        live = None if user is None or t is None else expiry.get(user)
        sec = None if t is None else int((t - T0).total_seconds())
        if action == "logout":
            out[i], new = "logout", None
        elif action == "login":
            out[i] = "accepted" if admin or live is None or sec >= live else "refused"
            new = sec + lifetime if sec is not None and out[i] == "accepted" else live
        else:
            out[i] = "valid" if live is not None and sec <= live else "invalid"
            new = sec + lifetime if out[i] == "valid" else live
        if user is not None and t is not None:
            expiry[user] = new
    return out


def some(seed, n, spread, users=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = rng.choices(["login", "request", "logout"], (4, 6, rng.choice([0.2, 1.5])))[0]
        user = rng.randrange(users)
        rows.append((i, user, user == 3 or (user == 2 and rng.random() < 0.2), action,
                     T0 + dt.timedelta(seconds=rng.randrange(spread), milliseconds=rng.randrange(1000))))
    return rows


@pytest.mark.parametrize("lifetime, spread, n", [(DAY, 40 * DAY, 400), (DAY, 3 * DAY, 900), (600, 8000, 700),
                                                 (7, 500, 800), (5 * DAY, 90 * DAY, 300), (DAY, 900 * DAY, 1200)])
def test_outcomes_equal_a_walk(spark, lifetime, spread, n):
    rows = some(lifetime + n, n, spread) + [(10_000, None, False, "login", T0), (10_001, None, False, "request", T0),
                                            (10_002, 1, False, "request", None), (10_003, 1, None, "logout", None)]
    df = spark.createDataFrame(rows, EVENT).repartition(5)
    got = {r["id"]: r["outcome"] for r in sessions.account_outcomes(df, lifetime=lifetime).collect()}
    assert got == walk(rows, lifetime)


def test_hot_account_and_limits(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    # A request at the expiry is valid, a login at the expiry is accepted, both one second on are not.
    rows = [(1, 1, False, "login", at(0)), (2, 1, False, "request", at(DAY)), (3, 1, False, "login", at(2 * DAY)),
            (4, 1, False, "request", at(3 * DAY + 1)), (5, 1, False, "login", at(3 * DAY + 1)),
            (6, 1, False, "login", at(3 * DAY + 1))]
    rows += [(100 + i, 2, False, "login", at(i)) for i in range(0, 4000)]
    df = spark.createDataFrame(rows, EVENT)
    got = {r["id"]: r["outcome"] for r in sessions.account_outcomes(df).collect()}
    assert got == walk(rows, DAY)
    assert [got[i] for i in range(1, 7)] == ["accepted", "valid", "accepted", "invalid", "accepted", "refused"]
    assert sessions.account_outcomes(df.where("false")).count() == 0


def test_steps_compose():
    rng = np.random.default_rng(3)
    for _ in range(300):
        fs = []
        for _ in range(rng.integers(1, 6)):
            heads = np.unique(rng.integers(0, 40, rng.integers(0, 6)))
            fs.append((heads, rng.integers(0, 60, len(heads))))
        whole = fs[0]
        for f in fs[1:]:
            whole = steps.then(*whole, *f)
        for state in range(-2, 62):
            want = state
            for f in fs:
                want = steps.value(*f, want)
            assert steps.value(*whole, state) == want
            assert state > 25 or steps.value(*steps.within(*whole, 25), state) == want


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_tree_equals_a_chain(spark, fan):
    rng = random.Random(fan)
    rows = []
    for key in range(3):
        for place in sorted(rng.sample(range(-40, 60), 30)):
            heads = sorted(rng.sample(range(100), rng.randrange(5)))
            rows.append((key, place, heads, [rng.randrange(120) for _ in heads], 10 ** 6))
    df = spark.createDataFrame(rows, "key int, place bigint, heads array<bigint>, nexts array<bigint>, most bigint")
    got = sorted(map(tuple, steps.entries(df, ["key"], 5, -40, 59, fan).select("key", "place", "entry").collect()))
    want, state = [], {}
    for key, place, heads, nexts, _ in rows:
        want.append((key, place, state.get(key, 5)))
        state[key] = steps.value(np.array(heads, np.int64), np.array(nexts, np.int64), state.get(key, 5))
    assert got == sorted(want)


def deliver(spark, tmp_path, parts, schema, judge):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        runner.drain(judge(stream), runner.to_folder(out), state, "update")
    return spark.read.parquet(out)


def test_account_stream(spark, tmp_path):
    rows = sorted(some(8, 300, 20 * DAY), key=lambda r: r[4])
    rows += [(10_000, None, False, "login", T0 + dt.timedelta(days=30)), (10_001, None, False, "view", rows[-1][4])]
    parts = [rows[:90], rows[90:200], rows[200:]]
    told = deliver(spark, tmp_path, parts, EVENT, lambda s: stream_sessions.account_outcomes(s, delay="1 second"))
    assert {r["id"]: r["outcome"] for r in told.collect()} == walk(rows, DAY)


def state_rows(spark, tmp_path, name, column):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state")).select(
        F.col("key.*"), "value.*").collect()


def test_idle_accounts_leave_the_state(spark, tmp_path):
    at = lambda d: T0 + dt.timedelta(days=d)
    parts = [[(u, u, False, "login", at(0)) for u in range(5)], [(10, 9, False, "login", at(5))],
             [(11, 9, False, "request", at(5.5))]]
    deliver(spark, tmp_path, parts, EVENT, lambda s: stream_sessions.account_outcomes(s, delay="1 hour"))
    assert [r[0] for r in state_rows(spark, tmp_path, "expiry", "expiry")] == [9]


def test_sliding_stream(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    # Sessions that go on over deliveries, are open at the end, meet exactly at the gap, or are joined
    # by a late request.
    parts = [[(1, at(0)), (1, at(20)), (2, at(5)), (4, at(0)), (4, at(40))], [(1, at(44)), (2, at(70)), (3, at(71)), (4, at(20))],
             [(2, at(60)), (2, at(80)), (3, at(96)), (3, at(72))], [(5, at(300))], [(5, at(324))]]
    told = deliver(spark, tmp_path, parts, "user_id bigint, ts timestamp",
                   lambda s: stream_sessions.sliding_sessions(s, "user_id", "ts", delay="2 days"))
    columns = ["user_id", "started", "last_request", "requests", "expires"]
    got = sorted(map(tuple, stream_sessions.newest(told).select(*columns).collect()))
    every = spark.createDataFrame(sum(parts, []), "user_id bigint, ts timestamp")
    want = sorted(map(tuple, sessions.sliding_sessions(every, "user_id", "ts").select(*columns).collect()))
    assert got == want
    # A batch writes what it changed, and ended sessions leave the state.
    per_batch = [r["count"] for r in told.groupBy("batch").count().orderBy("batch").collect()]
    assert per_batch[:2] == [4, 5] and per_batch[-1] == 1
    assert {r[0] for r in state_rows(spark, tmp_path, "sessions", "first")} == {5}
