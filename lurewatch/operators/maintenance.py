"""Table rewrites that stand in for UPDATE and DELETE."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expire_sessions(users: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Null out token and expiry of sessions that ended before ``as_of``."""
    live = F.coalesce(F.col("session_expiry") >= F.lit(as_of), F.lit(True))
    return users.withColumns({
        "session_token": F.when(live, F.col("session_token")),
        "session_expiry": F.when(live, F.col("session_expiry"))})


def rewrite_value(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.replace(old, new, subset=[column])


def drop_users(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows not owned by a user to delete; rows without an owner stay."""
    return df.join(doomed.select(F.col("id").alias("_id")).distinct(),
                   F.col(key) == F.col("_id"), "left_anti")


def user_status(users: DataFrame) -> DataFrame:
    return users.select(
        "id", "username", "email", "is_admin",
        F.when(F.col("session_token").isNotNull(), F.lit("Online"))
        .otherwise(F.lit("Offline")).alias("status"))
