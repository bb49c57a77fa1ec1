"""The current row of each key, stored in hash buckets that are replaced one by one.

``put`` merges arriving rows into the buckets of their keys and rewrites those alone; ``get`` reads the
buckets of the keys that are asked for. So the cost of an arrival or of a look-up follows its own keys, not
the table. A repeated ``put`` changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, BUCKET = 64, "bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _in(buckets: list[int]) -> Column:
    return F.col(BUCKET).isin(buckets) if buckets else F.lit(False)


def _touched(rows: DataFrame) -> list[int]:
    """Bucket numbers of rows: at most as many as there are buckets."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def put(rows: DataFrame, path: str, keys: list[str], newest: list[str], buckets: int = BUCKETS) -> None:
    """Keep of every key the row that is greatest in ``newest``; rows with a null key are not kept.

    ``buckets`` must stay the same for a path. Rows are thinned out by a partial aggregate, so a key
    that arrives very often does not fill a task.
    """
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    arrived = rows.withColumn(BUCKET, _bucket(keys, buckets)).persist()
    touched, old = _touched(arrived), _stored(rows.sparkSession, path)
    every = arrived if old is None else arrived.unionByName(old.filter(_in(touched)).select(*arrived.columns))
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    kept = every.groupBy(BUCKET, *keys).agg(F.max_by(rest, F.struct(*newest)).alias("row"))
    kept.select(*keys, "row.*", BUCKET).repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    arrived.unpersist()


def get(path: str, asked: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The current rows of the buckets that hold the keys of ``asked`` (columns named as ``keys``)."""
    for k in keys:
        asked = asked.filter(F.col(k).isNotNull())
    wanted = _touched(asked.select(_bucket(keys, buckets).alias(BUCKET)))
    return asked.sparkSession.read.parquet(path).filter(_in(wanted)).drop(BUCKET)
