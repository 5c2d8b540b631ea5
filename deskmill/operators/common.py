"""Shared relational pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last delivery of each key. The rank is limited before the shuffle, so a hot key sends one row a task."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def numbered(df: DataFrame, key: str, at: str, tie: str, name: str = "turn") -> DataFrame:
    """Position (from 1) of each row within its key, by time and then ``tie``.

    Ranked in two levels, inside a key's months and then by the months' counts, so that one key with a large share of
    all rows is spread over many tasks.
    """
    month = F.coalesce(F.date_trunc("month", at), F.lit("1900-01-01").cast("timestamp"))
    rows = df.withColumn("_month", month)
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_month").orderBy(F.col(at), tie)))
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_month").alias("_m")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = rows.join(before, rows[key].eqNullSafe(before["_key"]) & (rows["_month"] == before["_m"]))
    return out.withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_month", "_in", "_key", "_m", "_before")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; the limit is applied in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= k)
