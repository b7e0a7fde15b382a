"""Operators of the measurement side: retention, drift, pivots, trends, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retained(executions: DataFrame, quota: int) -> DataFrame:
    """Executions with `evicted`: all but the newest `quota` by (created_at_ms, execution_id) leave tombstones."""
    newest = executions.orderBy(F.desc("created_at_ms"), F.desc("execution_id")).limit(quota).select("execution_id", F.lit(False).alias("evicted"))
    return executions.join(newest, "execution_id", "left").withColumn("evicted", F.coalesce("evicted", F.lit(True)))


def drift(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, warn: float, fail: float) -> DataFrame:
    """Current values against a baseline: percent delta and severity; rows without a baseline are `new`."""
    joined = current.join(baseline.select(*keys, F.col(value).alias("baseline")), keys, "left")
    delta = (F.col(value) - F.col("baseline")) / F.col("baseline") * 100
    return joined.withColumn("delta_percent", delta).withColumn("severity", F.when(F.col("baseline").isNull(), "new").when(
        F.abs(delta) >= fail, "fail").when(F.abs(delta) >= warn, "warn").otherwise("pass"))


def matrix(rows: DataFrame, keys: list[str], column: str, value: str, names: list) -> DataFrame:
    """One row per keys, one column per name."""
    return rows.groupBy(*keys).pivot(column, names).agg(F.first(value))


def trend(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each key's latest point with the one before it and the change."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = points.withColumn("prior", F.lag(value).over(w)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at))))
    return rows.where("rank = 1").withColumn("change", F.col(value) - F.col("prior")).drop("rank")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """Per keys the value at position round((n - 1) * fraction) of its sorted group, halves rounded up.

    A group is sorted, not gathered: how many rows have smaller values is counted per distinct value first.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    placed = counts.withColumn("_until", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    rank = F.floor((F.col("_all") - 1) * fraction + 0.5)
    return placed.where((F.col("_until") > rank) & (F.col("_until") - F.col("_n") <= rank)).select(*keys, F.col(value).alias(name))
