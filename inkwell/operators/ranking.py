"""Usage statistics as ranking signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE, HEAT, FRESH = 30.0, 0.7, 0.3


def hit_counters(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits(query_id, keys, ts): one hit per query and key; count, first and last time."""
    once = hits.groupBy("query_id", *keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("hit_count"), F.min("_a").alias("created_at"), F.max("_b").alias("last_hit_at"))


def decayed(count: Column, at: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86400e6
    return count * F.exp(-0.693 * days / HALF_LIFE)


def importance(hits: Column, last: Column, created: Column, as_of: Column) -> Column:
    return F.round(HEAT * decayed(hits, last, as_of) + FRESH * decayed(F.lit(1), created, as_of), 4)


def importance_multiplier(rows: DataFrame, by: list[str], raw: str, low: float = 0.1, high: float = 2.0) -> DataFrame:
    """Adds multiplier: a sigmoid of the distance from the median in quartile ranges, per group.

    Quartiles are values at n/4 and 3n/4 of the sorted list (its ends below four rows); no spread gives 1.
    """
    w = Window.partitionBy(*by)
    v = F.coalesce(F.col(raw), F.lit(0.0))
    ranked = rows.withColumn("_v", v).withColumn("_i", F.row_number().over(w.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v"))).over(w)
    n = F.col("_n")
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    q1, q3 = at(F.when(n >= 4, F.floor(n / 4)).otherwise(0)), at(F.when(n >= 4, F.floor(3 * n / 4)).otherwise(n - 1))
    out = ranked.withColumn("_m", median).withColumn("_r", q3 - q1)
    value = F.when(F.col("_r") <= 1e-9, 1.0).otherwise(low + (high - low) / (1 + F.exp(-(F.col("_v") - F.col("_m")) / F.col("_r"))))
    return out.withColumn("multiplier", F.round(value, 4)).drop("_v", "_i", "_n", "_m", "_r")
