"""Per-key results when a few keys hold most records, by value-frequency compression.

Rows are first grouped by (key, value) and counted. That step has no hot group besides repeats of one pair, which the
partial aggregation folds before the shuffle. Afterwards a key has one weighted row per distinct value, and rows,
distinct counts, modes and percentiles are aggregates of weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.runtime import cut, rows_of


def compress(df: DataFrame, keys: list[str], value: str, latest: str | None = None) -> DataFrame:
    """(keys..., value, weight[, latest]): one row per distinct key and value with its number of rows.

    Null keys and null values form groups of their own, as in any GROUP BY.
    """
    extra = [F.max(latest).alias(latest)] if latest else []
    return df.groupBy(*keys, value).agg(F.count("*").alias("weight"), *extra)


def both_sides(edges: DataFrame, source: str = "from_user_id", target: str = "to_user_id", seen: str = "last_seen_at") -> DataFrame:
    """Per user and side: rows, distinct partners and latest ``seen``; side is 'from' or 'to'.

    One compression by (source, target) serves both sides: its rows are turned into a row for either side and folded
    per user, partially before the second shuffle. Null users are no users and left out (their partners still count
    them as rows, not as distinct partners); a null ``seen`` is older than any other.
    """
    pairs = compress(edges.select(source, target, seen), [source], target, seen)
    sides = pairs.select(
        F.inline(F.array(
            F.struct(F.lit("from").alias("side"), F.col(source).alias("user_id"), F.col(target).alias("partner"), F.col("weight").alias("w"), F.col(seen).alias("s")),
            F.struct(F.lit("to").alias("side"), F.col(target).alias("user_id"), F.col(source).alias("partner"), F.col("weight").alias("w"), F.col(seen).alias("s")),
        ))
    ).where("user_id is not null")
    return sides.groupBy("side", "user_id").agg(F.sum("w").alias("rows"), F.count("partner").alias("partners"), F.max("s").alias("latest_seen_at"))


def heavy(per_user: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """The users of ``both_sides`` that stand in at least ``share`` of ``total`` rows: at most 1 / share a side."""
    return per_user.where(F.col("rows") >= F.lit(share) * F.lit(total))


def heavy_users(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(side, user_id) of the users in at least ``share`` of all rows of ``edges`` as delivered, repeats included."""
    return heavy(both_sides(edges), rows_of(edges), share).select("side", "user_id")


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode, mode_rows): the most frequent non-null value of each key; of equally frequent ones the smallest."""
    counted = compress(df.where(F.col(value).isNotNull()), [key], value)
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v")))
    return counted.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias("mode"), (-F.col("b.w")).alias("mode_rows"))


def percentiles(df: DataFrame, key: str, value: str, share: float | Column = 0.5) -> DataFrame:
    """(key, percentile, rows): the smallest value with at least ``share`` of the key's non-null rows at or below it.

    Exact for keys of any size: the weighted values are range-partitioned by (key, value), so that a hot key spans many
    partitions; each partition sums its weights per key, the sums of earlier partitions (a row per key and partition)
    become offsets, and running sums inside the partitions then are running sums of the whole key.
    """
    counted = compress(df.where(F.col(value).isNotNull()), [key], value).select(F.col(key).alias("k"), F.col(value).alias("v"), "weight")
    placed = cut(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("k", "part").agg(F.sum("weight").alias("w"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("k")
    offsets = sums.select(F.col("k").alias("ok"), F.col("part").alias("opart"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"), F.sum("w").over(whole).alias("rows"))
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("cum", F.sum("weight").over(inside))
    joined = running.join(offsets, F.col("k").eqNullSafe(F.col("ok")) & (F.col("part") == F.col("opart")))
    hit = joined.where(F.col("cum") + F.col("offset") >= F.lit(share) * F.col("rows"))
    return hit.groupBy(F.col("k").alias(key)).agg(F.min("v").alias("percentile"), F.max("rows").alias("rows"))
