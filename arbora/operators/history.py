"""History of changing entity attributes as type-two dimension rows.

``merge_versions`` is the dimension merge: the attribute hashes of open versions are compared with those of a delivery, changed
rows are closed and new ones opened. ``history`` builds a whole dimension that way, merging the observations of one period
after the other. ``versions`` gives the same from all observations at once, without a merge.

The order of a key's observations is needed, but a hot key must not be sorted in one task. Observations are spread by
ranges of (key, instant), which cut a hot key into pieces however its instants lie; what crosses pieces, the last value
before and the next version start after, is found on one summary row per key and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.runtime import cut, release

#: Periods into which ``history`` cuts the time from the first observation to the last.
PERIODS = 4


def iso_instant(text: Column) -> Column:
    """Epoch microseconds of ISO-8601 text: T or blank between date and time, any fraction, Z, an offset or none (UTC).

    Null, blank and unreadable text give null.
    """
    plain = F.regexp_replace(F.trim(text), r"^(\d{4}-\d\d-\d\d)[Tt ]", "$1T")
    zoned = F.when(plain.rlike(r"([Zz]|[+-]\d\d(:?\d\d)?)$") & plain.contains("T"), plain).otherwise(F.concat(plain, F.lit("Z")))
    zoned = F.regexp_replace(F.regexp_replace(F.upper(zoned), r"([+-]\d\d)$", "$1:00"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.unix_micros(F.try_to_timestamp(zoned))


def attribute_hash(attributes: list[str]) -> Column:
    """64-bit hash of the attributes in order; a null differs from every value and from a null in another place.

    Two different versions in a row have equal hashes once in 2^64 times.
    """
    return F.xxhash64(*[x for a in attributes for x in (F.col(a).isNull(), F.col(a))])


def _spread(observations: DataFrame, key: str, instant: Column, attributes: list[str], latest: list[str]) -> DataFrame:
    """(k, at, a0.., l0.., b): observations with key and instant, in pieces b that hold ranges of (k, at)."""
    rows = observations.select(F.col(key).alias("k"), instant.alias("at"), *[F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)], *[F.col(c).alias(f"l{i}") for i, c in enumerate(latest)])
    # Cut twice: the text is read once though ranges are found by sampling, and every reader sees the same ranges.
    read = cut(rows.where("k is not null and at is not null"))
    placed = cut(read.repartitionByRange("k", "at").withColumn("b", F.spark_partition_id()))
    release(read)
    return placed


def _starts(placed: DataFrame, attributes: int, latest: int) -> DataFrame:
    """(k, p, at, a0.., h, next): where the values of a key change within a period p, and the next such instant there.

    Of rows with the same key and instant the one with the largest ``latest`` columns counts (null is smallest), then the
    largest attributes. ``next`` is null for the last in its period.
    """
    names = [f"a{i}" for i in range(attributes)]
    piece = Window.partitionBy("k", "p", "b")
    inside, whole = piece.orderBy("at"), Window.partitionBy("k", "p").orderBy("b")
    ranked = piece.orderBy("at", *[F.asc_nulls_first(c) for c in [f"l{i}" for i in range(latest)] + names])
    # Ranges keep rows of one key and instant together.
    one = placed.withColumn("then", F.lead("at").over(ranked)).where("then is null or then <> at").select("k", "p", "b", "at", *names, attribute_hash(names).alias("h"))
    lagged = one.withColumns({"before": F.lag("h").over(inside), "ordinal": F.row_number().over(inside)})
    ends = one.groupBy("k", "p", "b").agg(F.max_by("h", "at").alias("last"))
    ends = ends.select(F.col("k").alias("ek"), F.col("p").alias("ep"), F.col("b").alias("eb"), F.lag("last").over(Window.partitionBy("k", "p").orderBy("b")).alias("carried"))
    same = (F.col("k") == F.col("ek")) & (F.col("p") == F.col("ep")) & (F.col("b") == F.col("eb"))
    previous = F.when(F.col("ordinal") == 1, F.col("carried")).otherwise(F.col("before"))
    changed = cut(lagged.join(ends, same).where(previous.isNull() | (previous != F.col("h"))).select("k", "p", "b", "at", *names, "h"))
    heads = changed.groupBy("k", "p", "b").agg(F.min("at").alias("head"))
    heads = heads.select(F.col("k").alias("ek"), F.col("p").alias("ep"), F.col("b").alias("eb"), F.lead("head").over(whole).alias("later"))
    return changed.withColumn("next", F.lead("at").over(inside)).join(heads, same).select("k", "p", "at", *names, "h", F.coalesce("next", "later").alias("next"))


def versions(observations: DataFrame, key: str, instant: Column, attributes: list[str], latest: list[str]) -> DataFrame:
    """(key, attributes..., valid_from, valid_to): every version with its period in epoch microseconds.

    Rows with a null key or instant are left out. Of rows with the same key and instant the one with the largest
    ``latest`` columns counts (null is smallest), then the largest attributes. A version begins where the attributes
    differ from the observation before, null equal to null; valid_to is the next version's begin, null for the last.
    """
    placed = _spread(observations, key, instant, attributes, latest).withColumn("p", F.lit(0))
    return _named(_starts(placed, len(attributes), len(latest)), key, attributes)


def _named(starts: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    return starts.select(F.col("k").alias(key), *[F.col(f"a{i}").alias(a) for i, a in enumerate(attributes)], F.col("at").alias("valid_from"), F.col("next").alias("valid_to"))


def history(observations: DataFrame, key: str, instant: Column, attributes: list[str], latest: list[str], periods: int = PERIODS) -> DataFrame:
    """The same as ``versions``, by merging one period after the other into the dimension.

    Each period's observations become versions of their own, and ``merge_versions`` compares the first of every key with the
    key's open version. Closed versions are written once and not read again.
    """
    placed = _spread(observations, key, instant, attributes, latest)
    span = placed.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    width = 0 if span.lo is None else (span.hi - span.lo) // periods + 1
    period = F.floor((F.col("at") - F.lit(span.lo)) / F.lit(width)).cast("int") if width else F.lit(0)
    starts = _named(_starts(placed.withColumn("p", period), len(attributes), len(latest)), key, attributes)
    tagged = F.floor((F.col("valid_from") - F.lit(span.lo)) / F.lit(width)).cast("int") if width else F.lit(0)
    starts = cut(starts.withColumn("_period", tagged), by="_period")
    release(placed)
    done, current = [], None
    for p in range(periods if width else 1):
        batch = starts.where(F.col("_period") == p).drop("_period")
        merged = cut(batch if current is None else merge_versions(current, batch, key, attributes))
        done.append(merged.where("valid_to is not null"))
        current = merged.where("valid_to is null")
    out = current
    for part in done:
        out = out.unionByName(part)
    return out


def merge_versions(history: DataFrame, batch: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """The history after one more delivery: versions (key, attributes..., valid_from, valid_to) of a period later than
    every begin in ``history``; a snapshot is a delivery of one version per key.

    The attribute hash of each key's open version is compared with that of its first version in the batch. Where they
    differ, the open version is closed at that version's begin; where they agree, it goes on to that version's end.
    The other versions of the batch are new rows. Keys that are not in the batch stay. Batch rows with a null key are
    left out, repeated rows count once. Only open versions take part in the join.
    """
    values = [key, *attributes, "valid_from", "valid_to"]
    rows = batch.where(F.col(key).isNotNull()).select(*values).distinct()
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min("valid_from").alias("_first"))
    headed = rows.join(first, F.col(key) == F.col("_k")).withColumn("_head", F.col("valid_from") == F.col("_first")).drop("_k", "_first")
    heads = headed.where("_head").select(F.col(key).alias("_nk"), F.col("valid_from").alias("_nf"), F.col("valid_to").alias("_nt"), attribute_hash(attributes).alias("_nh"), *[F.col(a).alias(f"_n{i}") for i, a in enumerate(attributes)])
    closed, current = history.where("valid_to is not null"), history.where("valid_to is null")
    both = current.select(*values).withColumn("_h", attribute_hash(attributes)).join(heads, F.col(key) == F.col("_nk"), "full")
    met, same = F.col("_nk").isNotNull(), F.coalesce(F.col("_h") == F.col("_nh"), F.lit(False))
    ends = F.when(~met, F.col("valid_to")).when(same, F.col("_nt")).otherwise(F.col("_nf"))
    kept = F.struct(F.col(key).alias(key), *attributes, F.col("valid_from"), ends.alias("valid_to"))
    opened = F.struct(F.col("_nk").alias(key), *[F.col(f"_n{i}").alias(a) for i, a in enumerate(attributes)], F.col("_nf").alias("valid_from"), F.col("_nt").alias("valid_to"))
    out = both.select(F.explode(F.when(F.col(key).isNull(), F.array(opened)).when(~met | same, F.array(kept)).otherwise(F.array(kept, opened))).alias("r")).select("r.*")
    return closed.select(*values).unionByName(out).unionByName(headed.where("not _head").select(*values))
