"""What changed between consecutive full snapshots.

The rows of each snapshot stand once as the later side of the pair with the snapshot before and once as the earlier side
of the pair with the one after. EXCEPT ALL both ways over all pairs at once is one grouping by (pair, key, attributes)
with a signed count: groups that balance are the identical rows and vanish, the others are the two residues. A full join
of the residues by key, done as a second grouping, labels additions, removals and changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.runtime import cut, small


def snapshot_changes(snapshots: DataFrame, number: str, key: list[str], tracked: list[str], latest: str | None = None) -> DataFrame:
    """(number, key..., change_kind): 'added', 'removed' or 'changed' against the snapshot before.

    ``number`` is the later snapshot; consecutive means consecutive among the delivered numbers. ``changed`` compares
    ``tracked`` only, null equal to null. Repeats within a snapshot count once; of rows of one key that differ, the one
    with the largest ``latest`` (then the largest tracked values) counts. Null key parts equal each other; rows with a
    null ``number`` belong to no snapshot. One snapshot or none gives no rows. A snapshot in which a key had no rows and
    one that was not delivered are told apart by the delivered numbers only.
    """
    rows = snapshots.where(F.col(number).isNotNull()).select(F.col(number).alias("s"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tracked)]).alias("t"), *([F.col(latest).alias("l")] if latest else []))
    keys = [f"k{i}" for i in range(len(key))]
    one = rows.groupBy("s", *keys).agg(F.max(F.struct(*(["l"] if latest else []), "t")).getField("t").alias("t"))
    numbers = cut(snapshots.select(F.col(number).alias("n")).where("n is not null").distinct())
    order = Window.orderBy("n")
    neighbours = small(numbers.select("n", F.lag("n").over(order).alias("before"), F.lead("n").over(order).alias("after")))
    sided = one.join(neighbours, F.col("s") == F.col("n")).select(
        *keys,
        "t",
        F.explode(F.array_compact(F.array(
            F.when(F.col("before").isNotNull(), F.struct(F.col("s").alias("pair"), F.lit(1).alias("sign"))),
            F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("pair"), F.lit(-1).alias("sign"))),
        ))).alias("p"),
    )
    residue = sided.groupBy(F.col("p.pair").alias("pair"), *keys, "t").agg(F.sum("p.sign").alias("sign")).where("sign <> 0")
    labelled = residue.groupBy("pair", *keys).agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
    kind = F.when(F.col("lo") > 0, "added").when(F.col("hi") < 0, "removed").otherwise("changed")
    return labelled.select(F.col("pair").alias(number), *[F.col(f"k{i}").alias(c) for i, c in enumerate(key)], kind.alias("change_kind"))
