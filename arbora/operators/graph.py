"""Traversals of the undirected multigraph behind the follows: adjacency, shortest and simple paths, components.

Traversals are loops of joins over the frontier, each round cut from its lineage. Ties are settled as a queue walking
adjacency lists in row order settles them: a node's place in its level is the sequence of adjacency places on the way to
it, which compares as an array, so that no level is ever numbered in one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.runtime import cut, numbered, release

#: Rounds after which a loop is given up as endless.
MAX_ROUNDS = 10_000
#: Links that one task joins to components, 16 bytes each.
RESIDUE = 200_000


def adjacency(follows: DataFrame) -> DataFrame:
    """(src, dst, place): two entries per edge, one at either end, in row order; nothing is deduplicated.

    place = (from, to, side) orders a list; parallel edges and self-loops keep all their entries.
    """
    entry = lambda a, b, side: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.struct(F.col("from_user_id").alias("f"), F.col("to_user_id").alias("t"), F.lit(side).alias("s")).alias("place"))
    return follows.select(F.inline(F.array(entry("from_user_id", "to_user_id", 0), entry("to_user_id", "from_user_id", 1))))


def first_neighbours(entries: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` entries of every list, with rank from 1. Lists are cut before the shuffle, so hubs stay light
    (the planner does so up to 1,000; for more, or 0 for all, no list is sorted in one task either)."""
    if not 0 < most <= 1000:
        ranked = numbered(entries, ["src"], ["place"], "rank").withColumn("rank", F.col("rank").cast("int"))
        return ranked.where(F.col("rank") <= most) if most else ranked
    order = Window.partitionBy("src").orderBy("place")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def distances(follows: DataFrame, source: int, most: int = MAX_ROUNDS) -> DataFrame:
    """(id, distance) of all nodes within ``most`` hops of the source, in either direction of the edges."""
    links = cut(adjacency(follows).select("src", "dst").distinct())
    spark = follows.sparkSession
    front = spark.createDataFrame([(source, 0)], "id long, distance int")
    done = [front]
    for hop in range(1, most + 1):
        near = front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = cut(near.join(reduce(DataFrame.unionByName, done[-2:]).select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)))
        if front.isEmpty():
            break
        done.append(front)
    else:
        if most == MAX_ROUNDS:
            raise RuntimeError("distances did not end")
    return reduce(DataFrame.unionByName, done)


def shortest_paths(follows: DataFrame, source: int, targets: list[int]) -> DataFrame:
    """(target, path): the path a queue search finds first, for each reachable target (a short list); [x] for x itself.

    The search stops at the level that holds the last target. One tree serves all targets.
    """
    spark = follows.sparkSession
    entries = cut(adjacency(follows))
    front = spark.createDataFrame([(source, [source], [])], "id long, path array<long>, way array<struct<f:long,t:long,s:int>>")
    found, left = [front.where(F.col("id").isin(targets))], set(targets) - {source}
    earlier = spark.createDataFrame([], "id long")
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        step = front.join(entries, F.col("id") == F.col("src"))
        reached = step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.concat("way", F.array("place")).alias("way"))
        # Only the two levels before can be met again.
        seen = front.select("id").unionByName(earlier)
        best = reached.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("way", "path")).alias("m"))
        earlier, front = front.select("id"), cut(best.select("id", "m.path", "m.way"))
        hit = [r.id for r in front.where(F.col("id").isin(list(left))).select("id").collect()]
        if hit:
            found.append(front.where(F.col("id").isin(hit)))
            left -= set(hit)
        if not hit and front.isEmpty():
            break
    else:
        raise RuntimeError("paths did not end")
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias("target"), "path")


def all_paths(follows: DataFrame, source: int, target: int, limit: int = 0, most_nodes: int = 6, most_neighbours: int = 50) -> DataFrame:
    """(path, ranks): simple paths of at most ``most_nodes`` nodes, in depth-first order; parallel edges repeat a path.

    Only the first ``most_neighbours`` entries of each list are walked, as the search defines; 0 as limit is unlimited.
    Paths are grown by joins; those that cannot reach the target in the nodes left are dropped by their distance to it.
    """
    spark = follows.sparkSession
    entries = cut(first_neighbours(adjacency(follows), most_neighbours).select("src", "dst", "rank"))
    # Distances to the target along the entries that may be walked, as far as a path that has left the source can be from it.
    away, level = spark.createDataFrame([(target, 0)], "node long, away int"), 0
    front = away
    while level < most_nodes - 2:
        level += 1
        back = front.join(entries, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        front = cut(back.join(away, "node", "left_anti").withColumn("away", F.lit(level)))
        away = away.unionByName(front)
    empty = spark.createDataFrame([], "path array<long>, ranks array<int>")
    if source == target:
        return spark.createDataFrame([([source], [])], empty.schema)
    paths, done = spark.createDataFrame([(source, [source], [])], "at long, path array<long>, ranks array<int>"), [empty]
    for nodes in range(2, most_nodes + 1):
        grown = paths.join(entries, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = grown.join(away, F.col("dst") == F.col("node")).where(F.col("away") <= most_nodes - nodes)
        paths = cut(grown.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("ranks", F.array("rank")).alias("ranks")))
        done.append(paths.where(F.col("at") == target).select("path", "ranks"))
        paths = paths.where(F.col("at") != target)
    every = reduce(DataFrame.unionByName, done)
    return every.orderBy("ranks").limit(limit) if limit else every


def directed_edges(paths: DataFrame, follows: DataFrame) -> DataFrame:
    """(path_no, hop, from_user_id, to_user_id): for each hop a to b of ``paths`` (path_no, path) the edge a to b if there
    is one, else b to a. A mutual follow shows a to b only."""
    hops = paths.select("path_no", "path", F.posexplode(F.expr("slice(path, 1, greatest(size(path) - 1, 0))")).alias("hop", "a")).withColumn("b", F.expr("path[hop + 1]"))
    there = follows.distinct().select(F.col("from_user_id").alias("fa"), F.col("to_user_id").alias("fb"))
    forth = hops.join(there, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left").withColumn("forth", F.col("fa").isNotNull()).drop("fa", "fb")
    back = there.select(F.col("fa").alias("ra"), F.col("fb").alias("rb"))
    both = forth.join(back, (F.col("b") == F.col("ra")) & (F.col("a") == F.col("rb")), "left").where("forth or ra is not null")
    return both.select("path_no", F.col("hop").cast("int").alias("hop"), F.when(F.col("forth"), F.col("a")).otherwise(F.col("b")).alias("from_user_id"), F.when(F.col("forth"), F.col("b")).otherwise(F.col("a")).alias("to_user_id"))


def components(nodes: DataFrame, links: DataFrame, residue: int = RESIDUE) -> DataFrame:
    """(id, component): the smallest id of each node's weak component; isolated nodes are their own.

    Each round every node follows, twice, the neighbour of the smallest hash, and the links are drawn between the nodes
    so reached. Finished components have no links left and a constant share of the nodes goes with each round, so all
    rounds together read a few times the links. At most ``residue`` links (counted) are finished in one task. The
    neighbours of a hub are one partially aggregated row.
    """
    a, b = F.least("from_user_id", "to_user_id"), F.greatest("from_user_id", "to_user_id")
    left = cut(links.select(a.alias("a"), b.alias("b")).where("a <> b").distinct())
    drawn: list[DataFrame] = []
    for number in range(MAX_ROUNDS):
        if left.count() <= residue:
            break
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
        rank = lambda c: F.xxhash64(c, F.lit(number))  # noqa: E731, B023
        near = ends.groupBy("x").agg(F.min_by("y", rank("y")).alias("y"))
        to = cut(near.select("x", F.when(rank("y") < rank("x"), F.col("y")).otherwise(F.col("x")).alias("r")))
        step = cut(to.join(to.select(F.col("x").alias("m"), F.col("r").alias("rr")), F.col("r") == F.col("m")).select("x", F.col("rr").alias("r")))
        drawn.append(step)
        one, two = step.select(F.col("x").alias("a"), F.col("r").alias("ra")), step.select(F.col("x").alias("b"), F.col("r").alias("rb"))
        moved = left.join(one, "a").join(two, "b").where("ra <> rb")
        rest = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        release(to, left)
        left = rest
    else:
        raise RuntimeError("components did not settle")
    roots = cut(left.repartition(1).mapInPandas(_join_here, "x long, r long"))
    for step in reversed(drawn):
        above = roots.select(F.col("x").alias("m"), F.col("r").alias("rr"))
        roots = cut(step.join(above, F.col("r") == F.col("m"), "left").select("x", F.coalesce("rr", "r").alias("r")))
    release(left, *drawn)
    known = nodes.select("id").distinct().join(roots, F.col("id") == F.col("x"), "left").select("id", F.coalesce("r", "id").alias("r"))
    least = known.groupBy(F.col("r").alias("k")).agg(F.min("id").alias("component"))
    return known.join(least, F.col("r") == F.col("k")).select("id", "component")


def _join_here(batches):
    """(x, r): a common node for the ends of every chain of links (a, b), at most ``residue`` of them."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        way = []
        while top[x] != x:
            way.append(x)
            x = top[x]
        for w in way:
            top[w] = x
        return x

    for pdf in batches:
        for a, b in zip(pdf.a.tolist(), pdf.b.tolist()):
            top.setdefault(a, a)
            top.setdefault(b, b)
            ra, rb = root(a), root(b)
            top[max(ra, rb)] = min(ra, rb)
    names = list(top)
    yield pd.DataFrame({"x": pd.array(names, "int64"), "r": pd.array([root(x) for x in names], "int64")})


def component_summary(parts: DataFrame) -> DataFrame:
    """One row: number of components and share of the largest."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.round(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)), 6).alias("largest_ratio"))
