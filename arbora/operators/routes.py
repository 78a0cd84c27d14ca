"""Routes between users: fuzzy targets, shortest and all paths, with logins and directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import graph, users as U
from arbora.operators.graph import all_paths, shortest_paths
from arbora.runtime import numbered


def _id(users: DataFrame, login: str) -> int | None:
    row = users.where(F.col("login") == login).select("id").first()
    return row.id if row else None


def named(paths: DataFrame, users: DataFrame) -> DataFrame:
    """(path_no, logins) of ``paths`` (path_no, path)."""
    steps = paths.select("path_no", F.posexplode("path").alias("at", "id")).join(users.select("id", "login"), "id")
    return steps.groupBy("path_no").agg(F.array_sort(F.collect_list(F.struct("at", "login"))).getField("login").alias("logins"))


def route(edges_follow: DataFrame, users: DataFrame, profiles: DataFrame, source: str, query: str, limit: int = 1, fuzzy: bool = False) -> DataFrame:
    """(path_no, path, hops): with ``fuzzy`` the shortest path to each of at most 20 matching users that can be reached,
    else the shortest path (limit 1) or all simple paths (0: all, n: the first n). No rows for unknown logins."""
    spark = users.sparkSession
    nothing = spark.createDataFrame([], "path_no int, path array<long>, hops int")
    start = _id(users, source)
    if start is None:
        return nothing
    if fuzzy:
        targets = [r.id for r in U.search(users, profiles, query).select("id").collect()]
        found = shortest_paths(edges_follow, start, targets)
        places = spark.createDataFrame(list(enumerate(targets)), "path_no int, tid long") if targets else spark.createDataFrame([], "path_no int, tid long")
        out = found.join(places, F.col("target") == F.col("tid")).select("path_no", "path")
        return U.apply_limit(out.withColumn("hops", F.greatest(F.size("path") - 1, F.lit(0))).orderBy("path_no"), limit)
    end = _id(users, query)
    if end is None:
        return nothing
    if limit == 1:
        out = shortest_paths(edges_follow, start, [end]).select(F.lit(0).alias("path_no"), "path")
    else:
        paths = all_paths(edges_follow, start, end, limit)
        out = numbered(paths, [], ["ranks"], "n").select((F.col("n") - 1).cast("int").alias("path_no"), "path")
    return out.withColumn("hops", F.greatest(F.size("path") - 1, F.lit(0)))


def route_edges(routes: DataFrame, edges_follow: DataFrame) -> DataFrame:
    return graph.directed_edges(routes.select("path_no", "path"), edges_follow)
