"""``python -m arbora.cli DIR COMMAND ...``: the analyses as commands, as text or with ``--json`` as JSON lines.

DIR holds users, edges, user_profiles and queue_items as Parquet tables.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import graph, routes, structure, users as U
from arbora.render import report
from arbora.runtime import session, table
from arbora.sources import crawl, delivered, model


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arbora")
    p.add_argument("directory")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    route = sub.add_parser("route")
    route.add_argument("source")
    route.add_argument("query")
    route.add_argument("--limit", type=int, default=1)
    route.add_argument("--fuzzy", action="store_true")
    common = sub.add_parser("common")
    common.add_argument("a")
    common.add_argument("b")
    common.add_argument("--limit", type=int, default=50)
    for name, most in (("suggest", 20), ("user", 0)):
        one = sub.add_parser(name)
        one.add_argument("login")
        one.add_argument("--limit", type=int, default=most)
    sub.add_parser("bridges").add_argument("--limit", type=int, default=20)
    communities = sub.add_parser("communities")
    communities.add_argument("--limit", type=int, default=10)
    communities.add_argument("--user")
    sub.add_parser("stats")
    sub.add_parser("export").add_argument("file")
    return p


def run(spark, args) -> list[tuple[str, DataFrame]]:
    """The titled results of a command."""
    d = args.directory
    users, profiles, edges = delivered.users(spark, d), delivered.profiles(spark, d), delivered.edges(spark, d)
    f = model.follows(edges)

    def known(login: str) -> int:
        row = users.where(F.col("login") == login).first()
        if row is None:
            raise SystemExit(f"unknown user {login}")
        return row.id

    if args.command == "route":
        return [("route", routes.named(routes.route(f, users, profiles, args.source, args.query, args.limit, args.fuzzy), users))]
    if args.command == "common":
        a, b = known(args.a), known(args.b)
        return [(side, U.common(edges, users, a, b, side, args.limit)) for side in ("following", "followers")]
    if args.command == "suggest":
        return [("based on", U.suggest_summary(edges, users, args.login)), ("suggestions", U.suggest(edges, users, args.login, args.limit))]
    if args.command == "user":
        known(args.login)
        return [(args.login, U.user_card(edges, users, profiles, args.login))]
    if args.command == "bridges":
        base = graph.component_summary(graph.components(users, f))
        return [("components", base), ("bridges", structure.bridge_cards(structure.bridges(users, f), users, profiles, args.limit))]
    if args.command == "communities":
        labels = structure.communities(users, f)
        out = [("communities", structure.community_cards(labels, f, users, args.limit)), ("modularity", structure.modularity(f, labels))]
        if args.user:
            known(args.user)
            out.append((f"community of {args.user}", structure.community_of(labels, users, args.user)))
        return out
    if args.command == "stats":
        parts = graph.components(users, f)
        size = crawl.stored_bytes(spark.read.parquet(f"{d}/edges.parquet"))
        return [("stats", U.stats(edges, users, delivered.crawl_state(spark, d), parts).join(size)), ("users by degree", U.degree_distribution(edges))]
    done = crawl.export_document(edges, users, profiles, args.file)
    return [("exported", spark.createDataFrame([done], "users long, edges long"))]


def lines(spark, args) -> list[str]:
    """What a command prints."""
    out = []
    for title, df in run(spark, args):
        rows = [r.json for r in U.as_json(df).collect()]
        out += rows if args.json else [report(title, [json.loads(r) for r in rows])]
    return out


def main() -> None:
    args = parser().parse_args()
    print("\n".join(lines(session(), args)))


if __name__ == "__main__":
    main()
