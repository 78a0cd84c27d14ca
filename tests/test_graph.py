"""Micro graphs with known answers, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import graph, queue, routes, structure
from arbora.operators import users as U


def follows(spark, pairs):
    return spark.createDataFrame(pairs, "from_user_id long, to_user_id long")


def edges(spark, pairs):
    return follows(spark, pairs).withColumns({"edge_type": F.lit("follows"), "is_active": F.lit(1), "degree": F.lit(1)})


def users(spark, ids):
    return spark.createDataFrame([(i, f"u{i}") for i in ids], "id long, login string")


def paths(spark, pairs, a, b, limit=0):
    return [r.path for r in graph.all_paths(follows(spark, pairs), a, b, limit).orderBy("ranks").collect()]


def shortest(spark, pairs, a, b):
    rows = graph.shortest_paths(follows(spark, pairs), a, [b]).collect()
    return rows[0].path if rows else None


def test_mutual_follow_repeats_the_path(spark):
    assert paths(spark, [(1, 2), (2, 1)], 1, 2) == [[1, 2], [1, 2]]


def test_depth_cap(spark):
    chain = [(i, i + 1) for i in range(1, 7)]
    assert paths(spark, chain, 1, 6) == [[1, 2, 3, 4, 5, 6]] and paths(spark, chain, 1, 7) == []
    assert shortest(spark, chain, 1, 7) == [1, 2, 3, 4, 5, 6, 7]


def test_neighbour_cap(spark):
    star = [(1, i) for i in range(2, 62)]
    assert paths(spark, star, 1, 51) == [[1, 51]] and paths(spark, star, 1, 52) == [] and shortest(spark, star, 1, 52) == [1, 52]


def test_same_and_unreachable_ends(spark):
    assert paths(spark, [(1, 2)], 1, 1) == [[1]] and shortest(spark, [(1, 2)], 1, 1) == [1] and shortest(spark, [(1, 2), (3, 4)], 1, 4) is None


def test_hops_show_existing_direction(spark):
    route = spark.createDataFrame([(0, [1, 2, 3])], "path_no int, path array<long>")
    got = graph.directed_edges(route, follows(spark, [(2, 1), (2, 3), (3, 2)])).orderBy("hop").collect()
    assert [(r.from_user_id, r.to_user_id) for r in got] == [(2, 1), (2, 3)]


def queue_search(pairs, a, b):
    near = {}
    for x, y in sorted(pairs):
        near.setdefault(x, []).append(((x, y, 0), y))
        near.setdefault(y, []).append(((x, y, 1), x))
    came, line = {a: None}, [a]
    for x in line:
        for _, y in sorted(near.get(x, [])):
            if y not in came:
                came[y] = x
                line.append(y)
    path = [b]
    while came.get(path[-1]) is not None:
        path.append(came[path[-1]])
    return path[::-1]


def test_shortest_path_is_the_queue_search_one(spark):
    rnd = random.Random(4)
    pairs = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(60)})
    for b in (7, 21):
        assert shortest(spark, pairs, 0, b) == queue_search(pairs, 0, b)


def test_components_and_isolated_users(spark):
    got = graph.components(users(spark, [1, 2, 3]), follows(spark, [(1, 2)]))
    assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 3}
    assert [tuple(r) for r in graph.component_summary(got).collect()] == [(2, 0.666667)]


def test_components_of_paths_and_stars_do_not_depend_on_the_residue(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (202, 202)]
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 202: 202, 203: 203}
    for residue in (0, 20, 10**6):
        got = graph.components(users(spark, want), follows(spark, pairs), residue)
        assert {r.id: r.component for r in got.collect()} == want


def brute_impact(ids, pairs):
    def count(nodes):
        left, n = set(nodes), 0
        while left:
            n += 1
            line = [left.pop()]
            for x in line:
                near = {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x}
                line += near & left
                left -= near
        return n

    base = count(ids)
    return {v: max(count(set(ids) - {v}) - base, 0) for v in {a for a, _ in pairs}}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_bridges_match_removal(spark, limit):
    rnd = random.Random(8)
    ids = list(range(24))
    pairs = sorted({(rnd.randrange(24), rnd.randrange(24)) for _ in range(26)} | {(0, 0), (1, 2), (2, 1)})
    got = structure.bridges(users(spark, ids), follows(spark, pairs), component_limit=limit)
    assert {r.id: r.impact for r in got.collect()} == brute_impact(ids, pairs)


def test_modularity_of_two_triangles(spark):
    f = follows(spark, [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    u = users(spark, range(1, 7))
    labels = structure.communities(u, f)
    assert {r.id: r.community for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert structure.modularity(f, labels).first()[0] == 0.666667
    large = structure.communities(u, f, component_limit=1)
    assert large.count() == 6


def test_recommendations(spark):
    u = users(spark, range(1, 6))
    one = lambda pairs: [(r.login, r.weight, r.via) for r in U.suggest(edges(spark, pairs), u, "u1").collect()]
    assert one([(1, 2), (2, 3)]) == [("u3", float("inf"), [2])]
    assert one([(1, 2)]) == [] and one([(1, 2), (1, 3), (2, 3), (2, 1)]) == []
    assert [(x, round(w, 6)) for x, w, _ in one([(1, 2), (2, 3), (2, 4)])] == [("u3", 1.442695), ("u4", 1.442695)]


def test_search_wildcards_and_order(spark):
    u = spark.createDataFrame([(1, "Bob"), (2, "xbob"), (3, "bo"), (4, "bxb")], "id long, login string")
    p = spark.createDataFrame([], "user_id long, name string, company string, location string, followers long, following long, public_repos long")
    assert [r.login for r in U.search(u, p, "bo").collect()] == ["Bob", "bo", "xbob"]
    assert [r.login for r in U.search(u, p, "b_b").collect()] == ["Bob", "bxb", "xbob"]
    assert [r.login for r in U.search(u, p, "b\\_b").collect()] == []


def test_fuzzy_route_and_unknown_login(spark):
    u = users(spark, range(1, 6))
    p = spark.createDataFrame([], "user_id long, name string, company string, location string, followers long, following long, public_repos long")
    f = follows(spark, [(1, 2), (2, 3)])
    got = routes.route(f, u, p, "u1", "u", limit=0, fuzzy=True)
    assert sorted((r.path, r.hops) for r in got.collect()) == [([1], 0), ([1, 2], 1), ([1, 2, 3], 2)]
    assert routes.route(f, u, p, "nobody", "u1").count() == 0


STATE = "crawler_name string, scope_key string, status string, priority string, degree int, error_count int, last_error string, crawled_at timestamp, seq long"


def test_claim_order(spark):
    rows = [("pending", "normal", 1, 1), ("pending", "normal", 0, 2), ("pending", "low", 0, 0), ("retry", "high", 0, 3), ("pending", "x", 9, 9)]
    state = spark.createDataFrame([("follow_crawler", f"s{q}", s, p, 0, e, None, None, q) for s, p, e, q in rows], STATE)
    assert [r.seq for r in queue.claim_order(state).collect()] == [9, 2, 1, 0, 3]
    after, top = queue.claim(state, 2)
    assert {r.scope_key for r in top.collect()} == {"s9", "s2"} and after.where("status = 'in_progress'").count() == 2
    assert [r.scope_key for r in queue.claim(state.where("status = 'retry'"), 5)[1].collect()] == ["s3"]


def test_all_claimable_scopes_have_a_place(spark):
    rows = [("follow_crawler", f"s{i}", ("pending", "retry", "done")[i % 3], ("high", "low", "x")[i % 7 % 3], 0, i % 4, None, None, i) for i in range(400)]
    state = spark.createDataFrame(rows, STATE)
    want = [r.scope_key for r in queue.claim_order(state).collect()]
    got = {r.place: r.scope_key for r in queue.claim_places(state).collect()}
    assert len(want) > 100 and [got[n + 1] for n in range(len(got))] == want


def test_claiming_leaves_retries_while_anything_is_pending(spark):
    state = spark.createDataFrame([("follow_crawler", "a", "pending", "low", 0, 0, None, None, 1), ("follow_crawler", "b", "retry", "high", 0, 0, None, None, 2)], STATE)
    assert [r.scope_key for r in queue.claim(state, 5)[1].collect()] == ["a"]


def test_json_keeps_nulls_and_hides_infinity(spark):
    df = spark.createDataFrame([(1, None, float("inf"))], "a int, b string, c double")
    assert U.as_json(df).first()[0] == '{"a":1,"b":null,"c":null}'


def stamped(df):
    now = F.current_timestamp()
    return df.withColumns({"weight": F.lit(1.0), "first_seen_at": now, "last_seen_at": now})


def test_edge_store_replays_a_batch_once_and_goes_on_after_a_restart(spark, tmp_path):
    from arbora.streaming.events import EdgeStore

    root = str(tmp_path / "store")
    store = EdgeStore(spark, root, stamped(edges(spark, [(1, 2)])))
    assert store.history().count() == 0
    batch = edges(spark, [(1, 2), (3, 4)]).withColumn("weight", F.lit(1.0))
    store.apply(batch, 0)
    store.apply(batch, 0)
    assert store.edges().count() == 2 and store.history().count() == 1
    again = EdgeStore(spark, root)
    again.apply(edges(spark, [(5, 6)]).withColumn("weight", F.lit(1.0)), 1)
    assert {(r.from_user_id, r.to_user_id) for r in again.edges().collect()} == {(1, 2), (3, 4), (5, 6)} and again.history().count() == 2


def test_upserts_from_a_stream(spark, tmp_path):
    from arbora.streaming.events import EdgeStore, upsert_stream

    store = EdgeStore(spark, str(tmp_path / "store"), stamped(edges(spark, [(1, 2)])))
    for n in range(2):
        edges(spark, [(1, 2), (7, n)]).withColumn("weight", F.lit(1.0)).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        upsert_stream(stream, store, str(tmp_path / "state")).awaitTermination()
    assert store.edges().count() == 3 and store.history().count() == 2


def test_watch_loop_pauses_and_says_bye(spark, tmp_path):
    from arbora.streaming.events import Watch

    lines = []
    rows = spark.createDataFrame([("user_done", "a"), ("user_queued", "b")], "event string, login string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    watch = Watch(events, lambda: spark.createDataFrame([(4,)], "pending long"), lambda df, name: lines.extend(r.line for r in df.collect()), str(tmp_path / "state"), "0 seconds")
    assert watch.start() == "started" and watch.start() == "already running"
    assert watch.pause() == "paused" and watch.pause() == "already paused"
    seen = len(lines)
    assert watch.start() == "started"
    watch.stop()
    assert seen == 3 and lines[2] == '{"type":"ok","data":{"pending":4}}' and lines[-1] == '{"type":"bye"}' and sum('"event"' in x for x in lines) == 2


def test_widths_of_event_columns(spark):
    from arbora.streaming.events import column_widths

    df = spark.createDataFrame([(1, "ab中"), (12345, "x" * 50)], "degree int, login string")
    assert tuple(column_widths(df).first()) == (6, 30) and tuple(column_widths(df.limit(0)).first()) == (3, 0)


def test_visiting_order_by_joins_is_the_permutation(spark):
    for n in (1, 2, 3, 50, 700):
        ids = users(spark, [5 * i + 1 for i in range(n)])
        want = {r.tid: r.turn for r in structure.turns(ids).collect()}
        assert {r.tid: r.turn for r in structure.turns(ids, limit=0).collect()} == want and sorted(want.values()) == list(range(n))


def test_numbering_in_groups_of_any_size(spark):
    from arbora.runtime import numbered

    rnd = random.Random(6)
    rows = [("hot", rnd.random()) for _ in range(500)] + [("a", 2.0), ("a", 1.0), (None, 5.0), (None, 4.0)]
    got = numbered(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], ["v"], "part")
    assert got.columns == ["g", "v", "part"]
    for g in ("hot", "a", None):
        own = sorted(v for k, v in rows if k == g)
        assert sorted((r.part, r.v) for r in got.collect() if r.g == g) == list(enumerate(own, 1))
    assert numbered(spark.createDataFrame([], "g string, v double"), [], ["v"], "n").count() == 0


def test_newest_events_of_each_type(spark):
    from arbora.streaming.events import newest

    rows = [(i, f"2024-01-01 00:{i // 10:02}:00" if i else None, "a" if i % 3 else "b") for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event string").withColumn("ts", F.col("ts").cast("timestamp"))
    for most in (1, 7, 1000):
        got = {(r.event, r.place): r.event_id for r in newest(df, most).collect()}
        for kind in "ab":
            own = [i for i, _, e in sorted(rows, key=lambda r: (r[1] or "", r[0]), reverse=True) if e == kind][:most]
            assert [got[kind, n + 1] for n in range(len(own))] == own
        assert len(got) == min(most, 80) + min(most, 40)


def test_standing_edges_take_the_row_seen_last(spark):
    from arbora.sources.model import follows as standing_follows
    from arbora.sources.model import latest_edges, standing

    rows = [(1, 2, "follows", 1, "2024-01-01"), (1, 2, "follows", 0, "2024-01-02"), (1, 3, "follows", 0, "2024-01-01"), (1, 3, "follows", 1, "2024-01-01"), (1, 4, "follows", 1, None), (1, 5, "starred", 1, "2024-01-01"), (1, 6, "follows", 1, "1960-01-01"), (1, 6, "follows", 0, None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "from_user_id long, to_user_id long, edge_type string, is_active int, last_seen_at string, metadata string").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    want = {(1, 3), (1, 4), (1, 6)}
    assert {tuple(r) for r in standing(df, "follows").collect()} == want == {tuple(r) for r in standing_follows(latest_edges(df)).collect()}


def test_common_followings_of_given_pairs(spark):
    f = follows(spark, [(1, 5), (2, 5), (1, 6), (2, 6), (3, 6), (1, 2), (1, 5)])
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 1), (3, 1), (9, 1)], "a long, b long")
    assert sorted(map(tuple, U.common_of_pairs(f, pairs).collect())) == [(1, 2, 5), (1, 2, 6), (3, 1, 6)]


def test_first_run_and_config(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    profiles = none("user_id long, name string, followers long, fetched_at timestamp")
    seed = spark.createDataFrame([("me", "Me", 3)], "login string, name string, followers long").withColumn("fetched_at", F.current_timestamp())
    first = queue.bootstrap(none("id long, login string"), profiles, none(STATE), none("key string, value string"), seed)
    assert [tuple(r) for r in first["users"].collect()] == [(1, "me")] and queue.get_config(first["config"], "seed").first().value == "me"
    assert [(r.user_id, r.name) for r in first["profiles"].collect()] == [(1, "Me")] and [r.scope_key for r in queue.pending_scopes(first["state"]).collect()] == ["me"]
    again = queue.bootstrap(first["users"], first["profiles"], first["state"], first["config"], seed.withColumn("login", F.lit("you")))
    assert again["users"].count() == 1
