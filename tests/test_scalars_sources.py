import json

import pytest
from pyspark.sql import functions as F

from arbora.functions import scalars as S
from arbora import render
from arbora.sources import api, crawl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("seconds, text", [(59, "59s"), (60, "1m 0s"), (3600, "1h 0m 0s"), (7385, "2h 3m 5s")])
def test_uptime(spark, seconds, text):
    assert one(spark, S.uptime(F.lit(seconds))) == text


def test_bars(spark):
    assert one(spark, S.bar(F.lit(1), F.lit(1000), 30)) == "█" and one(spark, S.bar(F.lit(0), F.lit(0), 30)) == ""
    assert one(spark, S.weight_bar(F.lit(float("inf")), F.lit(float("inf")), 10)) == "" and len(one(spark, S.weight_bar(F.lit(5.0), F.lit(4.0), 10))) == 10


def test_sizes_and_numbers(spark):
    assert one(spark, S.file_size(F.lit(1_000_000))) == "1000 KB" and one(spark, S.file_size(F.lit(1_000_001))) == "1.0 MB"
    assert one(spark, S.num(F.lit(1234567))) == "1,234,567" and one(spark, S.num(F.lit(0))) == "0"
    assert one(spark, S.fixed(F.lit(0.125), 2)) == "0.12" and one(spark, S.fixed(F.lit(4.85), 1)) == "4.8" and one(spark, S.fixed(F.lit(9.96), 1)) == "10.0"


def test_rounding_follows_the_exact_value(spark):
    rows = [(n / d * s,) for n in range(1, 400, 7) for d in (8.0, 1000.0, 10000.0, 3.0) for s in (1.0, 100.0)]
    got = spark.createDataFrame(rows, "x double").select("x", S.fixed(F.col("x"), 1).alias("a"), S.fixed(F.col("x"), 2).alias("b")).collect()
    assert all((r.a, r.b) == (f"{r.x:.1f}", f"{r.x:.2f}") for r in got)


def test_texts(spark):
    assert one(spark, S.truncate(F.lit("abcdef"), 4)) == "abc…" and one(spark, S.truncate(F.lit("abc"), 0)) == ""
    assert one(spark, S.truncate(F.lit("中文字符"), 5)) == "中文…" and one(spark, S.truncate(F.lit("中文字符"), 4)) == "中…" and one(spark, S.pad_left(F.lit("中"), 4)) == "  中"
    assert one(spark, S.visible_width(F.lit("\x1b[1mab\x1b[0m中"))) == 4
    assert one(spark, S.pad_right(F.lit("abc"), 2)) == "abc" and one(spark, S.pad_left(F.lit("a"), 3)) == "  a"
    assert one(spark, S.listed(F.array(*map(F.lit, "abcd")), 2)) == ["a", "b", "… 2 more"]


def test_payloads(spark):
    raw = spark.createDataFrame([('{"login":"a","id":1}',), ("no json",), ('{"id":2}',)], "value string")
    assert [(r.login, r.followers) for r in crawl.parse_profiles(raw).collect()] == [("a", 0)]
    pages = spark.createDataFrame([("a", 1, '[{"login":"x"},{"login":"y"}]'), ("a", 2, "[]"), ("a", 3, '[{"login":"z"}]')], "login string, page int, value string")
    assert sorted((r.place, r.peer_login) for r in crawl.parse_pages(pages).collect()) == [(0, "x"), (1, "y")]


def test_protocol(spark):
    texts = ['{"cmd":"start"}', '{"cmd":"pause"}', '{"cmd":"pause"}', '{"cmd":"status"}', '{"cmd":"start"}', '{"cmd":"jump"}', "?"]
    raw = spark.createDataFrame(list(enumerate(texts)), "seq int, value string")
    snapshot = spark.createDataFrame([(3,)], "pending long")
    got = crawl.responses(crawl.parse_requests(raw), snapshot).orderBy("seq").collect()
    ok = lambda msg: {"type": "ok", "data": {"msg": msg}}
    want = [ok("already running"), ok("paused"), ok("already paused"), {"type": "ok", "data": {"pending": 3}}, ok("started")]
    assert [json.loads(r.line) for r in got] == [*want, {"type": "error", "msg": "unknown command: jump"}, {"type": "error", "msg": "unknown command: "}]
    back = crawl.parse_responses(crawl.event_lines(spark.createDataFrame([("user_done", "a")], "event string, login string")), "line").first()
    assert back.type == "event" and json.loads(back.data) == {"event": "user_done", "login": "a"}


def landed(root):
    lists = {"a": (["b", "c", "d"], ["b"]), "b": ([], ["a"]), "hub": (["a"], [])}
    (root / "users").mkdir()
    for login, sides in lists.items():
        counts = {"login": login, "following": 9999 if login == "hub" else len(sides[0]), "followers": len(sides[1])}
        (root / "users" / f"{login}.json").write_text(json.dumps(counts))
        for side, peers in zip(api.SIDES, sides):
            folder = root / side / login
            folder.mkdir(parents=True)
            for n in range(0, len(peers), 2):
                (folder / f"{n // 2 + 1}.json").write_text(json.dumps([{"login": p} for p in peers[n : n + 2]]))
    return str(root)


def test_paged_lists_as_a_source(spark, tmp_path):
    root = landed(tmp_path)
    spark.dataSource.register(api.PageSource)
    got = spark.read.format("arbora_pages").option("root", root).option("partitions", "3").load()
    assert sorted((r.login, r.side, r.place, r.peer_login) for r in got.collect()) == [
        ("a", "followers", 0, "b"), ("a", "following", 0, "b"), ("a", "following", 1, "c"), ("a", "following", 2, "d"), ("b", "followers", 0, "a"), ("hub", "following", 0, "a"),
    ]


def test_crawlers_read_no_lists_of_hubs(spark, tmp_path):
    root = landed(tmp_path)
    scopes = spark.createDataFrame([("a", 1), ("hub", 2), ("nobody", 3)], "login string, seq long")
    got = {r.login: ([u.login for u in r.following], [u.login for u in r.followers], r.following_count) for r in api.crawl_scopes(scopes, "follow_crawler", root=root).collect()}
    assert got == {"a": (["b", "c", "d"], ["b"], 3), "hub": ([], [], 9999)}


def test_store_keeps_schemas_and_versions(spark, tmp_path):
    from arbora.sources.store import TABLES, Store

    store = Store(spark, str(tmp_path))
    assert all(store.table(name).count() == 0 for name in TABLES)
    store.replace("users", spark.createDataFrame([("7", "a", "x")], "id string, login string, extra string"))
    store.replace("users", store.table("users").unionByName(store.table("users")))
    again = Store(spark, str(tmp_path))
    assert [(r.id, r.login, r.discovered_at) for r in again.table("users").collect()] == [(7, "a", None)] * 2
    with pytest.raises(ValueError):
        store.replace("users", spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Exception, match="null"):
        store.replace("users", spark.createDataFrame([(1, None)], "id long, login string"))
    assert Store(spark, str(tmp_path)).table("users").count() == 2


def test_quota_and_abort(tmp_path):
    assert api.pause_seconds(api.Rate(remaining=5), 100) == 0 and api.pause_seconds(api.Rate(remaining=4, reset_at=130), 100) == 30 and api.pause_seconds(api.Rate(remaining=0, reset_at=90), 100) == 60
    source, calls = api.FolderApi(landed(tmp_path)), iter([False, True])
    assert [u["login"] for u in api.listed(source, "a", "following", lambda: next(calls))] == ["b", "c"]


def test_text_layout():
    tree = render.tree(render.Node("root", [render.Node("a", [render.Node("b")]), render.Node("c")]))
    assert tree == "root\n├─ a\n│  └─ b\n└─ c"
    assert render.grid(["name", "n"], [["中", 5], ["abc", 1200]]) == "name      n\n中        5\nabc   1,200"
    assert render.report("x", []) == "== x\n-- 0 rows" and render.width("\x1b[1mab\x1b[0m中") == 4


def test_commands(spark, data):
    from arbora import cli

    for words in (["common", "hub-1002b3", "hub-10032s"], ["--json", "communities", "--user", "hub-100000", "--limit", "2"], ["bridges", "--limit", "3"], ["stats"]):
        out = cli.lines(spark, cli.parser().parse_args([data, *words]))
        assert out and all(out)
    with pytest.raises(SystemExit):
        cli.lines(spark, cli.parser().parse_args([data, "user", "nobody at all"]))


def test_export_document(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, login string")
    profiles = spark.createDataFrame([], "user_id long, name string, company string, location string, followers long, following long, public_repos long")
    edges = spark.createDataFrame([(1, 2, "follows", 1, 1), (1, 9, "follows", 1, 1)], "from_user_id long, to_user_id long, edge_type string, degree int, is_active int")
    assert crawl.export_document(edges, users, profiles, f"{tmp_path}/x.json") == (2, 1)
    document = json.load(open(f"{tmp_path}/x.json"))
    assert document["edges"] == [{"from": "a", "to": "b", "type": "follows", "degree": 1}] and document["users"][0]["name"] is None
