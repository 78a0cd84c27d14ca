"""The llm operators against brute force, exact reference encoders and small hand-made cases."""

import os
import random
import unicodedata

import pytest

from arbora.llm import bpe, canonical, leaks, names, sentences, setjoin

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary files here")


# Similar sets


def brute_sets(rows, least=5, num=3, den=5):
    sets = {}
    for k, t in rows:
        if k is not None and t is not None:
            sets.setdefault(k, set()).add(t)
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


def set_rows(seed=1):
    rnd = random.Random(seed)
    rows = [(None, 1), (1, None)]
    for k in range(120):
        size = rnd.choice([2, 5, 5, 6, 8, 12, 30])
        base = random.Random(k // 4).sample(range(60), size)
        for t in base:
            if rnd.random() > 0.12:
                rows.append((k, t))
        rows += [(k, 0), (k, 0)]
    return rows + [(900, t) for t in range(5)] + [(901, t) for t in range(5)] + [(902, t) for t in (0, 1, 2, 7, 8)] + [(903, t) for t in (0, 1, 2, 3, 4, 5, 6)]


@pytest.mark.parametrize("limit", [100_000, 12])
def test_set_pairs_match_brute_force(spark, limit):
    rows = set_rows()
    links, members = setjoin.similar_sets(spark.createDataFrame(rows, "f long, t long"), "f", "t", array_limit=limit)
    assert {tuple(r) for r in setjoin.expand(links, members).distinct().collect()} == brute_sets(rows)


def test_no_sets(spark):
    links, members = setjoin.similar_sets(spark.createDataFrame([], "f long, t long"), "f", "t")
    assert links.count() == 0 and members.count() == 0


# Encoding


@needs_tokenizer
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    rnd = random.Random(0)
    texts = ["", " ", "a" * 5000, "<|endoftext|> x", "don't  stop\n\n 12345 ½", "日本語のテキスト。", "👩‍💻👍", "\u0000﻿"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(60)]
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(1000, None, "clash"), (1000, None, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_table(df, "doc_id", "text", TOKENIZER).collect()]
    assert sorted(got) == sorted([(i, t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)] + [(1000, []), (1000, [])])
    assert bpe.encode_table(df.limit(0), "doc_id", "text", TOKENIZER).count() == 0


@needs_tokenizer
def test_encoding_round_trip():
    v = bpe.Vocabulary(TOKENIZER)
    words = [bytes(random.Random(i).randrange(256) for _ in range(i % 40 + 1)) for i in range(200)]
    back = {int(i): bytes([b]) for b, i in enumerate(v.byte_ids)}
    left, right = v.keys // v.width, v.keys % v.width
    for n in v.rank.argsort():
        back[int(v.merged[n])] = back[int(left[n])] + back[int(right[n])]
    assert [b"".join(back[int(i)] for i in ids) for ids in v.encode_words(words)] == words


# Leaks


def brute_leaks(docs, items, run):
    clean = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if c.isalnum()) if s else ""
    found = set()
    for d, text in docs:
        t = clean(text)
        for i, item in items:
            x = clean(item)
            if any(x[k : k + run] in t for k in range(len(x) - run + 1)):
                found.add((d, i))
    return found


@pytest.mark.parametrize("limit", [10**6, 0])
def test_leaks_match_brute_force(spark, limit):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeioubdgklmnprstäéß") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(30)] + [(30, None), (31, "short"), (1, None)]
    docs = [(0, None), (1, ""), (2, "  "), (3, "x" * 30_000)]
    for d in range(4, 90):
        item = items[rnd.randrange(30)][1]
        at, size = rnd.randrange(40), rnd.choice([40, 50, 60, 90])
        part = item[at : at + size]
        part = part.upper() if d % 3 else part.replace(" ", " - ")
        docs.append((d, " ".join(word() for _ in range(rnd.randrange(80))) + part + " ".join(word() for _ in range(20))))
    docs += docs[4:10]
    docs.append((500, " ".join(x for _, x in items[:5]) * 3))
    want = brute_leaks(docs, items, 50)
    got = leaks.leaks(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), broadcast_limit=limit)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40 and got.count() == len(want)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(docs, items).count() == 0


# Canonical values

LIST = [(1, "company", "Oakline Systems"), (2, "company", "Oakline Labs"), (3, "company", "Brevadon Foundry"), (4, "company", "University of Kesset Arts"), (11, "location", "Port Vellin"), (12, "location", "Vellin"), (13, "location", "South Ostra"), (14, "company", None)]
VALUES = [
    ("Oakline Systems, Inc", 1), ("labs (oakline)", 2), ("@oaklinesystems", 1), ("OAKLINE", 0), ("Brevadon", 3), ("brevdaon foundry", 3), ("CTO, Brevadon Fou.", 3), ("UKA-Kesset", 4),
    ("student", 0), ("Brevadon Hosting", 0), ("", None), ("  ", None), (None, None), ("x" * 5000, 0), ("Oaklïne Systëms | hiring!", 1),
]
PLACES = [("Pt. Vellin", 11), ("Vellin", 12), ("vellin, port, Somewhere", 11), ("South-Ostra!!", 13), ("S Ostra", 13), ("Ostra", 0), ("Fort Vellin", 0), ("Velln", 12), ("moon", 0)]


@pytest.mark.parametrize("limit", [100, 0])
def test_canonical_values(spark, limit):
    rows = [(i, v, None, "clash") for i, (v, _) in enumerate(VALUES)] + [(100 + i, None, v, "clash") for i, (v, _) in enumerate(PLACES)] + [(None, "Oakline Labs", None, "clash")]
    df = spark.createDataFrame(rows + rows[:3], "user_id long, company string, location string, field string")
    got = sorted((r.user_id, r.ref_id) for r in canonical.map_values(df, spark.createDataFrame(LIST, "ref_id long, kind string, canonical string"), broadcast_limit=limit).collect())
    want = {i: r for i, (_, r) in enumerate(VALUES) if r is not None} | {100 + i: r for i, (_, r) in enumerate(PLACES)}
    assert got == sorted(want.items())


def test_distance_weights():
    assert canonical.distance("abcd", "abdc", 2) == 0.8 and canonical.distance("abcd", "abcd", 2) == 0 and canonical.distance("abc", "xyzw", 1) == float("inf")
    assert canonical.distance("new town", "newtown", 2) == pytest.approx(0.2) and canonical.distance("letter", "leter", 2) == pytest.approx(0.7)


# Names


def test_same_person(spark):
    people = [
        (1, "Beatrice Lomander", "Oakline Labs"), (2, "Bea Lomander", "Labs (Oakline)"), (3, "LOMANDER, B.", "oakline labs inc"), (4, "beatrice.lomnader", "Oakline Labs"), (5, "Dr. BeatriceLomander", "Oakline Labs"),
        (6, "Beatrice Lomander", "Oakline Systems"), (7, "Harold Lomander", "Oakline Labs"), (8, "Beatrice Lomander", "freelance"), (9, None, "Oakline Labs"), (10, "Beatrice Lomander", " "),
        (11, "Ken Tarvido", "Zedworth Hosting"), (12, "Kenneth Tarvido", "@zedworth-hosting"), (13, "Kenneth Tarvido", "Zedworth"), (14, "Kenneth Tarvido", "Mossbank Press"), (1, "Beatrice Lomander", "Oakline Labs"), (None, "Bea Lomander", "Oakline Labs"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in people], "user_id long, name string, company string, s string")
    members, _ = names.same_person(df, spark.createDataFrame(LIST, "ref_id long, kind string, canonical string"))
    got = {tuple(r) for r in names.account_pairs(members).collect()}
    own = {(a, b) for a in range(1, 6) for b in range(a + 1, 6)}
    assert got == own | {(11, 12), (11, 13), (12, 13)}


def test_no_names(spark):
    df = spark.createDataFrame([], "user_id long, name string, company string")
    members, _ = names.same_person(df, spark.createDataFrame(LIST, "ref_id long, kind string, canonical string"))
    assert names.account_pairs(members).count() == 0


def test_cosine_links_are_all_pairs_above_the_cosine(spark):
    import math

    rnd = random.Random(5)
    part = lambda: "".join(rnd.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(rnd.randrange(3, 8)))
    firsts, lasts = [part() for _ in range(40)], [part() for _ in range(40)]
    people = sorted({f"{rnd.choice(firsts)} {rnd.choice(lasts)}" for _ in range(300)}) + ["bob", "bob lee", "b lee"]
    rows = [(i, str(i % 2), name) for i, name in enumerate(people)]
    vectors = [names.name_vector(name.split(" ")) for name in people]
    df = {}
    for v in vectors:
        for g in v:
            df[g] = df.get(g, 0) + 1
    weigh = lambda v: {g: k * math.log((len(people) + 1) / df[g]) for g, k in v.items()}
    vectors = [weigh(v) for v in vectors]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    dot = lambda a, b: sum(x * b.get(g, 0.0) for g, x in a.items())
    cosine = {(a, b): dot(vectors[a], vectors[b]) / norm[a] / norm[b] for a in range(len(people)) for b in range(a + 1, len(people)) if a % 2 == b % 2}
    got = {(r.a, r.b): r.score for r in names.cosine_links(spark.createDataFrame(rows, "s long, block string, words string"), names.name_vector, 0.15).collect()}
    want = {p: c for p, c in cosine.items() if c >= 0.15}
    assert got == pytest.approx(want) and 100 < len(want) < len(cosine)


def name_rows(n):
    rnd = random.Random(6)
    part = lambda: "".join(rnd.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(rnd.randrange(3, 8)))
    people = sorted({f"{part()} {part()}" for _ in range(n)})
    return [(i, "x" if i % 5 else f"y{i % 35}", name) for i, name in enumerate(people)]


def test_cosine_links_do_not_depend_on_slices_or_the_gram_limit(spark):
    rows = spark.createDataFrame([*name_rows(600), (900, "alone", "bo lee")], "s long, block string, words string")
    forms = ({}, {"slice_rows": 30}, {"slice_rows": 1}, {"gram_limit": 0}, {"gram_limit": 0, "slice_rows": 30})
    got = [sorted(map(tuple, names.cosine_links(rows, names.name_vector, 0.15, **form).collect())) for form in forms]
    assert len(got[0]) > 100 and all(x == got[0] for x in got)


def test_large_pieces_of_products_are_taken_apart(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(1)
    row, key = np.nonzero(rnd.random((40, 12)) < 0.4)
    x = rnd.random(len(row))
    whole = np.zeros((40, 12))
    whole[row, key] = x
    for most in (1, 7, 100, 10**6):
        monkeypatch.setattr(names, "PRODUCTS", most)
        across = (row[row < 15], key[row < 15], x[row < 15]), (row[row >= 15], key[row >= 15], x[row >= 15])
        for left, right, kept in (((row, key, x), None, lambda a, b: a < b), (*across, lambda a, b: a < 15 <= b)):
            got = {(int(a), int(b)): s for found in names._products(left, right, 40, 0.5) for a, b, s in zip(*found)}
            assert got == pytest.approx({(a, b): s for a in range(40) for b in range(40) if kept(a, b) and (s := whole[a] @ whole[b]) >= 0.5})


def test_shuffle_of_cosine_links_does_not_follow_the_pairs(spark):
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    sizes = []
    for n in (500, 2000):
        rows = spark.createDataFrame(name_rows(n), "s long, block string, words string").coalesce(1)
        before = shuffled()
        names.cosine_links(rows, names.name_vector, 0.15)
        sizes.append(shuffled() - before)
    assert 0 < sizes[1] < 5 * sizes[0]


def test_joined_names_are_taken_apart_by_other_names(spark):
    rows = [(1, "x", "beatricelomander"), (2, "x", "beatrice trovalen"), (3, "y", "harold lomander"), (4, "y", "lomanderx"), (5, "y", "j r smith"), (6, "y", "ann b smith")]
    got = {r.s: r.words for r in names.words_apart(spark.createDataFrame(rows, "s long, block string, name string")).collect()}
    assert got == {1: "beatrice lomander", 2: "beatrice trovalen", 3: "harold lomander", 4: "lomanderx", 5: "smith j", 6: "ann smith"}


def test_average_linkage_needs_the_average():
    import pandas as pd

    chain = pd.DataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9)], columns=["a", "b", "score"])
    groups = names.average_linkage(chain, 0.6).groupby("cluster").s.apply(set).tolist()
    assert groups == [{1, 2}, {3, 4}]


def test_large_components_are_split_by_their_weakest_links(spark):
    links = spark.createDataFrame([(i, i + 1, 0.95 if i % 2 else 0.65) for i in range(1, 20)], "a long, b long, score double")
    got = {r.s: r.cluster for r in names.clusters(links, 0.6, component_limit=4).collect()}
    assert all(got[i] == got[i + 1] for i in range(1, 20, 2))


def test_clusters_do_not_depend_on_the_component_limit(spark):
    import pandas as pd

    rnd = random.Random(3)
    rows = [(1000, 1001, 0.95), (1000, 1002, 0.9), (1001, 1002, 0.45), (1002, 1003, 0.41)]
    rows += [(a, b, rnd.choice([0.4, 0.45, 0.57, 0.6, 0.65, 0.8, 0.8, 0.9, 0.95])) for a in range(10) for b in range(a + 1, 10) if a // 5 == b // 5 or rnd.random() < 0.1]
    want = {r.s: r.cluster for r in names.average_linkage(pd.DataFrame(rows, columns=["a", "b", "score"]), 0.6).itertuples()}
    links = spark.createDataFrame(rows, "a long, b long, score double")
    assert want[1000] == want[1001] == want[1002] != want[1003]
    for limit in (1000, 3):
        assert {r.s: r.cluster for r in names.clusters(links, 0.6, component_limit=limit).collect()} == want


# Sentences

CASES = [
    "It came on time. It works!| Would I buy it again?",
    "Mr. A. S. Bell from Oak Inc. called me back.| We live on St. Bell Street.",
    "The parcel came at 5 a.m. on a Monday.| The second came at 8 p.m. |Really?!",
    'He said "it\'s fine." and left.| "It broke again!" shouted our neighbour.| Then it was quiet.',
    "It costs 3.50 euros, cf. p. 20 of the manual.| See fig. 3.| 🎉",
    "Works great. 👍| Fine :-)",
    "Well, hmm ... it is slow.| What a lamp... absolutely quiet!",
    "Der 2. Versuch am 14. März klappte, vgl. Abb. 27.| Am 3. kam z. B. nichts.",
    "Está bien.| ¿De verdad?, pensé, ¿tan malo?| «¡No funciona!», gritó.",
    "C'est bien.| « Encore ? » fut sa réaction.| M. Duval l'a reçu à 8 h. 30 précises.",
    "这个很好。|“怎么又坏了？”弟弟喊道。|型号是A.12-3，不是那款。|真的？！|（也看过了。）|好吧……算了。",
    "「また壊れたの？」と弟が言いました。|とても静かです。|「はい……」とだけ返事が来ました。",
    "ส่งไวดีค่ะ |ราคา 346.00 บาทถือว่าคุ้มค่ะ |เบาจริงๆ ไม่ผิดหวังครับ",
    "यह ठीक है।| मॉडल सं. 39 का वज़न 5 कि. ग्रा. है।| क्या सच में?",
    "هذا جيد. |قال البائع «لا مشكلة.» ثم اختفى. |هل هذا معقول؟",
    "First line.Second sentence here.|Open readme.txt now.",
    "Title without mark\n\n|A wrapped\nsentence.| Another.\n|- one. two\n|- three\n|1. four",
]


@pytest.mark.parametrize("case", CASES[:4] + CASES[6:15] + CASES[16:])
def test_sentence_boundaries(case):
    parts = case.split("|")
    text = "".join(parts)
    got = [text[s:e] for s, e in sentences.sentences(text)]
    want = [p.strip() for p in parts]
    if "It works!" in case:
        want = ["It came on time.", "It works!", "Would I buy it again?"]
    assert got == want


@pytest.mark.parametrize("times", [2, 400])
def test_quotes_of_any_length_do_not_split(times):
    speech = "It broke again. Why? " * times
    text = f'He shouted "{speech.strip()}" and left the shop. It was quiet (we thought so. {speech.strip()}) at last. A 5" screen is small. Fine.'
    assert [text[s:e][-12:] for s, e in sentences.sentences(text)] == ["ft the shop.", text[: text.index(" A 5")][-12:], "en is small.", "Fine."]


def test_a_lexicon_is_learnt_from_all_texts(spark):
    thai = ["ราคาถูกค่ะ", "ราคา 5 บาทครับ", "ซิปพังครับ", "ซิปดีค่ะ", "ราคาแพงนะคะ", "ซิปขาดค่ะ"]
    texts = [f"{a} {b}" for a in thai for b in thai] * 3 + ["My Zing! lamp is dead.", "The Zing! hums.", "A Zing! lamp again.", "Really! It is"] + ["Delivery was late!\nDelivery took ages."] * 6
    lexicon = sentences.learn(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    assert {"ราคา", "ซิป"} <= lexicon.openers and lexicon.exclaimed == {"zing"} and "delivery" in lexicon.starters
    cut = lambda t: [t[s:e] for s, e in sentences.sentences(t, lexicon)]
    assert cut("ซิปพังครับราคาถูกค่ะ") == ["ซิปพังครับ", "ราคาถูกค่ะ"]
    assert cut("the zing! lamp is dead") == ["the zing! lamp is dead"] and cut("it works! lamp is dead") == ["it works!", "lamp is dead"]
    assert sentences.learn(spark.createDataFrame([], "text string")) == sentences.Lexicon()


def test_time_is_linear_in_the_text():
    import time

    for part in ("It is good. Why? ", "a.", '"a. b" ', "(a. ", "ส่งไวดีค่ะราคา ", "“怎么又坏了？”弟弟喊道。", "one\n"):
        took = []
        for size in (20_000, 160_000):
            began = time.process_time()
            sentences.sentences(part * (size // len(part)))
            took.append(time.process_time() - began)
        assert took[1] < 20 * took[0] + 1


def test_trailing_emoji_and_glued_sentences():
    cut = lambda t: [t[s:e] for s, e in sentences.sentences(t)]
    assert cut("Works great. 👍 Fine. :-) Good") == ["Works great. 👍", "Fine. :-)", "Good"]
    assert cut("First line.Second sentence here.Open readme.txt now.") == ["First line.", "Second sentence here.", "Open readme.txt now."]
    assert cut("...!?") == ["...!?"] and cut("﻿  ok  ") == ["ok"]


def test_sentences_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  ﻿\n"), (4, "a. " * 30_000), (5, "One. Two."), (5, "One. Two.")]
    got = sentences.split_table(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start_pos int")).collect()
    assert {r.doc_id for r in got} == {4, 5} and sum(r.doc_id == 5 for r in got) == 4
    assert sentences.split_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_offsets_are_trimmed_ordered_and_apart():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "Bc", " ", ".", "!", "?", "\n", "\"", "(", ")", "。", "「", "」", "ค่ะ", " 1", "…", "👍", "\r\n\r\n", "- "]) for _ in range(40))
        end = 0
        for s, e in sentences.sentences(text):
            assert end <= s < e and text[s:e] == text[s:e].strip()
            end = e
        covered = "".join(text[s:e] for s, e in sentences.sentences(text))
        assert [c for c in covered if not c.isspace()] == [c for c in text if not c.isspace()]


# SQL


def test_sql_of_the_queries(spark, data):
    from compare import compare

    from arbora.llm import queries

    for name, sql in queries.ORACLES.items():
        ok, said = compare(spark, queries.QUERIES[name], sql, data)
        assert ok, f"{name}: {said}"
