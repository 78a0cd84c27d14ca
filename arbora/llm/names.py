"""Variant spellings of people's names at one organisation, by n-gram vectors, a sparse cosine join and average linkage.

1. Companies are mapped to the canonical list; those it does not have are grouped by steps 3 and 4 on their own vectors.
   Either gives the *block* within which names are compared.
2. Equal cleaned names of one block are one *spelling*, however many accounts have it. A name written as one word is taken
   apart where both parts are words of other names.
3. A spelling's vector holds the n-grams of its words, nicknames written out, each also marked with the initial of the
   other word: so "B. Lomander" is close to "Beatrice Lomander" and far from "Harold Lomander". Weights are inverse
   frequencies over all spellings. All pairs of a block with cosine at least ``COSINE`` are found: its spellings are dealt
   to slices, and each two slices meet in a task that adds up the products of their n-grams in memory. Only pairs that
   reach ``COSINE`` are written. There is no top-n cut: it would lose links.
4. The pairs form components, and each is clustered by average linkage of the exact cosines, pairs below ``COSINE``
   counting 0.
5. A check follows on the links within clusters: the words must align as surname and given name (typo, nickname, initial),
   and what aligns too badly on average falls out of its cluster.

Only step 4 gathers a group: the spellings, not the accounts, of one component. Components above ``component_limit`` are
merged in distributed rounds, with the same result, until they fall into smaller ones.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.canonical import BROADCAST_LIMIT, LEGAL_FORMS, SMALL_WORDS, distance, mapped, tokens, usable
from arbora.operators.graph import components
from arbora.runtime import cut, release, small

#: Cosine of a link between names, and between companies: also what clusters must reach on average.
COSINE, COMPANY_COSINE = 0.15, 0.35
#: Least score of a checked link, and what checked clusters must reach on average.
LINK, CHECKED = 0.4, 0.45
#: Share of the unmarked n-grams in a vector.
PLAIN = 0.25
#: Scores are added up as integers of this unit, so that no order of adding changes an average.
UNITS = 1_000_000
#: Clusters of one component that are merged in one task, and links that are without being told apart by components.
COMPONENT_LIMIT, FEW_LINKS = 1000, 5000
#: n-grams up to which their weights are sent to all tasks, and that a task counts before it gives them out.
GRAM_LIMIT, PART_GRAMS = 1_000_000, 300_000
#: Texts of a slice, squares of a block's size for each task and tasks at most, and products that are added up at once.
SLICE, TASK_PAIRS, MOST_TASKS, PRODUCTS = 8192, 20_000_000, 4000, 2_000_000

# Titles and degrees beside a name.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "phd", "msc", "bsc", "md", "mba", "jr", "sr", "esq", "ing", "mx"}
# Usual English nicknames by given name.
NICKNAMES = {
    "abigail": "abby gail", "albert": "al bert", "alexander": "alex al sandy xander", "alexandra": "alex sandra lexi", "alfred": "al fred alfie",
    "amanda": "mandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs barbie", "beatrice": "bea trixie", "benjamin": "ben benji benny",
    "catherine": "cathy cat kate katie kitty", "charles": "charlie chuck chas", "christina": "chris tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donnie", "dorothy": "dot dottie", "douglas": "doug dougie",
    "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty lizzie eliza betsy libby", "frances": "fran fanny", "francesca": "fran frankie chess",
    "francis": "frank fran", "frederick": "fred freddie freddy rick", "gabriella": "gabby gabi ella", "gerald": "gerry jerry", "gregory": "greg", "harold": "harry hal",
    "henrietta": "hettie etta hetty", "henry": "harry hank hal", "ignatius": "iggy nate", "isabella": "bella izzy isa belle", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny jenn", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon jonny john nathan", "joseph": "joe joey", "joshua": "josh",
    "katherine": "kate kathy katie kat kit", "kenneth": "ken kenny", "kimberly": "kim kimmy", "lawrence": "larry laurie", "leonard": "len lenny leo", "lillian": "lily lil",
    "margaret": "peggy maggie meg marge", "matthew": "matt matty", "michael": "mike mick mickey", "natalie": "nat nattie", "nathaniel": "nat nate nathan", "nicholas": "nick nicky",
    "octavia": "tavi tavy", "oliver": "ollie olly", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip",
    "philippa": "pippa pip", "rebecca": "becky becca", "richard": "dick rick rich richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samantha": "sam sammy",
    "samuel": "sam sammy", "sarah": "sally", "stephanie": "steph stevie", "stephen": "steve", "steven": "steve", "susan": "sue suzy", "theodora": "thea dora theo",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic", "vincent": "vince vin vinny", "walter": "walt wally",
    "william": "will bill billy willie", "winifred": "winnie freda fred", "zachary": "zach zack", "zenobia": "zena",
}
# Words that say there is no organisation.
NO_COMPANY = {
    "na", "none", "no", "nil", "null", "self", "employed", "selfemployed", "freelance", "freelancer", "student", "unemployed", "retired", "myself", "me",
    "looking", "for", "work", "currently", "between", "jobs", "on", "sabbatical", "stealth", "startup", "n", "a", "nothing", "nowhere", "home", "independent", "private",
}
# Words of a post or a remark beside a company.
ROLE_WORDS = {"working", "for", "at", "dev", "developer", "cto", "ceo", "cfo", "intern", "senior", "junior", "lead", "staff", "engineer", "manager", "hiring", "platform", "team", "remote", "ex", "consultant", "founder"}

ROOTS: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    ROOTS.setdefault(_full, set()).add(_full)
    for _n in _short.split():
        ROOTS.setdefault(_n, set()).add(_full)


def name_tokens(name: str) -> list[str]:
    """Words of a name: case, marks, titles, degrees, bracketed remarks and signs removed."""
    words = tokens(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name))[0]
    return [w for w in words if w not in TITLES and not w.isdigit()]


def company_tokens(company: str) -> list[str]:
    """Words of a company name without posts, remarks and legal forms; empty where no organisation is named."""
    words = [w for w in tokens(company)[0]]
    kept = [w for w in words if w not in ROLE_WORDS and not (w in LEGAL_FORMS and w != words[0])]
    return [] if all(w in NO_COMPANY for w in kept) else kept


def bound(length: int) -> float:
    return 0.0 if length < 3 else 1.0 if length < 7 else 1.9


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """1 for equal words, less for each edit; one edit beyond the bound for their length is weak evidence, more is none."""
    if a == b:
        return 1.0
    most = bound(min(len(a), len(b)))
    cost = distance(a, b, most + 1.0) if most else float("inf")
    return 1.0 - 0.12 * cost if cost <= most else 0.45 if cost <= most + 1.0 else 0.0


@lru_cache(maxsize=200_000)
def given_likeness(a: str, b: str) -> float:
    """Likeness of two given names, nicknames and initials included."""
    if len(a) == 1 or len(b) == 1:
        first = {x[0] for x in (ROOTS.get(a, set()) | {a})} & {x[0] for x in (ROOTS.get(b, set()) | {b})}
        return 0.8 if first else 0.0
    if ROOTS.get(a, {a}) & ROOTS.get(b, {b}):
        return 1.0 if a == b else 0.95
    direct = likeness(a, b)
    if direct:
        return direct
    short, long = (a, b) if a in ROOTS and a not in NICKNAMES else (b, a)
    return max((0.9 * likeness(r, long) for r in ROOTS.get(short, ())), default=0.0)


def joined_likeness(tight: str, words: list[str]) -> float:
    """Likeness of a name written as one word to one in several."""
    if len(words) < 2:
        return likeness(tight, words[0]) if words else 0.0
    best = 0.0
    for family in (words[-1], words[0]):
        for given in (words[0], words[-1]):
            if given is family or len(family) < 3:
                continue
            forms = {given} | ROOTS.get(given, set()) | set(NICKNAMES.get(given, "").split())
            for g in forms:
                value = 1.0 if g == given else 0.93
                best = max(best, value * likeness(tight, g + family), value * likeness(tight, family + g))
    return best


def name_likeness(a: list[str], b: list[str]) -> float:
    """Score of two names given as words: every way to take one word of each as surname and another as given name."""
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return joined_likeness(one[0], other) if len(one[0]) >= 6 else 0.0
    best = 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            family = likeness(x, y) if len(x) > 2 and len(y) > 2 else 0.0
            if not family or x in NICKNAMES or y in NICKNAMES:
                continue
            ga, gb = a[:i] + a[i + 1 :], b[:j] + b[j + 1 :]
            # A given name stands first or last; a single letter before a longer word is the initial of a second name.
            la, lb = [w for w in ga if len(w) > 1] or ga[:1], [w for w in gb if len(w) > 1] or gb[:1]
            given = max(given_likeness(p, q) for p in la for q in lb)
            best = max(best, family * given)
    return best


def company_likeness(a: list[str], b: list[str]) -> float:
    """Score of two unlisted companies: the same words in any order, shortened, run together, or the first word alone."""
    if not a or not b:
        return 0.0
    ta, tb = "".join(a), "".join(b)
    best = likeness(ta, tb)
    if len(a) > 1:
        best = max(best, likeness("".join(a[1:] + a[:1]), tb))
    short, long = sorted((a, b), key=len)
    if len(short) == 1 and len(short[0]) >= 5:
        best = max(best, 0.95 * max(likeness(short[0], w) for w in long if w == long[0] or len(w) >= 5))
    if len(short) == len(long):
        same = [max(likeness(x, y) or (0.9 if len(x) >= 3 and y.startswith(x) or len(y) >= 3 and x.startswith(y) else 0.0) for y in long) for x in short]
        best = max(best, min(same))
    main = [w for w in long if w not in SMALL_WORDS]
    if len(main) > 2 and short[0] in ("".join(w[0] for w in main), "".join(w[0] for w in long)):
        best = max(best, 0.9)
    return best


def grams(word: str) -> list[str]:
    x = f"^{word}$"
    return [x[i : i + 3] for i in range(len(x) - 2)]


def written_out(word: str) -> list[str]:
    """The given names a nickname stands for, else the word."""
    return sorted(ROOTS.get(word, {word}))


def name_vector(words: list[str]) -> dict[str, float]:
    """n-gram counts of a name of one or two words before they are weighted by frequency."""
    out: dict[str, float] = {}
    forms = [written_out(w) for w in words]
    for i, own in enumerate(forms):
        for form in own:
            share = len(own) ** -0.5
            out[f"1:{form[0]}"] = out.get(f"1:{form[0]}", 0.0) + PLAIN * share
            if len(form) == 1:
                continue
            for g in grams(form):
                out[g] = out.get(g, 0.0) + PLAIN * share
                for other in (f for j, fs in enumerate(forms) if j != i for f in fs):
                    marked = f"{other[0]}:{g}"
                    out[marked] = out.get(marked, 0.0) + share * len([f for fs in forms[:i] + forms[i + 1 :] for f in fs]) ** -0.5
    return out


def company_vector(words: list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for w in words:
        for g in grams(w):
            out[g] = out.get(g, 0.0) + 1.0
    return out


def main_words(words: list[str]) -> list[str]:
    """The words of a name without initials of second names."""
    full = [w for w in words if len(w) > 1]
    return full if len(full) > 1 else full + [w for w in words if len(w) == 1][:1]


def _cleaned(clean):
    """Column 0 through, column 1 as cleaned words in one string; rows without any are left out."""

    def run(batches):
        for b in batches:
            texts = [" ".join(clean(v)) for v in b.column(1).to_pylist()]
            keep = pa.array([bool(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([t for t in texts if t], pa.string())], names=["v", "clean"])

    return run


def _vectors(vector):
    def run(batches):
        for b in batches:
            ids, feats, counts = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = vector(text.split(" "))
                ids += [i] * len(v)
                feats += v.keys()
                counts += v.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(feats, pa.string()), pa.array(counts, pa.float64())], names=["s", "g", "k"])

    return run


def _gram_counts(vector):
    """(g, n): in how many of a partition's texts (column 0) an n-gram stands; given out in parts where there are many."""

    def given(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["g", "n"])

    def run(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(vector(text.split(" ")).keys())
            if len(seen) > PART_GRAMS:
                yield given(seen)
                seen.clear()
        yield given(seen)

    return run


def words_apart(spelt: DataFrame) -> DataFrame:
    """``spelt`` (s, block, name) with column words: the name's main words, a single one taken apart into two words of other
    names where there are such: of several ways the one whose rarer word is most frequent, then the earliest."""

    def split(batches):
        for b in batches:
            at, heads, tails = [], [], []
            for i, w in enumerate(b.column(1).to_pylist()):
                for n in range(3, len(w) - 2):
                    at.append(i)
                    heads.append(w[:n])
                    tails.append(w[n:])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(heads, pa.string()), pa.array(tails, pa.string())], names=["s", "head", "tail"])

    def main(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([" ".join(main_words(n.split(" "))) for n in b.column(2).to_pylist()], pa.string())], names=["s", "block", "name", "words"])

    named = spelt.mapInArrow(main, "s long, block string, name string, words string")
    known = named.where("words like '% %'").select(F.explode(F.split("words", " ")).alias("w")).where("length(w) > 2").groupBy("w").agg(F.count("*").alias("n"))
    known = small(cut(known))
    ways = named.where("words not like '% %' and length(words) >= 6").select("s", "words").mapInArrow(split, "s long, head string, tail string")
    ways = ways.join(known.select(F.col("w").alias("head"), F.col("n").alias("hn")), "head").join(known.select(F.col("w").alias("tail"), F.col("n").alias("tn")), "tail")
    best = ways.groupBy("s").agg(F.min(F.struct((-F.least("hn", "tn")).alias("r"), F.length("head").alias("l"), F.concat_ws(" ", "head", "tail").alias("apart"))).getField("apart").alias("apart"))
    return named.join(best, "s", "left").select("s", "block", "name", F.coalesce("apart", "words").alias("words"))


class Weights:
    """The place of each n-gram in their order, and its weight: the inverse frequency over all texts."""

    def __init__(self, counted: pa.Table, total: int):
        self.grams, self.weight = counted.column("g").combine_chunks(), gram_weight(counted.column("df").to_numpy(), total)
        self.place: dict[str, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"place": None}

    def places(self) -> dict[str, int]:
        """Made once in each Python worker."""
        if self.place is None:
            self.place = {g: i for i, g in enumerate(self.grams.to_pylist())}
        return self.place


def gram_weight(df: np.ndarray, total: int) -> np.ndarray:
    return np.log((total + 1.0) / df)


def _weighed_words(vector, sent):
    def weighed(held: pa.Table):
        weights = sent.value
        place, rows, at, counts = weights.places(), [], [], []
        for text in held.column("words").to_pylist():
            v = vector(text.split(" "))
            rows.append(len(v))
            at += [place[g] for g in v]
            counts += v.values()
        at = np.array(at, np.int64)
        return np.repeat(np.arange(len(rows)), rows), at, np.array(counts, np.float64) * weights.weight[at]

    return weighed


def _weighed_lists(total: int):
    def weighed(held: pa.Table):
        lists = held.column("grams").combine_chunks()
        sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
        grams = pc.rank(flat.field("g"), tiebreaker="dense").to_numpy().astype(np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), grams, flat.field("k").to_numpy() * gram_weight(flat.field("df").to_numpy(), total)

    return weighed


def _products(left: tuple, right: tuple | None, width: int, least: float):
    """(rows of left, rows of right, cosines) of all pairs that reach ``least``; right None: all pairs within left, once.

    A side is (row, key, x), sorted by row and key; rows are below ``width``. Products are added up in the order of the keys,
    whatever the pieces they are taken in, so a pair has the same cosine in any of them.
    """
    row, key, x = left
    there, keys, xs = left if right is None else right
    order = np.lexsort((there, keys))
    keys, there, xs = keys[order], there[order], xs[order]
    to = np.searchsorted(keys, key, "right")
    if right is None:
        start = np.empty(len(order), np.int64)  # behind the entry itself: each pair once
        start[order] = np.arange(1, len(order) + 1)
    else:
        start = np.searchsorted(keys, key, "left")
    many = to - start
    kept = many > 0
    row, x, start, many = row[kept], x[kept], start[kept], many[kept]
    ends = np.cumsum(many)
    at = 0
    while at < len(row):
        # Whole rows of left up to the products and sums that one piece may have, one row at least.
        most = min(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right"), np.searchsorted(row, row[at] + max(1, PRODUCTS // width), "left"))
        stop = np.searchsorted(row, row[most], "left") if most < len(row) else most
        stop = stop if stop > at else np.searchsorted(row, row[at], "right")
        n, first = many[at:stop], row[at]
        offset = np.cumsum(n)
        entry = np.repeat(start[at:stop] - offset + n, n) + np.arange(offset[-1])
        pair = np.repeat((row[at:stop] - first) * width, n) + there[entry]
        product = np.repeat(x[at:stop], n) * xs[entry]
        if len(pair) * 8 < (row[stop - 1] - first + 1) * width:
            pair, place = np.unique(pair, return_inverse=True)
            total = np.bincount(place, product)
            hit = np.flatnonzero(total >= least)
            pair, total = pair[hit], total[hit]
        else:
            total = np.bincount(pair, product)
            pair = np.flatnonzero(total >= least)
            total = total[pair]
        yield pair // width + first, pair % width, total
        at = stop


def _cell_links(weighed, least: float):
    """(a, b, score) of the cells in a partition sorted by them, whole ones at a time. Columns: s, cell, i, j (the two slices
    that meet in the cell), own (the row's slice), and what ``weighed`` makes (text number, n-gram, weight) of."""

    def linked(held: pa.Table):
        s, cell, i, j, own = (held.column(c).to_numpy() for c in ("s", "cell", "i", "j", "own"))
        row, gram, x = weighed(held)
        # The n-grams of several cells are apart; for all rows they stand in one order.
        key = cell_number(cell, i, j)[row] * (gram.max() + 1 if len(gram) else 1) + gram
        order = np.lexsort((key, row))
        row, key, x = row[order], key[order], x[order]
        norm = np.sqrt(np.bincount(row, x * x, len(s)))
        x = x / norm[row]
        # A cell of one slice with itself holds each pair once, one of two slices those across.
        same, first = (i == j)[row], (own == i)[row]
        side = lambda m: (row[m], key[m], x[m])
        for left, right in ((side(same), None), (side(~same & first), side(~same & ~first))):
            for one, two, score in _products(left, right, len(s), least):
                one, two = s[one], s[two]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(score)], names=["a", "b", "score"])

    def cell_number(*columns):
        change = np.zeros(len(columns[0]), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        return np.cumsum(change)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cells = cell_number(*(b.column(b.schema.names.index(c)).to_numpy() for c in ("cell", "i", "j")))
            begin = int(np.searchsorted(cells, cells[-1]))  # where the last cell begins, which may go on
            last = lambda x, at: tuple(x.column(x.schema.names.index(c))[at].as_py() for c in ("cell", "i", "j"))
            if held and last(held[-1], held[-1].num_rows - 1) != last(b, 0):
                yield from linked(pa.Table.from_batches(held))
                held = []
            if begin:
                yield from linked(pa.Table.from_batches([*held, b.slice(0, begin)]))
                held = []
            held.append(b.slice(begin))
        if held:
            yield from linked(pa.Table.from_batches(held))

    return run


def cosine_links(rows: DataFrame, vector, least: float, gram_limit: int = GRAM_LIMIT, slice_rows: int = SLICE) -> DataFrame:
    """(a, b, score), a < b: all pairs of the ``rows`` (s, block, words) of one block with exact cosine at least ``least``.

    A block's texts are dealt to slices, and each two slices meet in a task, which adds up the products of their n-grams in
    memory: pairs below ``least`` and the n-grams themselves are never written. Up to ``gram_limit`` n-grams their weights go
    to all tasks, which make the vectors from the texts; beyond it each text is joined to its weights. Neither limit changes
    the result.
    """
    counted = cut(rows.select("words").mapInArrow(_gram_counts(vector), "g string, n long").groupBy("g").agg(F.sum("n").alias("df")))
    total, few = rows.count(), counted.limit(gram_limit + 1).count() <= gram_limit
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    sizes = cut(rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.monotonically_increasing_id().alias("cell"), slices.alias("slices"), "n"))
    texts, sent = rows.select("s", "block", "words"), None
    if few:
        sent = rows.sparkSession.sparkContext.broadcast(Weights(counted.orderBy("g").toArrow(), total))
    else:
        feats = rows.select("s", "words").mapInArrow(_vectors(vector), "s long, g string, k double").join(counted, "g")
        listed = feats.groupBy("s").agg(F.collect_list(F.struct("g", "k", "df")).alias("grams"))
        texts = texts.select("s", "block").join(listed, "s")
    placed = texts.join(small(sizes.drop("n")), "block").withColumn("own", F.pmod(F.xxhash64("s"), F.col("slices")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = other.select("s", "words" if few else "grams", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    # As many tasks as the pairs ask for, whatever the size in bytes.
    tasks = max(_tasks(rows), (sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) // TASK_PAIRS)
    dealt = met.repartition(min(tasks, MOST_TASKS), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    out = cut(dealt.mapInArrow(_cell_links(_weighed_words(vector, sent) if few else _weighed_lists(total), least), "a long, b long, score double"))
    release(counted, sizes)
    if sent:
        sent.destroy()
    return out


def average_linkage(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Clusters by the links (a, b, score): merge the closest pair of clusters while the average score over all their pairs,
    0 for those without a link, is at least ``least``. Ties go to the smaller ids. Components do not touch each other, so
    several can be given at once.

    With columns na and nb, a and b are clusters of so many spellings and score the sum over their pairs.
    """
    least = round(least * UNITS)
    nodes = sorted(set(pdf.a) | set(pdf.b))
    at = {s: i for i, s in enumerate(nodes)}
    groups = {i: [i] for i in range(len(nodes))}
    sizes = dict.fromkeys(groups, 1)
    between: dict[int, dict[int, int]] = {i: {} for i in groups}
    for a, b, score in zip(pdf.a, pdf.b, pdf.score):
        between[at[a]][at[b]] = between[at[b]][at[a]] = round(score * UNITS) if "na" not in pdf else int(score)
    if "na" in pdf:
        sizes |= {at[s]: n for s, n in zip(pdf.a, pdf.na)} | {at[s]: n for s, n in zip(pdf.b, pdf.nb)}
    # Entries of the heap are outdated once their total has changed.
    heap = [(-total / (sizes[i] * sizes[j]), i, j, total) for i, row in between.items() for j, total in row.items() if i < j and total >= least * sizes[i] * sizes[j]]
    heapq.heapify(heap)
    while heap:
        _, i, j, total = heapq.heappop(heap)
        if i not in groups or between[i].get(j) != total or total < least * sizes[i] * sizes[j]:
            continue
        groups[i] += groups.pop(j)
        sizes[i] += sizes.pop(j)
        for k, more in between.pop(j).items():
            del between[k][j]
            if k != i:
                between[i][k] = between[k][i] = between[i].get(k, 0) + more
        for k, more in between[i].items():
            if more >= least * sizes[i] * sizes[k]:
                heapq.heappush(heap, (-more / (sizes[i] * sizes[k]), min(i, k), max(i, k), more))
    return pd.DataFrame([(nodes[m], nodes[min(g)]) for g in groups.values() for m in g], columns=["s", "cluster"]).astype("int64")


def _merge_round(pairs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, merged): the clusters' links (a, b, na, nb, score) after all pairs that are the closest to each other have
    merged, and what became of every cluster (s, cluster, size).

    An average over two merged clusters is never above both averages before, so such a pair would also merge, unchanged,
    if the closest pair of all were merged first: the clusters are those of ``average_linkage``.
    """
    close = pairs.where(F.col("score") >= least * F.col("na") * F.col("nb"))
    rank = F.struct((-F.col("score") / (F.col("na") * F.col("nb"))).alias("far"), "a", "b")
    both = close.select(F.col("a").alias("s"), rank.alias("r")).unionByName(close.select(F.col("b").alias("s"), rank.alias("r")))
    best = both.groupBy("s").agg(F.min("r").alias("r"))
    mutual = best.groupBy(F.col("r.a").alias("keep"), F.col("r.b").alias("gone")).agg(F.count("*").alias("n")).where("n = 2").select("keep", "gone")
    sizes = pairs.select(F.col("a").alias("s"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("s"), F.col("nb").alias("n"))).distinct()
    named = sizes.join(mutual, F.col("s") == F.col("gone"), "left").select("s", "n", F.coalesce("keep", "s").alias("cluster"))
    grown = named.groupBy("cluster").agg(F.sum("n").alias("size"))
    merged = cut(named.join(grown, "cluster").select("s", "cluster", "size"))
    left, right = merged.select(F.col("s").alias("a"), F.col("cluster").alias("ca"), F.col("size").alias("na")), merged.select(F.col("s").alias("b"), F.col("cluster").alias("cb"), F.col("size").alias("nb"))
    renamed = pairs.select("a", "b", "score").join(left, "a").join(right, "b").where("ca <> cb")
    turned = F.col("ca") > F.col("cb")
    ends = {"a": F.least("ca", "cb"), "b": F.greatest("ca", "cb"), "na": F.when(turned, F.col("nb")).otherwise(F.col("na")), "nb": F.when(turned, F.col("na")).otherwise(F.col("nb"))}
    return cut(renamed.select(*[c.alias(n) for n, c in ends.items()], "score").groupBy(*ends).agg(F.sum("score").alias("score"))), merged


def clusters(found: DataFrame, least: float, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """(s, cluster) of all spellings with links (a, b, score), by average linkage; ``component_limit`` does not change the
    result.

    Two clusters merge only if some link between them reaches ``least``, so the components of such links are apart, each
    with all its links. Components above the limit merge in rounds over the whole table until they fall into smaller ones.
    """
    floor = round(least * UNITS)
    pairs = cut(found.select("a", "b", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"), F.round(F.col("score") * UNITS).cast("long").alias("score")))
    if component_limit >= COMPONENT_LIMIT and pairs.count() <= FEW_LINKS:
        placed = cut(pairs.withColumn("component", F.lit(0)).repartition(1).mapInPandas(_linked(least), "s long, cluster long"))
        release(pairs)
        return placed
    placed = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("s")), F.struct(F.col("b").alias("s"))))).distinct().select("s", F.col("s").alias("cluster"))
    done: list[DataFrame] = []
    while True:
        close = pairs.where(F.col("score") >= floor * F.col("na") * F.col("nb"))
        ends = close.select(F.inline(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))).distinct()
        labelled = cut(components(ends, close.select(F.col("a").alias("from_user_id"), F.col("b").alias("to_user_id"))))
        one, two = labelled.select(F.col("id").alias("a"), "component"), labelled.select(F.col("id").alias("b"), F.col("component").alias("other"))
        tagged = pairs.join(one, "a").join(two, "b").where("component = other").drop("other")
        big = labelled.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > component_limit).select("component")
        none = big.isEmpty()
        if not none:
            tagged, big = cut(tagged), cut(big)
        ready = tagged if none else tagged.join(big, "component", "left_anti")
        # So many tasks whatever the size in bytes: the work is per link.
        spread = ready.repartition(_tasks(found), "component").sortWithinPartitions("component")
        placed = _follow(placed, spread.mapInPandas(_linked(least), "s long, cluster long"))
        release(labelled, pairs, *done)
        if none:
            return placed
        done = [placed]
        pairs, merged = _merge_round(tagged.join(big, "component", "left_semi").drop("component"), floor)
        placed = _follow(placed, merged)
        release(merged, tagged, big, *done)
        done = [placed]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _linked(least: float):
    """Average linkage of the components in a partition sorted by them, as many whole ones at once as a batch holds."""

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf.component == pdf.component.iloc[-1] if len(pdf) else pdf.component == 0
            held = pdf[last]
            if not last.all():
                yield average_linkage(pdf[~last], least)
        if held is not None and len(held):
            yield average_linkage(held, least)

    return run


def _follow(placed: DataFrame, merged: DataFrame) -> DataFrame:
    """``placed`` (s, cluster) after its clusters have become those of ``merged`` (s, cluster)."""
    to = merged.select(F.col("s").alias("was"), F.col("cluster").alias("now"))
    return cut(placed.join(to, F.col("cluster") == F.col("was"), "left").select("s", F.coalesce("now", "cluster").alias("cluster")))


def _aligned(score):
    def run(batches):
        for b in batches:
            scores = [score(x.split(" "), y.split(" ")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array([s >= LINK for s in scores], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(scores, pa.float64()).filter(keep)], names=["a", "b", "score"])

    return run


def linked(rows: DataFrame, vector, least: float, score, component_limit: int) -> DataFrame:
    """(s, cluster) of the ``rows`` (s, block, text, words) that have a variant: cosine links of the words, average linkage,
    then the links within clusters checked by ``score`` of the texts and what fails on average split off."""
    links = cosine_links(rows, vector, least)
    found = clusters(links, least, component_limit)
    one, two = found.select(F.col("s").alias("a"), F.col("cluster").alias("ca")), found.select(F.col("s").alias("b"), F.col("cluster").alias("cb"))
    within = links.join(one, "a").join(two, "b").where("ca = cb").select("a", "b")
    texts = rows.select("s", "text")
    paired = within.join(texts.withColumnsRenamed({"s": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"s": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
    spread = paired.repartition(_tasks(rows))  # so many tasks whatever the size in bytes: the work is per pair
    checked = clusters(spread.mapInArrow(_aligned(score), "a long, b long, score double"), CHECKED, component_limit)
    release(links, found)
    return checked


def blocks(companies: DataFrame, canonical: DataFrame, broadcast_limit: int = BROADCAST_LIMIT, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """(company, block): the organisation each of the ``companies`` (company, n) means, in the canonical list or else by
    likeness to others; none for texts that name no organisation."""
    known = cut(mapped(companies.select(F.lit("company").alias("field"), F.col("company").alias("v"), "n"), usable(canonical, ["company"]), broadcast_limit))
    listed = known.where("ref_id <> 0").select(F.col("v").alias("company"), F.concat(F.lit("listed "), F.col("ref_id").cast("string")).alias("block"))
    firms = cut(known.where("ref_id = 0").select("v", F.col("v").alias("w")).mapInArrow(_cleaned(company_tokens), "v string, clean string"))
    distinct = cut(firms.select(F.lit("").alias("block"), F.col("clean").alias("text")).distinct().withColumn("s", F.monotonically_increasing_id()))
    grouped = linked(distinct.withColumn("words", F.col("text")), company_vector, COMPANY_COSINE, company_likeness, component_limit)
    named = distinct.join(grouped, "s", "left").select(F.col("text").alias("clean"), F.concat(F.lit("other "), F.coalesce("cluster", "s").cast("string")).alias("block"))
    return listed.unionByName(firms.join(named, "clean").select(F.col("v").alias("company"), "block"))


def same_person(profiles: DataFrame, canonical: DataFrame, broadcast_limit: int = BROADCAST_LIMIT, component_limit: int = COMPONENT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(members: user_id, person), and the spellings behind them: who is the same person at the same organisation.

    Accounts without a name or company, or with a company that names no organisation, are left out. Repeated rows count
    once. Equal spellings are one person; person is an id without meaning.
    """
    rows = profiles.select(F.col("user_id").cast("long").alias("user_id"), F.col("name").alias("typed"), "company")
    rows = cut(rows.where("user_id is not null and typed is not null and company is not null").distinct())
    # Cut first: a repartition right behind a grouping by the same column would be planned away, and its tasks with it.
    companies = cut(rows.groupBy("company").agg(F.count("*").alias("n")))
    block = cut(blocks(companies, canonical, broadcast_limit, component_limit))
    name = cut(rows.select("typed", F.col("typed").alias("w")).distinct().mapInArrow(_cleaned(name_tokens), "v string, clean string"))
    accounts = cut(rows.join(small(block), "company").join(name, F.col("typed") == F.col("v")).select("user_id", "block", F.col("clean").alias("name")).distinct())
    release(rows, companies, block, name)
    spelt = cut(accounts.select("block", "name").distinct().withColumn("s", F.monotonically_increasing_id()))
    worded = cut(words_apart(spelt.select("s", "block", "name")).select("s", "block", F.col("name").alias("text"), "words"))
    grouped = linked(worded, name_vector, COSINE, name_likeness, component_limit)
    release(worded)
    placed = spelt.join(grouped, "s", "left").select("block", "name", F.coalesce("cluster", "s").alias("person"))
    return accounts.join(placed, ["block", "name"]).select("user_id", "person").distinct(), spelt


def account_pairs(members: DataFrame) -> DataFrame:
    """(user_id_a, user_id_b): all pairs of accounts of one person, as the result asks for; a < b."""
    left, right = members.select("person", F.col("user_id").alias("user_id_a")), members.select("person", F.col("user_id").alias("user_id_b"))
    return left.join(right, "person").where("user_id_a < user_id_b").select("user_id_a", "user_id_b").distinct()
