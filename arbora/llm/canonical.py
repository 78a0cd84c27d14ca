"""Mapping free-entered values to a canonical list, by a symmetric-delete dictionary.

Every entry has a few *keys*, the ways it is written: whole, with its parts swapped, with a part abbreviated, as
acronym with its own word, or by its own word alone where that is unique in the list. A value is reduced to tokens
(case, marks and punctuation removed), and every run of its tokens is looked up: the dictionary maps each deletion of up to two
letters of a key's prefix to the key, and the same deletions of the run find all keys within the edit bound. Candidates
are ranked by weighted Damerau-Levenshtein distance (transposed, doubled and neighbouring letters cost less, blanks
little), by the letters they explain and by the reference frequency of the entry; other words around (a role, a legal
form, a country) cost nothing. Values without an acceptable candidate are reported with 0.

Every distinct value is mapped once. The dictionary is built in each task from the keys, which are shipped if the list is at
most ``broadcast_limit`` long (counted). Beyond that, keys and runs are joined by their deletions and each value is ranked
against the keys it met: the same keys, bounds and frequencies, and so the same entry.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.runtime import cut, small

#: Entries that are shipped to every task; some 30 keys of 20 bytes each.
BROADCAST_LIMIT = 20_000
#: Letters of a key that the dictionary indexes.
PREFIX = 9
#: Letters a run of tokens may have more than the longest key: no key allows more edits.
SLACK = 2
#: Values a worker remembers.
CACHE = 100_000

# Usual abbreviations of the first word of a place name.
PLACE_WORDS = {
    "new": ("nw",),
    "north": ("n", "nth"),
    "south": ("s", "sth"),
    "east": ("e",),
    "west": ("w",),
    "fort": ("ft",),
    "lake": ("lk",),
    "mount": ("mt",),
    "port": ("pt",),
    "saint": ("st",),
}
# Legal forms, and words of a company name that an acronym leaves out.
LEGAL_FORMS = {"inc", "llc", "ltd", "gmbh", "bv", "b", "v", "sa", "s", "a", "ag", "kg", "plc", "corp", "co", "limited", "srl", "oy", "ab", "pty"}
SMALL_WORDS = {"of", "for", "the", "and", "de", "la"}
# Rows of a keyboard, whose neighbours are often hit instead.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEIGHBOURS = {(a, b) for row in KEYBOARD for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}


def plain(text: str) -> str:
    """Case and marks removed, letters joined by capitals split."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-zß-ÿ])(?=[A-Z][a-z])", " ", text).casefold()


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Runs of letters or digits, and for each whether more than a blank, dot or hyphen within words stands before it."""
    found, hard, end = [], [], 0
    line = plain(text)
    for m in re.finditer(r"[^\W_]+", line):
        gap = line[end : m.start()]
        found.append(m.group())
        hard.append(not found[:-1] or bool(re.search(r"[^\s.\-_']", gap)) or bool(re.search(r"\s-\s", gap)))
        end = m.end()
    return found, hard


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (restricted transpositions); anything above ``most`` may come as infinity."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most / 0.2:
        return float("inf")
    before, last = None, [0.0]
    for c in b:
        last.append(last[-1] + (0.2 if c == " " else 1.0))
    for i, x in enumerate(a, 1):
        gone = 0.2 if x == " " else 0.7 if i > 1 and a[i - 2] == x else 1.0
        row = [last[0] + gone]
        for j, y in enumerate(b, 1):
            # Equal letters too: an edit beside a double letter or a blank can cost less than the one further on.
            swap = 0.0 if x == y else 0.8 if (x, y) in NEIGHBOURS else 1.0
            added = 0.2 if y == " " else 0.7 if j > 1 and b[j - 2] == y else 1.0
            best = min(last[j - 1] + swap, last[j] + gone, row[j - 1] + added)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        if min(row) > most:
            return float("inf")
        before, last = last, row
    return last[-1]


def edits(length: int) -> int:
    """Edits allowed in a key of ``length`` letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


def deletions(word: str, most: int) -> set[str]:
    """The first letters of ``word`` with up to ``most`` of them left out."""
    last = {word[:PREFIX]}
    out = set(last)
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def company_keys(name: str, unique: set[str]) -> dict[str, str]:
    words, _ = tokens(name)
    keys = {" ".join(words): "whole"}
    if len(words) == 2:
        a, b = words
        keys |= {f"{b} {a}": "swapped"} | {f"{a} {b[:n]}": "short" for n in (3, 4) if len(b) > n}
    main = [w for w in words if w not in SMALL_WORDS]
    if len(main) > 2:
        acronym = "".join(w[0] for w in main)
        keys |= {f"{acronym} {w}": "acronym" for w in main if w in unique}
        full = "".join(w[0] for w in words)
        keys |= {f"{full} {w}": "acronym" for w in main if w in unique}
    keys |= {w: "own" for w in words[:1] if w in unique and len(words) == 2}
    return keys


def place_keys(name: str, unique: set[str]) -> dict[str, str]:
    words, _ = tokens(name)
    keys = {" ".join(words): "whole"}
    if len(words) > 1 and words[0] in PLACE_WORDS:
        rest = " ".join(words[1:])
        for first in (words[0], *PLACE_WORDS[words[0]]):
            keys |= {f"{first} {rest}": "whole", f"{rest} {first}": "swapped"}
    return keys


def keys_of(kind: str, name: str, listed: dict[str, int]) -> dict[str, str]:
    """The keys of one entry and their forms, given in how many entries of its kind each of its words stands."""
    if kind == "location":
        return place_keys(name, set())
    words = tokens(name)[0]
    unique = {w for w in words if listed[w] <= 3} if len(words) > 2 else {w for w in words[:1] if listed[w] == 1}
    return company_keys(name, unique)


def entry_keys(entries: list[tuple[int, str, str]]) -> list[tuple[str, str, int, str]]:
    """(kind, key, ref_id, form) of all entries (ref_id, kind, canonical). A key two entries of a kind share is dropped."""
    named = [(r, k, n) for r, k, n in set(entries) if n and tokens(n)[0]]
    listed: dict[str, dict[str, set[int]]] = {}
    for r, kind, name in named:
        for w in tokens(name)[0]:
            listed.setdefault(kind, {}).setdefault(w, set()).add(r)
    out: dict[tuple[str, str], set[tuple[int, str]]] = {}
    for r, kind, name in named:
        for key, form in keys_of(kind, name, {w: len(listed[kind][w]) for w in tokens(name)[0]}).items():
            out.setdefault((kind, key), set()).add((r, form))
    return sorted((kind, key, *min(v)) for (kind, key), v in out.items() if len({r for r, _ in v}) == 1)


def runs(words: list[str], longest: int):
    """(i, j, run, tight): the runs of tokens i..j with blanks and without, none much longer than the longest key."""
    for i in range(len(words)):
        run = tight = ""
        for j in range(i, len(words)):
            run, tight = f"{run} {words[j]}".strip(), tight + words[j]
            if len(tight) > longest + SLACK:
                break
            yield i, j, run, tight


class Matcher:
    """The entry a value of one kind means."""

    def __init__(self, keys: list[tuple[str, int, str]], frequency: dict[int, int], places: bool):
        self.keys = [(k, k.replace(" ", ""), r, form) for k, r, form in keys]
        self.frequency, self.places = frequency, places
        self.index: dict[str, list[int]] = {}
        for n, (_, tight, _, _) in enumerate(self.keys):
            for d in deletions(tight, edits(len(tight))):
                self.index.setdefault(d, []).append(n)
        self.longest = max((len(tight) for _, tight, _, _ in self.keys), default=0)
        self.cache: dict[str, int] = {}

    def __call__(self, value: str) -> int:
        if value not in self.cache:
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.cache[value] = self.match(value)
        return self.cache[value]

    def match(self, value: str) -> int:
        words, hard = tokens(value)
        best = (0.0, 0, 0)
        for i, j, run, tight in runs(words, self.longest):
            near = {n for d in deletions(tight, edits(len(tight) + 1)) for n in self.index.get(d, ())}
            for n in near:
                key, key_tight, ref, form = self.keys[n]
                bound = edits(len(key_tight))
                # No key scores more than its letters.
                if abs(len(key_tight) - len(tight)) > bound or len(key_tight) < best[0]:
                    continue
                if self.places and any(len(w) < 3 and w not in run.split() and not tight.startswith(w) and not tight.endswith(w) for w in key.split()):
                    continue  # an abbreviated first word must be there
                if self.places and any(w in PLACE_WORDS and w not in key.split() for w in words[i : j + 1]):
                    continue  # "Fort" is no misspelt "Port"
                cost = distance(run, key, bound + 0.6)
                if cost > bound + 0.6 or cost >= 1 and len(key_tight) < 5 or self._contradicted(words, hard, i, j, form):
                    continue
                score = len(key_tight) - 2.5 * cost
                best = max(best, (score, self.frequency.get(ref, 0), ref))
        return best[2]

    def _contradicted(self, words: list[str], hard: list[bool], i: int, j: int, form: str) -> bool:
        """Whether a word beside the run makes it another name: "New" before a place, a business after a lone name."""
        if self.places:
            return i > 0 and not hard[i] and any(words[i - 1] == w or words[i - 1] in s and len(words[i - 1]) > 1 for w, s in PLACE_WORDS.items())
        return form == "own" and j + 1 < len(words) and not hard[j + 1] and len(words[j + 1]) > 2 and words[j + 1] not in LEGAL_FORMS


@lru_cache(maxsize=4)
def matcher(keys: tuple, frequency: tuple, kind: str) -> Matcher:
    return Matcher([(k, r, form) for t, k, r, form in keys if t == kind], dict(frequency), kind == "location")


def reference_frequency(values: DataFrame, listed: DataFrame) -> DataFrame:
    """(ref_id, n): how often each entry of ``listed`` stands literally among ``values`` (field, v, n), case and blanks apart."""
    named = listed.select(F.col("kind").alias("field"), F.lower(F.trim("canonical")).alias("v"), "ref_id")
    spelt = values.select("field", F.lower(F.trim("v")).alias("v"), "n").groupBy("field", "v").agg(F.sum("n").alias("n"))
    return named.join(spelt, ["field", "v"]).groupBy("ref_id").agg(F.sum("n").alias("n"))


def usable(canonical: DataFrame, kinds: list[str]) -> DataFrame:
    """(ref_id, kind, canonical) of the list's entries of these kinds, without null and blank ones."""
    rows = canonical.select(F.col("ref_id").cast("long").alias("ref_id"), "kind", "canonical")
    return rows.where(F.col("kind").isin(kinds) & F.col("ref_id").isNotNull() & (F.trim("canonical") != "")).distinct()


def mapped(values: DataFrame, listed: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(field, v, ref_id): the entry of ``listed`` (ref_id, kind, canonical), or 0, of each of the distinct ``values``
    (field, v, n: how often it stands). Values that are only white space are left out."""
    frequency = reference_frequency(values, listed)
    if listed.limit(broadcast_limit + 1).count() > broadcast_limit:
        return _mapped_by_join(values, listed, frequency)
    keys = tuple(entry_keys([(r.ref_id, r.kind, r.canonical) for r in listed.collect()]))
    counts = tuple(sorted((r.ref_id, r.n) for r in frequency.collect()))

    def run(batches):
        for b in batches:
            fields, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            refs = [matcher(keys, counts, f).match(v) if v.strip() else None for f, v in zip(fields, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(refs, pa.int64())], names=["field", "v", "ref_id"])

    # So many tasks whatever the size in bytes: the work is per value.
    spread = values.select("field", "v").repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    return spread.mapInArrow(run, "field string, v string, ref_id long").where("ref_id is not null")


def map_values(profiles: DataFrame, canonical: DataFrame, key: str = "user_id", fields: tuple[str, ...] = ("company", "location"), broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(key, field, ref_id): for every row's value of each field that is not null or only white space its entry, or 0.

    ``canonical`` has ref_id, kind (a field) and canonical; null or blank entries are ignored and an empty list maps all
    to 0. Repeated rows give one row; a key with different values gives a row for each entry. Null keys are left out.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    rows = profiles.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.explode(pairs).alias("x")).select("k", "x.field", "x.v").where("v is not null")
    values = cut(rows.groupBy("field", "v").agg(F.count("*").alias("n")))
    known = cut(mapped(values, usable(canonical, list(fields)), broadcast_limit))
    return rows.join(small(known), ["field", "v"]).select(F.col("k").alias(key), "field", "ref_id").distinct()


def _mapped_by_join(values: DataFrame, listed: DataFrame, frequency: DataFrame) -> DataFrame:
    """``mapped`` for a list too long to ship: values and keys meet by the deletions of their token runs."""
    entry = "ref_id long, kind string, canonical string"

    def words_of(batches):
        for b in batches:
            at, found = [], []
            for i, name in enumerate(b.column(2).to_pylist()):
                words = sorted(set(tokens(name)[0]))
                at += [i] * len(words)
                found += words
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(found, pa.string())], names=["ref_id", "kind", "canonical", "w"])

    def keys_in(batches):
        for b in batches:
            out = []
            for r, kind, name, counts in zip(*(c.to_pylist() for c in b.columns)):
                out += [(kind, k, r, form) for k, form in keys_of(kind, name, {x["w"]: x["n"] for x in counts}).items()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["field", "key", "ref_id", "form"])

    words = cut(listed.mapInArrow(words_of, f"{entry}, w string"))
    entries = words.join(words.groupBy("kind", "w").agg(F.count_distinct("ref_id").alias("n")), ["kind", "w"])
    entries = entries.groupBy("ref_id", "kind", "canonical").agg(F.collect_set(F.struct("w", "n")).alias("counts"))
    keys = entries.mapInArrow(keys_in, "field string, key string, ref_id long, form string")
    keys = keys.groupBy("field", "key").agg(F.min(F.struct("ref_id", "form")).alias("m"), F.count_distinct("ref_id").alias("n")).where("n = 1").select("field", "key", "m.ref_id", "m.form")
    keys = cut(keys.join(frequency.withColumnRenamed("n", "often"), "ref_id", "left").select("field", "key", "ref_id", "form", F.coalesce("often", F.lit(0)).alias("often")))
    longest = {r.field: r.n for r in keys.groupBy("field").agg(F.max(F.length(F.replace("key", F.lit(" "), F.lit("")))).alias("n")).collect()}

    def value_deletions(batches):
        for b in batches:
            at, found = [], []
            for i, (f, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                met = {d for *_, tight in runs(tokens(v)[0], longest.get(f, 0)) for d in deletions(tight, edits(len(tight) + 1))}
                at += [i] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), pa.array(found, pa.string())], names=["field", "v", "d"])

    def key_deletions(batches):
        for b in batches:
            at, found = [], []
            for i, key in enumerate(b.column(1).to_pylist()):
                tight = key.replace(" ", "")
                met = deletions(tight, edits(len(tight)))
                at += [i] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(found, pa.string())], names=["field", "key", "ref_id", "form", "often", "d"])

    def rank(batches):
        for b in batches:
            refs = []
            for f, v, ks in zip(*(c.to_pylist() for c in b.columns)):
                refs.append(Matcher([(x["key"], x["ref_id"], x["form"]) for x in ks or ()], {x["ref_id"]: x["often"] for x in ks or ()}, f == "location").match(v) if v.strip() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(refs, pa.int64())], names=["field", "v", "ref_id"])

    spread = keys.mapInArrow(key_deletions, "field string, key string, ref_id long, form string, often long, d string")
    met = values.select("field", "v").mapInArrow(value_deletions, "field string, v string, d string").join(spread, ["field", "d"])
    found = met.groupBy("field", "v").agg(F.collect_set(F.struct("key", "ref_id", "form", "often")).alias("ks"))
    return values.select("field", "v").join(found, ["field", "v"], "left").mapInArrow(rank, "field string, v string, ref_id long").where("ref_id is not null")
