"""Evaluation texts leaking into training text, by size-partitioned MinHash containment.

A leak is a run of ``run`` characters common to a document and a test item, both reduced to letters and digits. Whole
items have a small and varying share of their text in a document, for which no MinHash threshold finds all. The domains
searched for are therefore the *windows* of ``run`` characters of each item, which all fall into one size partition and
have a leaked window contained wholly: there containment 1 means equal shingle sets, and equal shingle sets always
have equal MinHash. The MinHash of every window of a text is the minimum of its shingle hashes in a sliding window, and
a text keeps its distinct minima (about one in twenty characters). So a document and an item that share a window share a
minimum for certain. Candidates met that way are verified by exact containment: one of the item's windows stands in the
document.

Items are few and documents many. If the items' minima are at most ``broadcast_limit`` (counted), they are shipped to
the tasks that read the documents, and nothing but candidates is shuffled; beyond that both sides are joined by hash.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.runtime import cut

#: Letters and digits of the leak's definition, and characters of a shingle.
RUN, SHINGLE = 50, 12
#: Item minima that are shipped to tasks rather than joined: 8 bytes each.
BROADCAST_LIMIT = 500_000
#: Characters worked on together. A longer text is a portion of its own.
PORTION = 400_000
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_ASCII_OTHER = regex.compile(r"[^a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Case-folded, NFKD-decomposed, letters and digits only; '' for null."""
    if not text:
        return ""
    if text.isascii():
        return _ASCII_OTHER.sub("", text.lower())
    return _OTHER.sub("", unicodedata.normalize("NFKD", text.casefold()))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[: len(x) - span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def minima(texts: list[str], run: int = RUN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, MinHash) of all windows of ``run`` characters, each pair once. Shorter texts have none."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    if total < run:
        return np.array([], np.int64), np.array([], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = np.zeros(total - shingle + 1, np.uint64)
    for i in range(shingle):
        hashes = hashes * _BASE + codes[i : i + len(hashes)] + np.uint64(1)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    least = _sliding_min(hashes, run - shingle + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: len(least)] == owner[run - 1 :]
    least, owner = least[inside], owner[: len(inside)][inside]
    change = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])] if len(least) else np.array([], bool)
    pairs = np.unique(np.rec.fromarrays([owner[change], least[change].view(np.int64)], names="o,m"))
    return pairs.o, pairs.m


def _portions(values: list):
    start, chars = 0, 0
    for i, t in enumerate(values):
        chars += len(t)
        if chars >= PORTION:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(values):
        yield start, len(values)


def window_minima(df: DataFrame, key: str, text: str, run: int, only: np.ndarray | None = None) -> DataFrame:
    """(k, m): the distinct window minima of each text; with ``only`` those among the given sorted values."""

    def work(batches):
        for b in batches:
            keys, texts = b.column(0), [letters(t) for t in b.column(1).to_pylist()]
            for lo, hi in _portions(texts):
                owner, least = minima(texts[lo:hi], run)
                if only is not None and len(least):
                    at = np.searchsorted(only, least)
                    at[at == len(only)] = 0
                    hit = only[at] == least
                    owner, least = owner[hit], least[hit]
                if len(owner):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner + lo)), pa.array(least)], names=["k", "m"])

    return df.select(key, text).where(f"length(`{text}`) >= {run} or length(`{text}`) * 18 >= {run}").mapInArrow(work, "k long, m long")


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = RUN, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_key, item_key): the documents and items with a common run of ``run`` letters and digits.

    Null, empty and short texts share nothing; repeated rows of a document or item count once; rows with a null key are
    left out. Documents of any length are searched whole. A passage copied into a third of all documents makes
    that many rows and no group: only the item side is grouped by minimum.
    """
    docs = documents.select(F.col(doc_key).cast("long").alias("d"), F.col(text).alias("dt")).where("d is not null and dt is not null")
    tests = items.select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("it")).where("i is not null and it is not null")
    wanted = cut(window_minima(tests, "i", "it", run).select(F.col("k").alias("i"), "m").distinct())
    values = wanted.select("m").distinct()
    if values.limit(broadcast_limit + 1).count() <= broadcast_limit:
        only = np.sort(np.array([r.m for r in values.toLocalIterator()], np.int64))
        if not len(only):
            only = np.array([0], np.int64)
        met = window_minima(docs, "d", "dt", run, only).join(F.broadcast(wanted), "m")
    else:
        met = window_minima(docs, "d", "dt", run).join(wanted, "m")
    pairs = cut(met.select(F.col("k").alias("d"), "i").distinct())
    # A document's text goes to the check once, with all items it may hold.
    asked = pairs.join(tests.distinct(), "i").groupBy("d").agg(F.collect_list(F.struct("i", "it")).alias("items"))
    return docs.join(asked, "d").mapInArrow(_verify(run), "d long, i long").distinct().select(F.col("d").alias(doc_key), F.col("i").alias(item_key))


def _verify(run: int):
    def work(batches):
        windows: dict[str, list[str]] = {}
        for b in batches:
            found_d, found_i = [], []
            for d, text, items in zip(b.column("d").to_pylist(), b.column("dt").to_pylist(), b.column("items").to_pylist()):
                cleaned = letters(text)
                for item in items:
                    test = item["it"]
                    if test not in windows:
                        if len(windows) > 10_000:
                            windows.clear()
                        t = letters(test)
                        windows[test] = [t[i : i + run] for i in range(len(t) - run + 1)]
                    if any(w in cleaned for w in windows[test]):
                        found_d.append(d)
                        found_i.append(item["i"])
            yield pa.RecordBatch.from_arrays([pa.array(found_d, pa.int64()), pa.array(found_i, pa.int64())], names=["d", "i"])

    return work


def leaked_items(pairs: DataFrame, item_key: str = "item_id") -> DataFrame:
    """(item_key, documents): in how many documents each leaked item stands."""
    return pairs.groupBy(item_key).agg(F.count("*").alias("documents"))
