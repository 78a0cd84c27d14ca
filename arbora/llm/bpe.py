"""Encoding with a byte-level BPE vocabulary file, by batched numpy merge rounds.

The distinct words of a batch are encoded together: their symbols lie in one flat array. A round looks up every pair of
neighbours of one word by binary search in the sorted pair keys, takes each word's lowest merge rank, merges that pair
wherever it stands in the word (left to right, without overlap) and closes the gaps. Words without a pair leave. Rounds
are as many as merges in the longest-lived word, whatever the number of words.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files are unless a path is given.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The pattern of byte-level BPE pre-tokenization (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1 << 40)
#: Words whose ids a worker remembers, and the longest of them in bytes. They bound memory, never results.
CACHE_WORDS, CACHE_BYTES = 200_000, 64
#: Characters of text that are encoded together; a longer text is a batch of its own.
BATCH_CHARS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the file, and the byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges of a ``tokenizers`` JSON file as sorted pair keys with rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.byte_ids[byte] = vocab[char]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't merge) and merged id of each pair."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE), self.merged[at]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        out: list[np.ndarray] = [np.array([], np.int64)] * len(words)
        while len(symbols):
            same = word[1:] == word[:-1]
            rank, merged = self.ranks(symbols[:-1], symbols[1:])
            rank = np.r_[np.where(same, rank, NONE), NONE]
            merged = np.r_[merged, 0]
            begin = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.r_[begin, len(symbols)])
            active = least < NONE
            for b, n in zip(begin[~active].tolist(), sizes[~active].tolist()):
                out[word[b]] = symbols[b : b + n]
            hit = (rank == np.repeat(least, sizes)) & (rank < NONE)
            # Of touching hits (aaa) every second one merges, counted from the left.
            at = np.flatnonzero(hit)
            if len(at):
                run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
                start = at[np.flatnonzero(np.r_[True, np.diff(run) != 0])]
                at = at[(at - start[run]) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = merged[at]
            keep = np.repeat(active, sizes)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out


class Encoder:
    """Texts to id arrays; remembers the ids of short words, up to a fixed number."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.split(t) for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self.known})
        now = dict(zip(fresh, self.vocabulary.encode_words([w.encode() for w in fresh]))) if fresh else {}
        empty, known = np.array([], np.int64), self.known
        out = [np.concatenate([now[w] if w in now else known[w] for w in ws]) if ws else empty for ws in words]
        if len(known) > CACHE_WORDS:
            known.clear()
        known.update((w, ids.copy()) for w, ids in now.items() if len(w) <= CACHE_BYTES)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _portions(texts: list[str]):
    portion, chars = [], 0
    for t in texts:
        portion.append(t)
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield portion
            portion, chars = [], 0
    if portion:
        yield portion


def encode_table(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>): the ids of ``text`` as it stands, special-token strings being ordinary text.

    Null and empty texts give an empty list. Repeated keys give a row each; other columns are not read. Texts of any
    length are encoded whole.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.json"
    kind = dict(df.dtypes)[key]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            rows = [ids for portion in _portions(texts) for ids in enc.encode(portion)]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows).astype(np.int32) if rows else np.array([], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    return df.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
