"""All pairs of similar sets, by pigeonhole partitioning of the token universe.

Sets of sizes a <= b with Jaccard >= t differ in at most ``H = a + b - 2 * ceil(t / (1 + t) * (a + b))`` tokens. Sizes are
cut into ranges; for each range a hash splits the token universe into ``n`` segments, and the set under test has its
tokens spread over them. If a budget of H + 1 units is laid on the segments, at most two on each, then a similar set
must agree with some segment: exactly where one unit lies, up to one deletion on either side where two lie.

Every set is indexed under its own size range with all its segments and all their one-deletion variants. It probes
the ranges of sets not larger than itself, choosing where its units lie: the segments that hold rare tokens first, so
that no segment of very frequent tokens and no empty one is probed while others suffice. The frequencies steer cost only;
any choice finds every pair. Candidates are verified exactly.

Equal sets are one class before any of this, so a group of copies costs one probe, and its pairs arise only in the
expansion of the result. No bucket is capped and no candidate dropped.

Sets beyond ``array_limit`` tokens are never gathered in one row: see ``_row_pairs``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.runtime import cut

#: A token in at least this share of the sets has its frequency broadcast: there are at most (mean set size) / share.
FREQUENT_SHARE = 0.002
#: Ratio between the ends of a size range.
RANGE_GROWTH = 1.25
#: Fixed odd multipliers of the hash.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_SIG = "sig long, id long, size int"


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes a and b with Jaccard >= num / den, in whole numbers."""
    return -((-num * (a + b)) // (num + den))


def size_range(size: int, least: int) -> int:
    """Number of the size range of ``size``."""
    k, hi = 0, least
    while size > hi:
        k, hi = k + 1, max(hi + 1, int(hi * RANGE_GROWTH))
    return k


def range_bounds(k: int, least: int) -> tuple[int, int]:
    lo = hi = least
    for _ in range(k):
        lo, hi = hi + 1, max(hi + 1, int(hi * RANGE_GROWTH))
    return lo, hi


def most_different(b: int, k: int, least: int, num: int, den: int) -> int:
    """Largest difference between a set of size b and a similar one, not larger, of range k; -1 if there is none."""
    lo, hi = range_bounds(k, least)
    least_a, most_a = max(lo, -((-num * b) // den)), min(hi, b)
    # The difference grows with a but for rounding, which repeats every num + den sizes.
    sizes = range(max(least_a, most_a - num - den), most_a + 1)
    return max((a + b - 2 * needed(a, b, num, den) for a in sizes), default=-1)


def segments(k: int, least: int, num: int, den: int) -> int:
    """Segments of range k: enough for one unit each at the largest difference any prober can have."""
    lo, hi = range_bounds(k, least)
    most_b = hi * den // num
    worst = max(most_different(b, k, least, num, den) for b in range(max(lo, most_b - num - den), most_b + 1))
    return max(2, (worst + 1) * 3 // 4 + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def _expand(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each l, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Signatures:
    """Index and probe signatures of a batch of sets; a plain value that is shipped to the workers."""

    def __init__(self, least: int, num: int, den: int, frequent: dict[int, float]):
        self.least, self.num, self.den = least, num, den
        self.hot = np.array(sorted(frequent), dtype=np.int64)
        self.share = np.array([frequent[int(t)] for t in self.hot], dtype=np.float64)
        self.ranges: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self.count: dict[int, int] = {}

    def layouts(self, size: int) -> tuple[int, list[tuple[int, int]]]:
        """The set's own range, and the ranges it probes with the units to lay there."""
        if size not in self.ranges:
            own, probes = size_range(size, self.least), []
            for k in range(own, -1, -1):
                h = most_different(size, k, self.least, self.num, self.den)
                if h < 0:
                    break
                probes.append((k, h + 1))
                if k not in self.count:
                    self.count[k] = segments(k, self.least, self.num, self.den)
            self.ranges[size] = own, probes
        return self.ranges[size]

    def cost(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, tokens)
        at[at == len(self.hot)] = 0
        if not len(self.hot):
            return np.full(len(tokens), FREQUENT_SHARE)
        return np.where(self.hot[at] == tokens, self.share[at], FREQUENT_SHARE)

    def batch(self, ids: np.ndarray, offsets: np.ndarray, tokens: np.ndarray) -> tuple[dict, dict]:
        sizes = np.diff(offsets)
        jobs = [(i, k, units, k == own) for i, s in enumerate(sizes.tolist()) for own, probes in [self.layouts(s)] for k, units in probes]
        if not jobs:
            empty = {"sig": np.array([], np.int64), "id": np.array([], np.int64), "size": np.array([], np.int32)}
            return empty, empty
        who, rng, units, own = (np.array(x) for x in zip(*jobs))
        n = np.array([self.count[k] for k in rng.tolist()])
        # Tokens of every job, with the segment each falls into.
        lengths = sizes[who]
        job = np.repeat(np.arange(len(jobs)), lengths)
        token = tokens[np.repeat(offsets[:-1][who], lengths) + _expand(lengths)]
        hashed = mix(token.astype(np.uint64) * np.uint64(MIX[0]) + np.uint64(1))
        segment = (mix(hashed) >> np.uint64(33)).astype(np.int64) % n[job]
        # Every segment of every job, empty ones included: sum of hashes, product-like cost of all tokens and without the rarest.
        first = np.cumsum(n) - n
        slot, slots = first[job] + segment, int(n.sum())
        slot_job = np.repeat(np.arange(len(jobs)), n)
        base = mix((rng[slot_job].astype(np.uint64) << np.uint64(32)) + _expand(n).astype(np.uint64))
        cost = np.log(self.cost(token))
        order = np.lexsort((cost, slot))
        sslot, scost = slot[order], cost[order]
        total = np.zeros(slots, np.uint64)
        np.add.at(total, slot, hashed)
        held = np.bincount(slot, minlength=slots)
        exact_cost = np.bincount(slot, weights=cost, minlength=slots)
        begin = np.flatnonzero(np.r_[True, sslot[1:] != sslot[:-1]])
        rarest = np.zeros(slots)
        rarest[sslot[begin]] = scost[begin]
        deleted_cost = exact_cost - rarest
        whole = mix(base + total)
        # Units: the cheapest first of (slot, exact) and (slot, one deletion); a slot's second unit never costs less than its first.
        unit_job = np.r_[slot_job, slot_job]
        unit_slot = np.r_[np.arange(slots), np.arange(slots)]
        unit_two = np.r_[np.zeros(slots, bool), np.ones(slots, bool)]
        unit_cost = np.r_[exact_cost, deleted_cost + np.log1p(held)]
        unit_cost = np.where(unit_two, np.maximum(unit_cost, np.r_[exact_cost, exact_cost]), unit_cost)
        o = np.lexsort((unit_two, unit_cost, unit_job))
        rank = _expand(2 * n)
        taken = o[rank < units[unit_job[o]]]
        taken_exact, taken_two = unit_slot[taken[~unit_two[taken]]], unit_slot[taken[unit_two[taken]]]
        two = np.zeros(slots, bool)
        two[taken_two] = True
        # One-deletion variants of every token in its slot.
        variant = mix(base[slot] + total[slot] - hashed)
        tag = np.uint64(MIX[0])
        pick = two[slot]
        own_slot, own_token = own[slot_job], own[job]
        out = []
        for parts in (
            ((whole[own_slot], slot_job[own_slot]), (variant[own_token] ^ tag, job[own_token])),
            ((whole[taken_exact], slot_job[taken_exact]), (whole[taken_two] ^ tag, slot_job[taken_two]), (variant[pick], job[pick])),
        ):
            sig, j = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            out.append({"sig": sig.view(np.int64), "id": ids[who[j]], "size": sizes[who[j]].astype(np.int32)})
        return out[0], out[1]

    def index(self, batches):
        return self._run(batches, 0)

    def probe(self, batches):
        return self._run(batches, 1)

    def _run(self, batches, kind: int):
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            lists = b.column("tokens")
            offsets, tokens = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            for lo in range(0, len(ids), 2000):
                hi = min(lo + 2000, len(ids))
                part = self.batch(ids[lo:hi], offsets[lo : hi + 1] - offsets[lo], tokens[offsets[lo] : offsets[hi]])[kind]
                if len(part["sig"]):
                    yield pa.RecordBatch.from_arrays([pa.array(part["sig"]), pa.array(part["id"]), pa.array(part["size"])], names=["sig", "id", "size"])


def distinct_sets(rows: DataFrame, key: str, token: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(pairs: k, t), (sizes: k, n): the distinct tokens of every key with at least ``least`` of them, and their number.

    Null keys and tokens are left out and repeats count once. Both steps group by (key, token) or fold counts before the
    shuffle, so a hot key stays spread.
    """
    pairs = rows.select(F.col(key).cast("long").alias("k"), F.col(token).cast("long").alias("t")).where("k is not null and t is not null").distinct()
    sizes = cut(pairs.groupBy("k").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= least))
    return pairs, sizes


def similar_sets(rows: DataFrame, key: str, token: str, least: int = 5, num: int = 3, den: int = 5, array_limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(links: a, b, overlap), (members: member, class): pairs of distinct sets with Jaccard >= num / den, and who has them.

    A class is one distinct set, named by its smallest owner; links have a < b. Owners of one class are similar to each
    other (Jaccard 1) and to all owners of linked classes. Sets below ``least`` tokens take no part. Empty input gives
    empty results.
    """
    pairs, sizes = distinct_sets(rows, key, token, least)
    kept = sizes.where(F.col("n") <= array_limit).select(F.col("k").alias("sk"))
    arrays = cut(pairs.join(kept, F.col("k") == F.col("sk"), "left_semi").groupBy("k").agg(F.array_sort(F.collect_list("t")).alias("tokens")))
    classes = cut(arrays.groupBy("tokens").agg(F.min("k").alias("id")))
    members = arrays.join(classes, "tokens").select(F.col("k").alias("member"), F.col("id").alias("class"))
    links = _array_pairs(classes, least, num, den)
    if not sizes.where(F.col("n") > array_limit).isEmpty():
        big = cut(pairs.join(sizes.where(F.col("n") > array_limit).withColumnRenamed("k", "sk"), F.col("k") == F.col("sk")).select(F.col("k").alias("id"), F.col("t").alias("token"), F.col("n").alias("size")))
        # Sets around the limit can be similar across it: those down to num / den of it join the row-wise path as well.
        near = pairs.join(sizes.where((F.col("n") <= array_limit) & (F.col("n") >= F.lit(array_limit) * num / den)).withColumnRenamed("k", "sk"), F.col("k") == F.col("sk")).select(F.col("k").alias("id"), F.col("t").alias("token"), F.col("n").alias("size"))
        every = cut(big.unionByName(near))
        ids = big.select("id").distinct()
        found = _row_pairs(every, num, den)
        touched = found.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(found.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select(*found.columns)).distinct()
        # Owners here stand for themselves, so links to a smaller set's owners are already expanded: name classes alike.
        members = members.unionByName(ids.select(F.col("id").alias("member"), F.col("id").alias("class")))
        named = classes.select(F.col("id").alias("c")).unionByName(ids.select(F.col("id").alias("c")))
        touched = touched.join(named, touched.a == named.c, "left_semi").join(named, touched.b == named.c, "left_semi")
        links = links.unionByName(touched)
    return links, members


def _array_pairs(classes: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Verified links between the distinct sets of ``classes`` (id, tokens)."""
    n = classes.count()
    often = classes.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") >= max(2.0, FREQUENT_SHARE * n))
    frequent = {r.t: r.c / n for r in often.collect()}
    kernel = Signatures(least, num, den, frequent)
    source = classes.select("id", "tokens")
    index = source.mapInArrow(kernel.index, _SIG).select(F.col("sig"), F.col("id").alias("i"), F.col("size").alias("isize"))
    probe = source.mapInArrow(kernel.probe, _SIG).select(F.col("sig"), F.col("id").alias("p"), F.col("size").alias("psize"))
    fits = (F.col("i") != F.col("p")) & (F.col("isize") <= F.col("psize")) & (F.col("isize") * den >= F.col("psize") * num)
    met = probe.join(index, "sig").where(fits).select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")).distinct()
    left = classes.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = classes.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = met.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("overlap"), (F.size("ta") + F.size("tb")).alias("both"))
    return both.where(F.col("overlap") * (num + den) >= F.col("both") * num).select("a", "b", "overlap")


def _row_pairs(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets given as rows (id, token, size), for sets too large for an array.

    Segments are twice the largest difference, and each is a folded hash of its tokens; equal hashes make candidates, whose
    common tokens are counted by joins. Hash sums stay of fixed size whatever the set. A prober with more segments that
    hold tokens than tokens can differ must agree with a similar set in one of them; should the hash fill fewer
    (counted), its single tokens are its segments.
    """
    rng = F.floor(F.log(F.col("size").cast("double")) / math.log(RANGE_GROWTH)).cast("int")
    own = tokens.withColumn("own", rng)
    reach = math.ceil(math.log(den / num) / math.log(RANGE_GROWTH)) + 1
    ranged = own.withColumn("range", F.explode(F.sequence(F.col("own") - reach, F.col("own"))))
    top = F.pow(F.lit(RANGE_GROWTH), F.col("range") + 1) * (1 + den / num)
    count = F.ceil(top * (den - num) / (den + num)).cast("long") * 2 + 2
    slot = F.pmod(F.xxhash64("token", F.lit(1)), count)
    folded = ranged.groupBy("id", "size", "own", "range", slot.alias("slot")).agg(F.bit_xor(F.xxhash64("token", F.lit(2))).alias("x"))
    signed = folded.select("id", "size", "own", "range", F.xxhash64("range", "slot", "x").alias("sig"))
    index = signed.where("own = range").select("sig", F.col("id").alias("i"), F.col("size").alias("isize"))
    probe = signed.select("sig", F.col("id").alias("p"), F.col("size").alias("psize"))
    fits = (F.col("i") != F.col("p")) & (F.col("isize") <= F.col("psize")) & (F.col("isize") * den >= F.col("psize") * num)
    pair = [F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")]
    met = probe.join(index, "sig").where(fits).select(*pair)
    most = F.ceil(F.least(F.pow(F.lit(RANGE_GROWTH), F.col("range") + 1), F.col("size")) * (den - num) / (den + num) + F.col("size") * (den - num) / (den + num))
    sparse = cut(folded.groupBy("id", "size", "range").agg(F.count("*").alias("held")).where(F.col("held") <= most).select("id").distinct())
    if not sparse.isEmpty():
        every = tokens.select("token", F.col("id").alias("i"), F.col("size").alias("isize"))
        alone = tokens.join(sparse, "id", "left_semi").select("token", F.col("id").alias("p"), F.col("size").alias("psize"))
        met = met.unionByName(alone.join(every, "token").where(fits).select(*pair))
    met = cut(met.distinct())
    left = tokens.select(F.col("id").alias("a"), "token", F.col("size").alias("sa"))
    right = tokens.select(F.col("id").alias("b"), "token", F.col("size").alias("sb"))
    common = met.join(left, "a").join(right, ["b", "token"]).groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first(F.col("sa") + F.col("sb")).alias("both"))
    return common.where(F.col("overlap") * (num + den) >= F.col("both") * num).select("a", "b", "overlap")


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of all owners: those of linked classes and those sharing a class, a < b."""
    left = members.select(F.col("member").alias("ma"), F.col("class").alias("ca"))
    right = members.select(F.col("member").alias("mb"), F.col("class").alias("cb"))
    across = links.join(left, links.a == F.col("ca")).join(right, links.b == F.col("cb")).select("ma", "mb")
    within = left.join(right, (F.col("ca") == F.col("cb")) & (F.col("ma") < F.col("mb"))).select("ma", "mb")
    return across.unionByName(within).select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
