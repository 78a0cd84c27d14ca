"""Cut-vertex impact, communities and modularity.

Components of bounded size are handed to Arrow kernels, one group each. A component beyond ``component_limit`` edges is never
gathered: its cut vertices come from a distributed biconnectivity computation and its communities from synchronous sweeps.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.graph import adjacency, components
from arbora.operators.hierarchy import peel
from arbora.runtime import cut, numbered

#: Distinct links of a component that a kernel takes in one group.
COMPONENT_LIMIT = 500_000
#: Multiplier of the visiting order (fixed value).
VISIT = 2654435761
SWEEPS = 10
#: Steps of a sweep where the nodes of a large component move at once.
TURNS = 8


def _simple(follows: DataFrame) -> DataFrame:
    a, b = F.least("from_user_id", "to_user_id"), F.greatest("from_user_id", "to_user_id")
    return follows.where("from_user_id <> to_user_id").select(a.alias("a"), b.alias("b")).distinct()


def _blocks_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, blocks): in how many biconnected blocks each node of one component stands; low-links with an explicit stack."""
    ends = np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()])
    ids, index = np.unique(ends, return_inverse=True)
    n, m = len(ids), len(pdf)
    src, dst = np.concatenate([index[:m], index[m:]]), np.concatenate([index[m:], index[:m]])
    order = np.argsort(src, kind="stable")
    near, start = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    entered, low, blocks = [-1] * n, [0] * n, [0] * n
    position, parent, clock = start[:n], [-1] * n, 1
    entered[0] = low[0] = 0
    walk = [0]
    while walk:
        v = walk[-1]
        if position[v] < start[v + 1]:
            w = near[position[v]]
            position[v] += 1
            if entered[w] < 0:
                entered[w] = low[w] = clock
                clock += 1
                parent[w] = v
                walk.append(w)
            elif w != parent[v]:
                low[v] = min(low[v], entered[w])
        else:
            walk.pop()
            p = parent[v]
            if p >= 0:
                low[p] = min(low[p], low[v])
                if low[v] >= entered[p]:
                    blocks[p] += 1
    return pd.DataFrame({"id": ids, "blocks": [b + (p >= 0) for b, p in zip(blocks, parent)]})


def _blocks_distributed(links: DataFrame, parts: DataFrame) -> DataFrame:
    """The same for components of any size: breadth-first forest, preorder numbers by subtree sizes, lowest and highest
    number reachable over one other link, then components of the tree links that share a block."""
    both = cut(links.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))))
    level = cut(parts.where("id = component").select(F.col("id").alias("v"), F.lit(None).cast("long").alias("p"), F.lit(0).alias("d")))
    levels = [level]
    while True:
        seen = level.select("v") if len(levels) == 1 else level.select("v").unionByName(levels[-2].select("v"))
        near = level.join(both, F.col("v") == F.col("x")).groupBy(F.col("y").alias("w")).agg(F.min("x").alias("q"))
        level = cut(near.join(seen, F.col("w") == F.col("v"), "left_anti").select(F.col("w").alias("v"), F.col("q").alias("p"), F.lit(len(levels)).alias("d")))
        if level.isEmpty():
            break
        levels.append(level)
    # Subtree sizes bottom-up.
    sized, below = [], None
    for lv in reversed(levels):
        s = lv.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            kids = below.groupBy(F.col("p").alias("k")).agg(F.sum("size").alias("more"))
            s = lv.join(kids, F.col("v") == F.col("k"), "left").select("v", "p", "d", (F.lit(1) + F.coalesce("more", F.lit(0))).alias("size"))
        below = cut(s)
        sized.append(below)
    # Preorder top-down; each tree counts from 0 and is told apart by its links anyway.
    numbered, above = [], None
    before = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    for s in reversed(sized):
        if above is None:
            above = cut(s.withColumn("pre", F.lit(0).cast("long")))
        else:
            offset = s.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
            up = above.select(F.col("v").alias("u"), F.col("pre").alias("upre"))
            above = cut(offset.join(up, F.col("p") == F.col("u")).select("v", "p", "d", "size", (F.col("upre") + 1 + F.col("offset")).alias("pre")))
        numbered.append(above)
    tree = numbered[0]
    for part in numbered[1:]:
        tree = tree.unionByName(part)
    tree = cut(tree)
    one = tree.select(F.col("v").alias("xv"), F.col("p").alias("xp"), F.col("pre").alias("xpre"), F.col("size").alias("xsize"))
    two = tree.select(F.col("v").alias("yv"), F.col("p").alias("yp"), F.col("pre").alias("ypre"), F.col("size").alias("ysize"))
    other = cut(both.join(one, F.col("x") == F.col("xv")).join(two, F.col("y") == F.col("yv")).where("not (xp <=> y) and not (yp <=> x)"))
    own = other.groupBy(F.col("x").alias("k")).agg(F.min("ypre").alias("lo"), F.max("ypre").alias("hi"))
    reach, below = [], None
    for part in reversed(numbered):
        r = part.join(own, F.col("v") == F.col("k"), "left").select("v", "p", "pre", "size", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
        if below is not None:
            kids = below.groupBy(F.col("p").alias("k2")).agg(F.min("low").alias("clo"), F.max("high").alias("chi"))
            r = r.join(kids, F.col("v") == F.col("k2"), "left").select("v", "p", "pre", "size", F.least("low", "clo").alias("low"), F.greatest("high", "chi").alias("high"))
        below = cut(r)
        reach.append(below)
    full = reach[0]
    for part in reach[1:]:
        full = full.unionByName(part)
    apart = other.where("x < y and (ypre < xpre or ypre >= xpre + xsize) and (xpre < ypre or xpre >= ypre + ysize)").select(F.col("x").alias("from_user_id"), F.col("y").alias("to_user_id"))
    up = tree.where("p is not null").select(F.col("v").alias("u"), F.col("pre").alias("upre"), F.col("size").alias("usize"))
    joined = full.join(up, F.col("p") == F.col("u")).where("low < upre or high >= upre + usize").select(F.col("v").alias("from_user_id"), F.col("p").alias("to_user_id"))
    stems = tree.where("p is not null").select(F.col("v").alias("id"), "p")
    labelled = components(stems.select("id"), apart.unionByName(joined))
    named = stems.join(labelled, "id")
    member = named.select("id", "component").unionByName(named.select(F.col("p").alias("id"), "component"))
    return member.distinct().groupBy("id").agg(F.count("*").cast("long").alias("blocks"))


def bridges(users: DataFrame, follows: DataFrame, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """(id, impact): for every user with a follow, by how many the components grow if it is removed; 0 is kept.

    That number is the blocks the user stands in, less one. Self-follows and parallel follows do not count as links.
    """
    links = cut(_simple(follows))
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    parts = components(ids, links.select(F.col("a").alias("from_user_id"), F.col("b").alias("to_user_id")))
    tagged = cut(links.join(parts, F.col("a") == F.col("id")).select("a", "b", "component"))
    sizes = tagged.groupBy("component").agg(F.count("*").alias("links"))
    large = cut(sizes.where(F.col("links") > component_limit).select("component"))
    blocks = tagged.join(large, "component", "left_anti").groupBy("component").applyInPandas(lambda pdf: _blocks_kernel(pdf), "id long, blocks long")
    if not large.isEmpty():
        rest = tagged.join(large, "component", "left_semi").select("a", "b")
        blocks = blocks.unionByName(_blocks_distributed(rest, parts.join(large, "component", "left_semi").select("id", "component")))
    candidates = follows.select(F.col("from_user_id").alias("cid")).distinct().join(users.select("id"), F.col("cid") == F.col("id"), "left_semi")
    return candidates.join(blocks, F.col("cid") == F.col("id"), "left").select(F.col("cid").alias("id"), F.greatest(F.coalesce(F.col("blocks"), F.lit(0)) - 1, F.lit(0)).cast("long").alias("impact"))


def visit_order(n: int) -> np.ndarray:
    """The fixed visiting order of n nodes: swap i with (i * VISIT mod 2^64) mod (i + 1), from the last down to 1."""
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = (i * VISIT & 0xFFFFFFFFFFFFFFFF) % (i + 1)
        order[i], order[j] = order[j], order[i]
    return np.array(order)


def _moves_kernel(m: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """(id, community) of one component: local moves in visiting order until a sweep changes nothing."""
        ids, src = np.unique(pdf.src.to_numpy(), return_inverse=True)
        dst = np.searchsorted(ids, pdf.dst.to_numpy())
        n = len(ids)
        turn = np.zeros(n)
        turn[src] = pdf.turn.to_numpy()
        order = np.argsort(src, kind="stable")
        near, start = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
        degree = np.diff(start).astype(float).tolist()
        home, total = list(range(n)), list(degree)
        queue = np.argsort(turn, kind="stable").tolist()
        for _ in range(SWEEPS):
            moved = False
            for v in queue:
                inside: dict[int, int] = {}
                for w in near[start[v] : start[v + 1]]:
                    inside[home[w]] = inside.get(home[w], 0) + 1
                old, k = home[v], degree[v]
                best, gain = old, 0.0
                for c in sorted(inside):
                    if c != old:
                        g = (inside[c] - inside.get(old, 0)) / m - k * (total[c] - (total[old] - k)) / (2 * m * m)
                        if g > gain:
                            best, gain = c, g
                if best != old:
                    total[old] -= k
                    total[best] += k
                    home[v] = best
                    moved = True
            if not moved:
                break
        least: dict[int, int] = {}
        for v, c in enumerate(home):
            least.setdefault(c, v)
        return pd.DataFrame({"id": ids, "community": ids[[least[c] for c in home]]})

    return run


def _moves_distributed(entries: DataFrame, m: float) -> DataFrame:
    """Communities of components too large for a kernel: a sweep has ``TURNS`` steps, and in each the nodes whose turn it is (by
    a hash) move at once to the neighbouring community of the largest gain. An approximation of the sequential order."""
    degree = cut(entries.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("k")))
    home = cut(degree.select("v", "k", F.col("v").alias("c")))
    moved = 0
    for step in range(SWEEPS * TURNS):
        totals = home.groupBy(F.col("c").alias("tc")).agg(F.sum("k").alias("tot"))
        there = home.select(F.col("v").alias("w"), F.col("c").alias("wc"))
        inside = entries.join(there, F.col("dst") == F.col("w")).groupBy(F.col("src").alias("iv"), F.col("wc")).agg(F.count("*").alias("links"))
        own = home.join(totals, F.col("c") == F.col("tc")).select("v", "k", "c", F.col("tot").alias("old_tot"))
        scored = own.join(inside, F.col("v") == F.col("iv")).join(totals, F.col("wc") == F.col("tc"))
        stay = inside.select(F.col("iv").alias("sv"), F.col("wc").alias("sc"), F.col("links").alias("stay"))
        scored = scored.join(stay, (F.col("v") == F.col("sv")) & (F.col("c") == F.col("sc")), "left")
        gain = (F.col("links") - F.coalesce("stay", F.lit(0))) / F.lit(m) - F.col("k") * (F.col("tot") - (F.col("old_tot") - F.col("k"))) / F.lit(2 * m * m)
        turn = F.pmod(F.xxhash64("v", F.lit(step // TURNS)), F.lit(TURNS)) == step % TURNS
        moves = scored.where((F.col("wc") != F.col("c")) & turn).withColumn("gain", gain).where("gain > 0")
        best = moves.groupBy("v").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("wc").alias("to"))).getField("to").alias("to"))
        after = cut(home.join(best, "v", "left").select("v", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
        moved += after.where("moved").count()
        home = after.select("v", "k", "c")
        if step % TURNS == TURNS - 1:
            if not moved:
                break
            moved = 0
    names = home.groupBy("c").agg(F.min("v").alias("community"))
    return home.join(names, "c").select(F.col("v").alias("id"), "community")


def communities(users: DataFrame, follows: DataFrame, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """(id, community): one level of modularity moves over all users; a community is named by its smallest id.

    Moves never leave a component, so components are worked on apart with the global number of links and the global
    visiting order. Ties go to the smallest community. Follows of unknown users are left out; users without follows are
    alone.
    """
    known = users.select(F.col("id").alias("u")).distinct()
    inner = cut(follows.join(known, F.col("from_user_id") == F.col("u"), "left_semi").join(known, F.col("to_user_id") == F.col("u"), "left_semi"))
    m = float(inner.count())
    if not m:
        return users.select("id", F.col("id").alias("community")).distinct()
    entries = adjacency(inner).select("src", "dst")
    parts = components(users, inner)
    tagged = cut(entries.join(parts, F.col("src") == F.col("id")).select("src", "dst", "component"))
    large = cut(tagged.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > 2 * component_limit).select("component"))
    order = turns(users)
    turned = tagged.join(large, "component", "left_anti").join(order, F.col("src") == F.col("tid")).select("src", "dst", "component", "turn")
    moved = turned.groupBy("component").applyInPandas(_moves_kernel(m), "id long, community long")
    if not large.isEmpty():
        moved = moved.unionByName(_moves_distributed(cut(tagged.join(large, "component", "left_semi").select("src", "dst")), m))
    return users.select("id").distinct().join(moved.withColumnRenamed("id", "mid"), F.col("id") == F.col("mid"), "left").select("id", F.coalesce("community", "id").alias("community"))


#: Users whose visiting order the driver computes, 16 bytes each; beyond it the order is derived by joins.
ORDERED_USERS = 1_000_000


def turns(users: DataFrame, limit: int = ORDERED_USERS) -> DataFrame:
    """(tid, turn): when each user is visited, the same at every size.

    Swaps go from the last place down, so a place is settled by its own swap, and what stands at place i before its swap is
    what the latest earlier swap brought there, the one of the smallest larger place that swaps with i. Places so form
    a forest whose roots still hold their first user, and the swap of i takes from its partner's place what stands there.
    """
    ids = users.select("id").distinct()
    if ids.limit(limit + 1).count() <= limit:
        nodes = np.sort(np.array([r.id for r in ids.toLocalIterator()], np.int64))
        turn = np.empty(len(nodes), np.int64)
        turn[visit_order(len(nodes))] = np.arange(len(nodes))
        return users.sparkSession.createDataFrame(pd.DataFrame({"tid": nodes, "turn": turn}))
    placed = cut(numbered(ids, [], ["id"], "n").select("id", (F.col("n") - 1).alias("i")))
    # (i * VISIT mod 2^64) mod (i + 1) in unsigned arithmetic, as whole decimals.
    product = F.col("i").cast("decimal(19,0)") * F.lit(Decimal(VISIT)) % F.lit(Decimal(1 << 64))
    swaps = cut(placed.where("i > 0").select("i", (product % (F.col("i") + 1).cast("decimal(20,0)")).cast("long").alias("j")))
    # Of the swaps with one partner, a few each: the next larger, also for the partner itself.
    asked = swaps.select("j", "i", F.lit(True).alias("swap")).unionByName(placed.select(F.col("i").alias("j"), "i", F.lit(False).alias("swap")))
    later = Window.partitionBy("j").orderBy(F.desc("i"), F.desc("swap")).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("swap"), F.col("i")), ignorenulls=True).over(later)
    # A swap with itself moves nothing, and a place is not brought anything by its own swap.
    found = cut(asked.withColumn("next", latest).select("j", "i", "swap", F.when(F.col("next") != F.col("i"), F.col("next")).alias("next")))
    chain = found.where(~F.col("swap")).select(F.col("i").cast("string").alias("node"), F.col("next").cast("string").alias("parent"))
    root = peel(chain).select(F.col("node").cast("long").alias("k"), F.col("root").cast("long").alias("r"))
    order = found.where(F.col("swap")).select("i", F.col("j"), "next").join(root, F.col("next") == F.col("k"), "left").select("i", F.coalesce("r", "j").alias("place"))
    # Place 0 is settled last: it holds what the last swap with it brought.
    order = order.unionByName(root.where("k = 0").select(F.lit(0).cast("long").alias("i"), F.col("r").alias("place")))
    return order.join(placed.select(F.col("i").alias("place"), F.col("id").alias("tid")), "place").select("tid", F.col("i").alias("turn"))


def modularity(follows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the sum over adjacency entries within a label of 1 - k_a k_b / 2m, divided by 2m; 0 without links.

    ``labels`` has (id, community). Unlike the textbook formula the null term counts adjacent pairs only.
    """
    entries = adjacency(follows).select("src", "dst")
    degree = entries.groupBy("src").agg(F.count("*").alias("k"))
    node = labels.join(degree, F.col("id") == F.col("src")).select("id", "community", "k")
    a, b = node.select(F.col("id").alias("ai"), F.col("community").alias("ac"), F.col("k").alias("ak")), node.select(F.col("id").alias("bi"), F.col("community").alias("bc"), F.col("k").alias("bk"))
    total = entries.agg(F.count("*").cast("double").alias("m2"))
    joined = entries.join(a, F.col("src") == F.col("ai")).join(b, F.col("dst") == F.col("bi")).where("ac = bc").join(F.broadcast(total))
    inner = joined.agg(F.sum((F.lit(1.0) - F.col("ak") * F.col("bk") / F.col("m2")) / F.col("m2")).alias("q"))
    return inner.select(F.round(F.coalesce("q", F.lit(0.0)), 6).alias("modularity"))


def community_cards(labels: DataFrame, follows: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    """(community, members, communities, representatives): the largest communities with their three best-connected logins;
    communities is their number before the limit."""
    degree = adjacency(follows).groupBy("src").agg(F.count("*").alias("k"))
    ranked = labels.join(degree, F.col("id") == F.col("src"), "left").join(users.select(F.col("id").alias("ui"), "login"), F.col("id") == F.col("ui"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.coalesce("k", F.lit(0))), "id"))
    top = ranked.withColumn("place", place).where("place <= 3").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "login"))).getField("login").alias("representatives"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("members"))
    total = sizes.agg(F.count("*").alias("communities"))
    cards = sizes.join(top, "community").join(F.broadcast(total)).orderBy(F.desc("members"), "community")
    return cards.limit(limit) if limit else cards


def community_of(labels: DataFrame, users: DataFrame, login: str) -> DataFrame:
    """(community, login): all members of the community the user of ``login`` is in; no rows for an unknown login."""
    mine = users.where(F.col("login") == login).select(F.col("id").alias("me")).join(labels, F.col("me") == F.col("id")).select("community")
    return labels.join(F.broadcast(mine), "community").join(users.select("id", "login"), "id").select("community", "login")


def bridge_cards(impacts: DataFrame, users: DataFrame, profiles: DataFrame, limit: int = 20) -> DataFrame:
    """(login, following, followers, impact) of ``bridges``, the largest impact first; counts are null without a profile."""
    named = impacts.join(users.select("id", "login"), "id").join(profiles.select(F.col("user_id").alias("pid"), "following", "followers"), F.col("id") == F.col("pid"), "left")
    cards = named.orderBy(F.desc("impact"), "id").select("login", "following", "followers", "impact")
    return cards.limit(limit) if limit else cards
