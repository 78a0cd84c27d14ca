"""Parent-child links to full hierarchies, by bottom-up leaf peeling.

A round takes nodes off the living ones in two ways, each with one link up and the number of levels it spans:

* **peel**: a node without living children leaves and sends its subtree size to the node it hangs on;
* **splice**: a node with one living child, none of whose other children leaves in this round, is skipped if its hashed
  name is larger than those of its two neighbours: the child hangs on the node above, and the link grows. Without this a
  chain of length *n* would need *n* rounds. Neighbours never leave together, so a removed node hangs on a living one.

The living nodes shrink by a constant factor a round. As soon as at most ``residue`` of them are left (counted), one
task ends the peeling by the same rules; what can never be peeled consists of loops. Then the rounds are run in reverse:
a removed node gets root, depth and path from the node it hung on, and a spliced one its subtree size from its child.
Both directions read as many rows in all as a few times the nodes.

Children are only ever counted, never listed per parent: a parent with a third of all rows is an ordinary partially
aggregated group, and all joins of a round have unique keys. Descendant lists are rows, not arrays (``descendants``): in
sum they are as long as all depths, whether they are sent up link by link or, as here, read off the paths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.runtime import clean_text, cut, release, stacked

#: Upper bound of rounds; each takes off a constant share, so this is out of reach unless the loop is broken.
MAX_ROUNDS = 400
#: Living nodes that one task may peel to the end, and their names, some 100 bytes each.
RESIDUE = 20_000

_PLACE = "node string, parent string, root string, depth long, in_loop boolean, subtree_size long, path array<string>"


def normalized_links(items: DataFrame, key: str, parent: str, order: list[str]) -> DataFrame:
    """One row (node, parent) per distinct key, compared lower-cased without outer blanks.

    Of several rows the one with the smallest ``order`` columns counts (nulls last). Null and blank keys are no nodes. A
    null, blank or unknown parent becomes null. Equal rows and ties on ``order`` give the same result whatever their
    order: the parent text itself is the last criterion.
    """
    rows = items.select(clean_text(F.col(key)).alias("node"), clean_text(F.col(parent)).alias("parent"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rank = [x for i in range(len(order)) for x in (F.col(f"o{i}").isNull(), F.col(f"o{i}"))]
    first = rows.where("node is not null and node <> ''").groupBy("node").agg(F.min(F.struct(*rank, F.col("parent"))).getField("parent").alias("parent"))
    first = cut(first)
    known = first.select(F.col("node").alias("known"))
    return first.join(known, first.parent == known.known, "left").select("node", F.col("known").alias("parent"))


def _priority(name: str | Column, number: int) -> Column:
    return F.xxhash64(name, F.lit(number))


def peel(links: DataFrame, with_sizes: bool = False, with_paths: bool = False, residue: int = RESIDUE) -> DataFrame:
    """Root, depth and, where asked for, subtree size and path of every node of ``links`` (node, parent; node unique, parent null
    or a node).

    Result: node, parent, root, depth long, in_loop boolean (the way up ends in a loop; then depth is -1, root the
    smallest member of the loop), subtree_size long (the node itself included) and path array<string> from the root to the
    node; these two are null below loops and unless ``with_sizes`` and ``with_paths``. An empty input gives an empty
    result. ``residue`` does not change the result.
    """
    counted = links.where("parent is not null").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n"))
    start = links.join(counted, F.col("node") == F.col("k"), "left")
    alive = cut(start.select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("w"), F.col("node").alias("low"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("carry"), F.array().cast("array<string>").alias("skipped"), F.coalesce("n", F.lit(0)).alias("kids")))
    removed: list[DataFrame] = []
    left = alive.count()
    for number in range(MAX_ROUNDS):
        if left <= residue:
            break
        seen = _round(alive, number)
        states = {r.state: r.n for r in seen.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if not states.keys() & {"leaf", "spliced"}:
            release(seen)
            break
        left = states.get("kept", 0)
        removed.append(seen)
        alive = _reconnect(seen, with_paths)
    else:
        raise RuntimeError("peeling did not end")
    last = alive.repartition(1).mapInPandas(lambda batches: _peel_here(batches, with_paths), _PLACE) if left <= residue else _loops(alive)
    done = [cut(last)]
    for seen in reversed(removed):
        done.append(cut(_placed(seen.where("state <> 'kept'"), stacked(done), with_sizes, with_paths)))
    release(*removed)
    return stacked(done)


def _round(alive: DataFrame, number: int) -> DataFrame:
    """``alive`` after one round, with state (leaf, spliced, kept), and for spliced nodes the only child and what is counted
    on the link to it."""
    stays = F.col("kids") > 0
    sent = alive.where("up is not null").groupBy(F.col("up").alias("k")).agg(
        F.sum(F.when(~stays, F.col("size") + F.col("carry"))).alias("more"),
        F.count_if(stays).alias("n"),
        F.min(F.when(stays, F.col("node"))).alias("only"),
        F.max(F.when(stays, F.col("carry"))).alias("below"),
    )
    joined = alive.join(sent, F.col("node") == F.col("k"), "left")
    alone = stays & (F.col("n") == 1) & F.col("more").isNull() & F.col("up").isNotNull()
    apart = (F.col("up") != F.col("node")) & (F.col("only") != F.col("node")) & (F.col("only") != F.col("up"))
    top = (_priority("node", number) > _priority("up", number)) & (_priority("node", number) > _priority("only", number))
    state = F.when(~stays, "leaf").when(F.coalesce(alone & apart & top, F.lit(False)), "spliced").otherwise("kept")
    return cut(joined.select("node", "parent", "up", "w", "low", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "carry", "skipped", F.when(stays, F.col("n")).otherwise(0).cast("long").alias("kids"), "only", "below", state.alias("state")))


def _reconnect(seen: DataFrame, with_paths: bool) -> DataFrame:
    """The kept nodes, those below a spliced one hung on the node above it."""
    over = seen.where("state = 'spliced'").select(F.col("only").alias("c"), F.col("node").alias("over"), F.col("up").alias("to"), F.col("w").alias("ow"), F.col("low").alias("olow"), (F.col("size") + F.col("carry")).alias("ocarry"), F.col("skipped").alias("oskipped"))
    joined = seen.where("state = 'kept'").join(over, F.col("node") == F.col("c"), "left")
    jump = F.col("c").isNotNull()
    return joined.select(
        "node",
        "parent",
        F.when(jump, F.col("to")).otherwise(F.col("up")).alias("up"),
        F.when(jump, F.col("w") + F.col("ow")).otherwise(F.col("w")).alias("w"),
        F.when(jump, F.least("low", "olow")).otherwise(F.col("low")).alias("low"),
        "size",
        F.when(jump, F.col("carry") + F.col("ocarry")).otherwise(F.col("carry")).alias("carry"),
        F.when(jump & F.lit(with_paths), F.concat("oskipped", F.array("over"), "skipped")).otherwise(F.col("skipped")).alias("skipped"),
        "kids",
    )


def _placed(gone: DataFrame, later: DataFrame, with_sizes: bool, with_paths: bool) -> DataFrame:
    """Places of the nodes removed in a round, given those of all nodes that stayed longer."""
    above = later.select(F.col("node").alias("a"), F.col("root").alias("aroot"), F.col("depth").alias("adepth"), F.col("in_loop").alias("aloop"), F.col("path").alias("apath"))
    joined = gone.join(above, F.col("up") == F.col("a"), "left")
    top, looped = F.col("up").isNull(), F.coalesce("aloop", F.lit(False))
    size, path = F.lit(None).cast("long"), F.lit(None).cast("array<string>")
    if with_sizes:
        child = later.select(F.col("node").alias("b"), F.col("subtree_size").alias("bsize"))
        joined = joined.join(child, (F.col("state") == "spliced") & (F.col("only") == F.col("b")), "left")
        size = F.when(~looped, F.col("size") + F.when(F.col("state") == "spliced", F.col("below") + F.col("bsize")).otherwise(0))
    if with_paths:
        path = F.when(top, F.array("node")).when(~looped, F.concat("apath", "skipped", F.array("node")))
    return joined.select(
        "node",
        "parent",
        F.when(top, F.col("node")).otherwise(F.col("aroot")).alias("root"),
        F.when(top, F.lit(0)).when(looped, F.lit(-1)).otherwise(F.col("adepth") + F.col("w")).cast("long").alias("depth"),
        looped.alias("in_loop"),
        size.alias("subtree_size"),
        path.alias("path"),
    )


def _loops(residue: DataFrame) -> DataFrame:
    """Places of nodes none of which could be removed: loops of one or two nodes, other members having been spliced."""
    ahead = residue.select(F.col("node").alias("n2"), F.col("low").alias("low2"))
    root = F.least("low", "low2").alias("root")
    out = residue.join(ahead, F.col("up") == F.col("n2")).select("node", "parent", root, F.lit(-1).cast("long").alias("depth"), F.lit(True).alias("in_loop"))
    return out.withColumns({"subtree_size": F.lit(None).cast("long"), "path": F.lit(None).cast("array<string>")})


def _peel_here(batches, with_paths: bool):
    """Places of a bounded residue of living nodes, by peeling leaf after leaf."""
    rows = pd.concat(list(batches) or [pd.DataFrame()], ignore_index=True)
    if not len(rows):
        return
    names, lows, spans, carried, skipped = (rows[c].tolist() for c in ("node", "low", "w", "carry", "skipped"))
    at = {n: i for i, n in enumerate(names)}
    up = [at[u] if isinstance(u, str) else -1 for u in rows["up"]]
    size, kids = rows["size"].tolist(), [0] * len(names)
    for u in up:
        if u >= 0:
            kids[u] += 1
    order = [i for i, k in enumerate(kids) if not k]
    for i in order:
        u = up[i]
        if u >= 0:
            size[u] += size[i] + carried[i]
            kids[u] -= 1
            if not kids[u]:
                order.append(u)
    root, depth = [""] * len(names), [-1] * len(names)
    looped = [True] * len(names)
    for i in set(range(len(names))) - set(order):
        loop = [i]
        while not root[i] and up[loop[-1]] != i:
            loop.append(up[loop[-1]])
        if not root[i]:
            least = min(lows[j] for j in loop)
            for j in loop:
                root[j] = least
    for i in reversed(order):
        u = up[i]
        if u < 0:
            root[i], depth[i], looped[i] = names[i], 0, False
        else:
            root[i], looped[i] = root[u], looped[u]
            depth[i] = -1 if looped[u] else depth[u] + spans[i]

    def path(i: int) -> list[str]:
        out = []
        while i >= 0:
            out.append(names[i])
            out += reversed(skipped[i])
            i = up[i]
        return out[::-1]

    for lo in range(0, len(names), 1000):
        part = range(lo, min(lo + 1000, len(names)))
        yield pd.DataFrame(
            {
                "node": [names[i] for i in part],
                "parent": rows["parent"][lo : lo + 1000].tolist(),
                "root": [root[i] for i in part],
                "depth": [depth[i] for i in part],
                "in_loop": [looped[i] for i in part],
                "subtree_size": pd.array([None if looped[i] else size[i] for i in part], "Int64"),
                "path": [path(i) if with_paths and not looped[i] else None for i in part],
            }
        )


def descendants(nodes: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) of the tree nodes of a ``peel(..., with_paths=True)`` result, a row each.

    A root with any number of descendants is that many rows spread over all tasks; nodes below loops have none.
    """
    pairs = nodes.where("path is not null").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def hierarchy(items: DataFrame, key: str = "login", parent: str = "parent_login", order: tuple[str, ...] = ("queued_at", "seq"), with_sizes: bool = False, with_paths: bool = False) -> DataFrame:
    """``peel`` of ``normalized_links``: raw parent-child rows to one row per distinct key.

    Null or blank keys, repeated rows, ties, unknown parents, loops of any length (one included) and empty inputs are
    all defined there; other columns of ``items``, whatever their names, are not touched.
    """
    return peel(normalized_links(items, key, parent, list(order)), with_sizes, with_paths)
