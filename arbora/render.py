"""Results as text for a terminal: titles, trees and grids. Everything here is about a screenful of rows."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


def width(text: str) -> int:
    """Display columns without colour sequences."""
    bare = re.sub("\x1b\\[[^m]*m", "", text)
    return sum(0 if unicodedata.combining(c) or c in "​‍️" else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in bare)


def padded(text: str, columns: int, right: bool = False) -> str:
    room = " " * max(0, columns - width(text))
    return room + text if right else text + room


def heading(title: str, remark: str = "") -> str:
    return f"== {title}" + (f" ({remark})" if remark else "")


def closing(text: str) -> str:
    return f"-- {text}"


@dataclass
class Node:
    text: str
    children: list[Node] = field(default_factory=list)


def tree(root: Node) -> str:
    """A node per line below its parent, joined by rules."""
    lines, open_nodes = [root.text], [(c, "", k + 1 == len(root.children)) for k, c in reversed(list(enumerate(root.children)))]
    while open_nodes:
        node, rule, last = open_nodes.pop()
        lines.append(f"{rule}{'└─ ' if last else '├─ '}{node.text}")
        below = rule + ("   " if last else "│  ")
        open_nodes += [(c, below, k + 1 == len(node.children)) for k, c in reversed(list(enumerate(node.children)))]
    return "\n".join(lines)


def shown(value) -> str:
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{value:,}"
    return ", ".join(map(shown, value)) if isinstance(value, (list, tuple)) else str(value)


def grid(columns: list[str], rows: list[list]) -> str:
    """Rows under their column names, numbers to the right; no rows give the names alone."""
    numeric = [bool(rows) and all(r[i] is None or isinstance(r[i], (int, float)) for r in rows) for i in range(len(columns))]
    texts = [columns, *[[shown(v) for v in r] for r in rows]]
    sizes = [max(width(t[i]) for t in texts) for i in range(len(columns))]
    return "\n".join("  ".join(padded(t[i], sizes[i], numeric[i]) for i in range(len(columns))).rstrip() for t in texts)


def report(title: str, rows: list[dict]) -> str:
    """One row as a tree of its columns, several as a grid."""
    if len(rows) == 1:
        parts = [Node(k, [Node(shown(x)) for x in v]) if isinstance(v, list) else Node(f"{k}: {shown(v)}") for k, v in rows[0].items()]
        return tree(Node(heading(title), parts))
    columns = list(rows[0]) if rows else []
    return "\n".join([heading(title), *([grid(columns, [list(r.values()) for r in rows])] if rows else []), closing(f"{len(rows)} rows")])
