"""Formatting scalars as column expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "█"


def fixed(x: Column, places: int) -> Column:
    """A number of 0 or more with one or two decimals, rounded from its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form instead, which differs where that form ends in 5. The product with
    a power of ten is taken with its rounding error: halves of the mantissa times a small number are exact.
    """
    scale = 10**places
    x = x.cast("double")
    near = x * float(scale)
    wide = x * 134217729.0
    upper = wide - (wide - x)
    error = (upper * float(scale) - near) + (x - upper) * float(scale)
    down = F.floor(near)
    beyond = (near - down) - 0.5
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & (down % 2 == 1))))
    digits = down + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(digits / scale).cast("string"), F.lit("."), F.lpad((digits % scale).cast("string"), places, "0"))


def num(n: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(n.cast("long"), 0)


def visible_width(s: Column) -> Column:
    """Display columns without colour sequences: wide East Asian letters count twice, combining marks not at all."""
    bare = F.regexp_replace(s, "\x1b\\[[^m]*m", "")
    wide = F.length(F.regexp_replace(bare, r"[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", ""))
    marks = F.length(F.regexp_replace(bare, r"[^\p{Mn}​]", ""))
    return F.length(bare) + wide - marks


def truncate(s: Column, width: int) -> Column:
    """At most ``width`` display columns, the last an ellipsis where something was left out."""
    if width <= 0:
        return F.when(s.isNotNull(), "")
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    # The letters that fit beside an ellipsis: (columns so far, text so far), closed at the first that does not.
    start = F.struct(F.lit(0).alias("w"), F.lit("").alias("t"), F.lit(False).alias("full"))

    def add(acc: Column, c: Column) -> Column:
        w = acc["w"] + visible_width(c)
        full = acc["full"] | (w > width - 1)
        return F.struct(F.when(full, acc["w"]).otherwise(w).alias("w"), F.when(full, acc["t"]).otherwise(F.concat(acc["t"], c)).alias("t"), full.alias("full"))

    return F.when(visible_width(s) <= width, s).otherwise(F.concat(F.aggregate(letters, start, add)["t"], F.lit("…")))


def uptime(seconds: Column) -> Column:
    h, m, s = (F.floor(seconds / 3600).cast("string"), F.floor(seconds % 3600 / 60).cast("string"), F.floor(seconds % 60).cast("string"))
    return F.when(seconds >= 3600, F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s"))).when(seconds >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def bar(value: Column, most: Column, width: int) -> Column:
    """Blocks in proportion to ``most``, at least one; empty where ``most`` is 0."""
    blocks = F.floor(value.cast("double") / most * width).cast("int")
    return F.when(most == 0, "").otherwise(F.repeat(F.lit(BLOCK), F.greatest(blocks, F.lit(1))))


def weight_bar(value: Column, most: Column, width: int) -> Column:
    """Blocks in proportion, at most ``width``, none where undefined (0 of 0, infinite of infinite)."""
    share = F.when((most == 0) | (F.abs(most) == float("inf")), F.when(value < most, 0.0)).otherwise(value.cast("double") / most)
    # least() passes over nulls, so an undefined share is asked for first.
    return F.repeat(F.lit(BLOCK), F.when(share.isNull(), 0).otherwise(F.least(F.floor(share * width), F.lit(width))).cast("int"))


def weight_colour(value: Column, most: Column) -> Column:
    share = F.when(most > 0, value / most).otherwise(0.0)
    return F.when(share > 0.66, "high").when(share > 0.33, "middle").otherwise("low")


def density_bucket(d: Column) -> Column:
    return F.concat_ws(" ", F.when(d > 0.001, "high").when(d > 0.0001, "middle").otherwise("low"), F.format_string("%.6f", d))


def impact_bucket(n: Column) -> Column:
    return F.concat_ws(" ", F.when(n >= 1000, "high").when(n >= 100, "middle").otherwise("low"), n.cast("string"))


def modularity_bucket(q: Column) -> Column:
    return F.concat_ws(" ", F.when(q > 0.5, "high").when(q > 0.3, "middle").otherwise("low"), F.format_string("%.4f", q))


def quota_bucket(remaining: Column) -> Column:
    return F.when(remaining >= 1000, "ample").when(remaining >= 100, "low").otherwise("critical")


def pad_right(s: Column, width: int) -> Column:
    """Padded with blanks to ``width`` display columns; longer text is kept whole."""
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(F.lit(width) - visible_width(s), F.lit(0))))


def pad_left(s: Column, width: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - visible_width(s), F.lit(0))), s)


def date_prefix(s: Column) -> Column:
    return F.substring(s, 1, 10)


def file_size(size: Column) -> Column:
    return F.when(size > 1_000_000, F.concat(fixed(size / 1_000_000.0, 1), F.lit(" MB"))).otherwise(F.concat(F.floor(size / 1000).cast("string"), F.lit(" KB")))


def quota_reset(reset: Column, now: Column) -> Column:
    """Clock time of the reset and what is left until then; 'unknown' for 0."""
    left = F.greatest(reset - now, F.lit(0))
    rest = F.when(left < 60, F.concat(left.cast("string"), F.lit("s"))).when(left < 3600, F.concat(F.floor(left / 60).cast("string"), F.lit("m "), (left % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(left / 3600).cast("string"), F.lit("h "), F.floor(left % 3600 / 60).cast("string"), F.lit("m")))
    return F.when(reset == 0, "unknown").otherwise(F.concat(F.date_format(F.timestamp_seconds(reset), "HH:mm:ss"), F.lit(" ("), rest, F.lit(")")))


def percent(share: Column) -> Column:
    return F.concat(fixed(share * 100.0, 1), F.lit("%"))


def two_decimals(x: Column) -> Column:
    return fixed(x, 2)


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def path_chain(logins: Column) -> Column:
    return F.array_join(logins, " · ")


def directed_edge(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" → "), b)


def hops(path: Column) -> Column:
    return F.greatest(F.size(path) - 1, F.lit(0))


def listed(items: Column, most: int) -> Column:
    """The first ``most`` items and, if there are more, a last one that counts them."""
    rest = F.array(F.concat(F.lit("… "), (F.size(items) - most).cast("string"), F.lit(" more")))
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), rest)).otherwise(items)
