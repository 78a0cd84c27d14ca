"""The pN queries of the llm operators and the SQL for those that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, digits

from pyspark.sql import functions as F

from arbora.llm import bpe, canonical, leaks, names, sentences, setjoin
from arbora.runtime import table


def p2_found(spark, d):
    members, _ = names.same_person(table(spark, d, "user_profiles"), table(spark, d, "canonical_values"))
    return names.account_pairs(members)


def _follow_sets(spark, d):
    return table(spark, d, "edges").where("edge_type = 'follows' and is_active = 1").select("from_user_id", "to_user_id")


def p3_found(spark, d):
    links, members = setjoin.similar_sets(_follow_sets(spark, d), "from_user_id", "to_user_id")
    return setjoin.expand(links, members).select(F.col("a").alias("from_user_id_a"), F.col("b").alias("from_user_id_b"))


def p7_found(spark, d):
    return canonical.map_values(table(spark, d, "user_profiles"), table(spark, d, "canonical_values"))


def p7_misses(spark, d):
    """Values of each field that mean no entry, and how many users have them."""
    return p7_found(spark, d).where("ref_id = 0").groupBy("field").agg(F.count("*").alias("users"))


def p8_ids(spark, d):
    return bpe.encode_table(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark, d):
    """In how many documents each leaked item stands."""
    return leaks.leaked_items(p9_found(spark, d))


def p10_found(spark, d):
    return sentences.split_table(table(spark, d, "documents"))


def p10_counts(spark, d):
    """Sentences and their mean length of every document that has any."""
    found = p10_found(spark, d)
    return found.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 6).alias("mean_length"))


_SETS = """
s AS (SELECT DISTINCT from_user_id AS k, to_user_id AS t FROM edges WHERE edge_type = 'follows' AND is_active = 1 AND from_user_id IS NOT NULL AND to_user_id IS NOT NULL),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k HAVING count(*) >= 5),
f AS (SELECT s.k, s.t, n.n FROM s JOIN n USING (k)),
o AS (SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS o FROM f a JOIN f b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2, 3, 4)
"""

# Marks and signs go as in the operator; of case folding and compatibility forms this has what these texts need: ß and the
# full-width letters and digits.
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ascii_lowercase + digits)
_LETTERS = f"regexp_replace(strip_accents(replace(translate(lower(text), '{_WIDE}', '{ascii_lowercase + digits}'), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_RUNS = f"""
dl AS (SELECT doc_id, {_LETTERS} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
il AS (SELECT item_id, {_LETTERS} AS t FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, substr(t, CAST(i AS INTEGER), 50) AS w FROM dl, unnest(generate_series(1, length(t) - 49)) g(i)),
iw AS (SELECT DISTINCT item_id, substr(t, CAST(i AS INTEGER), 50) AS w FROM il, unnest(generate_series(1, length(t) - 49)) g(i)),
lk AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w))
"""

QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p7_found": p7_found,
    "p7_misses": p7_misses,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_counts": p10_counts,
}

ORACLES = {
    "p9_found": f"WITH {_RUNS} SELECT * FROM lk",
    "p9_items": f"WITH {_RUNS} SELECT item_id, count(*) AS documents FROM lk GROUP BY 1",
    "p3_found": f"WITH {_SETS} SELECT ka AS from_user_id_a, kb AS from_user_id_b FROM o WHERE o * 8 >= (na + nb) * 3",
}
