"""Queries of exact and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import exact, fuzzy
from kinfold.operators.storage import stored
from kinfold.plans.common import PART_KEY, sql_aggressive, sql_text, table

KINDS = {"p_name": "text", "p_brand": "text", "p_type": "text"}
ASCII = {"unicode": False}


def exact_groups_part(spark, sf_dir):
    return exact.groups(table(spark, sf_dir, "part"), "p_partkey", PART_KEY, KINDS, **ASCII)


def _gappy(spark, sf_dir):
    """Parts with gaps, so that pairs can complete each other."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select("p_partkey", "p_name", "p_brand", F.when(k % 2 == 0, F.col("p_type")).alias("p_type"), F.when(k % 3 != 0, F.col("p_size")).alias("p_size"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("p_retailprice"))


def exact_groups_actions(spark, sf_dir):
    return exact.groups(_gappy(spark, sf_dir), "p_partkey", ["p_name", "p_brand"], KINDS, **ASCII).select("group_id", "group_size", "recommended_action")


def exact_members_part(spark, sf_dir):
    return exact.members(table(spark, sf_dir, "part"), "p_partkey", PART_KEY, KINDS, **ASCII)


def exact_stats_part(spark, sf_dir):
    return exact.statistics(exact.groups(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand"], KINDS, **ASCII))


def exact_groups_customer(spark, sf_dir):
    return exact.by_composite_key(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_mktsegment"], ["numeric", "text"], **ASCII).select("group_id", "group_size", "recommended_action")


def exact_groups_orders(spark, sf_dir):
    return exact.members(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_orderdate"], {"o_custkey": "numeric", "o_orderdate": "date"}, **ASCII)


def exact_groups_raw(spark, sf_dir):
    """Raw keys, where a null is a text of its own."""
    return exact.groups(_gappy(spark, sf_dir), "p_partkey", ["p_name", "p_type"], use_normalized=False).select("group_id", "group_size", "key_hash")


def exact_single_field(spark, sf_dir):
    return exact.by_single_field(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", **ASCII).select("group_id", "group_size")


def exact_groups_documents(spark, sf_dir):
    """Whole texts, keyed as they are."""
    docs = table(spark, sf_dir, "documents")
    return exact.members(docs, "doc_id", ["text"], use_normalized=False)


def exact_group_names(spark, sf_dir):
    return exact.named(exact.groups(table(spark, sf_dir, "part"), "p_partkey", PART_KEY, KINDS, **ASCII)).select("group_id", "group_name")


FUZZY = {"p_name": "text_aggressive", "p_brand": "text_aggressive", "p_type": "text_aggressive"}


def _keys(spark, sf_dir):
    return fuzzy.keys(table(spark, sf_dir, "part"), "p_partkey", PART_KEY, FUZZY, unicode=False)


def fuzzy_keys(spark, sf_dir):
    return _keys(spark, sf_dir)


def _blocks(spark, sf_dir):
    return fuzzy.blocked(_keys(spark, sf_dir))


def fuzzy_blocks(spark, sf_dir):
    return fuzzy.block_sizes(_blocks(spark, sf_dir))


def fuzzy_pairs_levenshtein(spark, sf_dir):
    """Distinct keys of each block."""
    return fuzzy.pairs(stored(fuzzy.classes(_blocks(spark, sf_dir)), "classes"), "levenshtein", 90.0)


def _scored(algorithm, threshold):
    def query(spark, sf_dir):
        return fuzzy.grouped(_blocks(spark, sf_dir), algorithm, threshold)[0]

    return query


def fuzzy_members(spark, sf_dir):
    return fuzzy.grouped(_blocks(spark, sf_dir), "levenshtein", 96.0)[1]


def fuzzy_stats(spark, sf_dir):
    return fuzzy.statistics(fuzzy.grouped(_blocks(spark, sf_dir), "levenshtein", 96.0)[0])


def combined_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found, _ = fuzzy.grouped(_blocks(spark, sf_dir), "levenshtein", 96.0)
    return fuzzy.combined(stored(exact.groups(part, "p_partkey", PART_KEY, KINDS, **ASCII), "exact"), found)


_MEMBERS = "SELECT min(p_partkey) OVER w AS group_id, p_partkey AS record_id, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY {})"
_PART = ", ".join(sql_text(c) for c in PART_KEY)
_GAPPY = "SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS p_retailprice FROM part"
_SIZED = "CASE WHEN n = 2 THEN CASE WHEN {c} THEN 'merge' ELSE 'keep_first' END WHEN n <= 5 THEN 'merge' ELSE 'flag' END"
_COMPLEMENT = "hi - lo > 1.2 OR (t = 1)::INT + (s = 1)::INT + (r = 1)::INT > 1.2"
_K = f"concat_ws(' ', {', '.join(sql_aggressive(c) for c in PART_KEY)})"
_BLOCKED = f"""k AS (SELECT p_partkey AS id, {_K} AS key FROM part),
c AS (SELECT count(*) AS n FROM k),
b AS (SELECT id, key, CASE WHEN n * (n - 1) // 2 <= 100000 THEN 'all' ELSE lower(substr(key, 1, 2)) || '_' || (length(key) // 10)::VARCHAR END AS block FROM k, c WHERE key <> ''),
d AS (SELECT block, key, min(id) AS id, count(*) AS n FROM b GROUP BY block, key)"""
_SCORE = "100.0::DOUBLE * (greatest(length(x.key), length(y.key)) - levenshtein(x.key, y.key)) / greatest(length(x.key), length(y.key), 1)"
_PAIRS = f"e AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, {_SCORE} AS score FROM d x JOIN d y ON x.block = y.block AND x.id < y.id WHERE {_SCORE} >= {{t}})"
_GROUPS = (
    f"WITH RECURSIVE {_BLOCKED}, {_PAIRS.format(t='96.0')}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), "
    "q AS (SELECT id, id AS reach FROM d UNION SELECT q.id, u.b FROM q JOIN u ON u.a = q.reach), "
    "m AS (SELECT id, min(reach) AS g FROM q GROUP BY id), o AS (SELECT d.*, m.g FROM d JOIN m USING (id)), "
    "w AS (SELECT g, sum(n)::BIGINT AS size, sum(n * (n - 1) / 2) AS own FROM o GROUP BY g), "
    "v AS (SELECT m.g, sum(na * nb * score) AS total, sum(na * nb) AS links FROM e JOIN m ON m.id = e.a GROUP BY m.g), "
    "z AS (SELECT w.g AS group_id, size AS group_size, round_even((coalesce(total, 0.0) + own * 100.0) / (coalesce(links, 0) + own), 1)::DOUBLE AS similarity_score FROM w LEFT JOIN v USING (g) WHERE size > 1) "
)
_AS_GROUPS = "group_id, group_size, similarity_score, 'fuzzy' AS detection_method, 'flag' AS recommended_action FROM z"
_EXACT_ROWS = f"SELECT min(p_partkey) AS group_id, count(*) AS group_size, 100.0::DOUBLE AS similarity_score, 'exact' AS detection_method, CASE WHEN count(*) = 2 THEN 'keep_first' WHEN count(*) <= 5 THEN 'merge' ELSE 'flag' END AS recommended_action FROM part GROUP BY {_PART} HAVING count(*) > 1"

QUERIES = {
    "exact_groups_part": (
        exact_groups_part,
        f"SELECT min(p_partkey) AS group_id, count(*) AS group_size, 100.0::DOUBLE AS similarity_score, 'exact' AS detection_method, sha256(concat_ws('||', {_PART})) AS key_hash, CASE WHEN count(*) = 2 THEN 'keep_first' WHEN count(*) <= 5 THEN 'merge' ELSE 'flag' END AS recommended_action FROM part GROUP BY {_PART} HAVING count(*) > 1",
    ),
    "exact_groups_actions": (
        exact_groups_actions,
        f"WITH p AS ({_GAPPY}), f AS (SELECT *, (p_type IS NOT NULL)::INT AS ft, (p_size IS NOT NULL)::INT AS fs, (p_retailprice IS NOT NULL)::INT AS fr FROM p), g AS (SELECT min(p_partkey) AS group_id, count(*) AS n, max(ft + fs + fr) AS hi, min(ft + fs + fr) AS lo, sum(ft) AS t, sum(fs) AS s, sum(fr) AS r FROM f GROUP BY {sql_text('p_name')}, {sql_text('p_brand')} HAVING count(*) > 1) SELECT group_id, n AS group_size, {_SIZED.format(c=_COMPLEMENT)} AS recommended_action FROM g",
    ),
    "exact_members_part": (exact_members_part, f"SELECT group_id, record_id FROM ({_MEMBERS.format(_PART)}) WHERE n > 1"),
    "exact_stats_part": (
        exact_stats_part,
        f"WITH g AS (SELECT count(*) AS n FROM part GROUP BY {sql_text('p_name')}, {sql_text('p_brand')} HAVING count(*) > 1) SELECT count(*) AS total_groups, sum(n)::BIGINT AS total_records, avg(n) AS avg_size, max(n) AS max_size, min(n) AS min_size, count(*) FILTER (n BETWEEN 3 AND 5) AS action_merge, count(*) FILTER (n = 2) AS action_keep_first, count(*) FILTER (n > 5) AS action_flag, count(*) FILTER (n = 2) AS pairs, count(*) FILTER (n BETWEEN 3 AND 5) AS groups_3_to_5, count(*) FILTER (n >= 6) AS groups_6_plus FROM g",
    ),
    "exact_groups_customer": (
        exact_groups_customer,
        f"WITH g AS (SELECT min(c_custkey) AS group_id, count(*) AS n FROM customer GROUP BY c_nationkey, {sql_text('c_mktsegment')} HAVING count(*) > 1) SELECT group_id, n AS group_size, {_SIZED.format(c='false')} AS recommended_action FROM g",
    ),
    "exact_groups_orders": (exact_groups_orders, "SELECT group_id, record_id FROM (SELECT min(o_orderkey) OVER w AS group_id, o_orderkey AS record_id, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderdate::DATE)) WHERE n > 1"),
    "exact_groups_raw": (
        exact_groups_raw,
        f"SELECT min(p_partkey) AS group_id, count(*) AS group_size, sha256(p_name || '||' || coalesce(p_type, 'nan')) AS key_hash FROM ({_GAPPY}) GROUP BY p_name, coalesce(p_type, 'nan') HAVING count(*) > 1",
    ),
    "exact_single_field": (exact_single_field, "SELECT min(s_suppkey) AS group_id, count(*) AS group_size FROM supplier GROUP BY s_nationkey HAVING count(*) > 1"),
    "exact_groups_documents": (exact_groups_documents, "SELECT group_id, record_id FROM (SELECT min(doc_id) OVER w AS group_id, doc_id AS record_id, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1"),
    "exact_group_names": (exact_group_names, f"SELECT g AS group_id, 'exact_group_' || row_number() OVER (ORDER BY g) AS group_name FROM (SELECT min(p_partkey) AS g FROM part GROUP BY {_PART} HAVING count(*) > 1)"),
    "fuzzy_keys": (fuzzy_keys, f"SELECT p_partkey AS record_id, {_K} AS key FROM part"),
    "fuzzy_blocks": (fuzzy_blocks, f"WITH {_BLOCKED} SELECT block, count(*) AS records, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM b GROUP BY block"),
    "fuzzy_pairs_levenshtein": (fuzzy_pairs_levenshtein, f"WITH {_BLOCKED}, {_PAIRS.format(t='90.0')} SELECT a, b, score FROM e"),
    "fuzzy_groups_levenshtein": (_scored("levenshtein", 96.0), f"{_GROUPS} SELECT {_AS_GROUPS}"),
    "fuzzy_groups_ratio": (_scored("ratio", 97.0), None),
    "fuzzy_groups_partial_ratio": (_scored("partial_ratio", 97.0), None),
    "fuzzy_groups_token_sort_ratio": (_scored("token_sort_ratio", 97.0), None),
    "fuzzy_groups_token_set_ratio": (_scored("token_set_ratio", 97.0), None),
    "fuzzy_groups_wratio": (_scored("WRatio", 97.0), None),
    "fuzzy_members": (fuzzy_members, f"{_GROUPS} SELECT m.g AS group_id, b.id AS record_id FROM b JOIN d USING (block, key) JOIN m ON m.id = d.id JOIN z ON z.group_id = m.g"),
    "fuzzy_stats": (
        fuzzy_stats,
        f"{_GROUPS} SELECT count(*) AS total_groups, sum(group_size)::BIGINT AS total_records, avg(group_size) AS avg_size, max(group_size) AS max_size, min(group_size) AS min_size, avg(similarity_score) AS avg_similarity, max(similarity_score) AS max_similarity, min(similarity_score) AS min_similarity, count(*) FILTER (similarity_score >= 90) AS score_90_100, count(*) FILTER (similarity_score >= 80 AND similarity_score < 90) AS score_80_90, count(*) FILTER (similarity_score >= 70 AND similarity_score < 80) AS score_70_80, count(*) FILTER (similarity_score >= 60 AND similarity_score < 70) AS score_60_70, count(*) FILTER (similarity_score < 60) AS score_below_60 FROM z",
    ),
    "combined_groups": (combined_groups, f"{_GROUPS} SELECT * FROM ({_EXACT_ROWS}) UNION ALL SELECT {_AS_GROUPS}"),
}
