"""Queries of golden records and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import exact, golden, resolve
from kinfold.operators.storage import stored
from kinfold.plans.common import PART_KEY, SQL_PART_MEMBERS, table

_FIELDS = ["p_name", "p_type", "p_size", "p_retailprice"]


def _grouped_parts(spark, sf_dir):
    """Parts with gaps, in groups of equal name and brand."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    gappy = part.select("p_partkey", "p_name", "p_brand", F.when(k % 2 == 0, F.col("p_type")).alias("p_type"), F.when(k % 3 != 0, F.col("p_size")).alias("p_size"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    members = exact.members(part, "p_partkey", ["p_name", "p_brand"], unicode=False)
    return members.join(gappy, members["record_id"] == gappy["p_partkey"]).drop("p_partkey")


def _golden(strategy):
    def query(spark, sf_dir):
        out = golden.golden_records(_grouped_parts(spark, sf_dir), "group_id", "record_id", fields=_FIELDS, default=strategy)
        return out.select(F.col("_group_id").alias("group_id"), *_FIELDS, "_source_count", *[F.col("_field_sources")[f].alias(f"from_{f}") for f in ("p_type", "p_size")])

    return query


def golden_most_recent(spark, sf_dir):
    """The latest order's values of each customer."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    out = golden.golden_records(orders, "o_custkey", "o_orderkey", fields=["o_orderstatus", "o_orderpriority", "o_totalprice"], default="most_recent", timestamp_field="o_orderdate")
    return out.select(F.col("_group_id").alias("group_id"), "o_orderstatus", "o_orderpriority", "o_totalprice", "_source_count")


def golden_statistics(spark, sf_dir):
    out = golden.golden_records(_grouped_parts(spark, sf_dir), "group_id", "record_id", fields=_FIELDS)
    return golden.statistics(out, _FIELDS).select("golden_records", "source_records", *[F.round(c, 6).alias(c) for c in ("consolidation_ratio", "avg_completeness", "min_completeness", "max_completeness")])


def golden_sources(spark, sf_dir):
    return golden.field_sources(golden.golden_records(_grouped_parts(spark, sf_dir), "group_id", "record_id", fields=_FIELDS, default="first_non_null"))


def _members(spark, sf_dir):
    return stored(exact.members(table(spark, sf_dir, "part"), "p_partkey", PART_KEY, unicode=False), "members")


def _resolved(action):
    def query(spark, sf_dir):
        members = _members(spark, sf_dir)
        out, _ = resolve.apply(table(spark, sf_dir, "part"), "p_partkey", members, resolve.simple_decisions(members, action))
        return out.drop("_resolution_timestamp", "_original_index")

    return query


def _mixed(members):
    """A decision by the group's number: keep the last, delete the first (confirmed or not), merge, flag, or one that
    can't be applied."""
    per = members.groupBy("group_id").agg(F.array_sort(F.collect_list("record_id")).alias("ids"))
    kind = F.pmod("group_id", F.lit(6))
    action = F.element_at(F.array(*[F.lit(a) for a in ("keep", "DELETE", "DELETE", "MERGE", "FLAG", "ERASE")]), (kind + 1).cast("int"))
    selected = F.when(kind == 0, F.slice("ids", -1, 1)).when(kind.isin(1, 2), F.slice("ids", 1, 1)).otherwise(F.col("ids"))
    return per.select(F.col("group_id").alias("seq"), "group_id", action.alias("action"), selected.alias("selected"), F.when(kind == 1, "Confirmed by hand").otherwise("").alias("notes"))


def resolve_mixed(spark, sf_dir):
    members = _members(spark, sf_dir)
    out, _ = resolve.apply(table(spark, sf_dir, "part"), "p_partkey", members, _mixed(members))
    return out.select("p_partkey", "_resolution_status", "_resolution_action")


def resolve_rejects(spark, sf_dir):
    members = _members(spark, sf_dir)
    return resolve.check(_mixed(members), members)[1].select("group_id", "action", "reason")


def resolve_summary(spark, sf_dir):
    members = _members(spark, sf_dir)
    out, rejects = resolve.apply(table(spark, sf_dir, "part"), "p_partkey", members, _mixed(members))
    return resolve.summary(out, rejects)


def merged_gaps(spark, sf_dir):
    """Merged values of groups with gaps: the best record, its blanks filled from the others."""
    rows = stored(_grouped_parts(spark, sf_dir), "gappy")
    members = rows.select("group_id", "record_id")
    records = rows.drop("group_id").withColumnRenamed("record_id", "p_partkey")
    valid, _ = resolve.check(resolve.simple_decisions(members, "merge"), members)
    return resolve.merged_values(records.drop("p_name", "p_brand"), "p_partkey", members, valid).select("group_id", "primary_id", "p_type", "p_size", "p_retailprice")


def soft_delete(spark, sf_dir):
    ids = _members(spark, sf_dir).where("record_id != group_id")
    return resolve.soft_delete(table(spark, sf_dir, "part"), "p_partkey", ids).select("p_partkey", "_resolution_status", "_resolution_action")


def hard_delete(spark, sf_dir):
    ids = _members(spark, sf_dir).where("record_id != group_id")
    return resolve.hard_delete(table(spark, sf_dir, "part"), "p_partkey", ids)


def clean_chosen(spark, sf_dir):
    """One chosen record of every second group stays; the other groups stay whole."""
    members = _members(spark, sf_dir)
    chosen = members.where(F.col("group_id") % 2 == 0).groupBy("group_id").agg(F.max("record_id").alias("record_id"))
    return resolve.clean(table(spark, sf_dir, "part"), "p_partkey", members, chosen).select("p_partkey", "p_name")


_GAPPY = """m AS (SELECT min(p_partkey) OVER w AS g, count(*) OVER w AS n, p_partkey AS r, row_number() OVER (PARTITION BY lower(p_name), lower(p_brand) ORDER BY p_partkey) - 1 AS p, p_name,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS p_retailprice
  FROM part WINDOW w AS (PARTITION BY lower(p_name), lower(p_brand))),
x AS (SELECT *, 1 + (p_type IS NOT NULL)::INT + (p_size IS NOT NULL)::INT + (p_retailprice IS NOT NULL)::INT AS c FROM m WHERE n > 1)"""


def _pick(order: str) -> str:
    fields = ", ".join(f"first({f} ORDER BY {order.format(f=f)}) FILTER ({f} IS NOT NULL) AS {f}" for f in _FIELDS)
    places = ", ".join(f"coalesce(first(p ORDER BY {order.format(f=f)}) FILTER ({f} IS NOT NULL), -1)::INTEGER AS from_{f}" for f in ("p_type", "p_size"))
    return f"WITH {_GAPPY} SELECT g AS group_id, {fields}, count(*) AS _source_count, {places} FROM x GROUP BY g"


def _frequent() -> str:
    parts = [f"f{i} AS (SELECT g, first(v ORDER BY n DESC, p) AS v, first(p ORDER BY n DESC, p) AS p FROM (SELECT g, {f} AS v, count(*) AS n, min(p) AS p FROM x WHERE {f} IS NOT NULL GROUP BY g, {f}) GROUP BY g)" for i, f in enumerate(_FIELDS)]
    joins = " ".join(f"LEFT JOIN f{i} ON f{i}.g = s.g" for i in range(len(_FIELDS)))
    fields = ", ".join(f"f{i}.v AS {f}" for i, f in enumerate(_FIELDS))
    return f"WITH {_GAPPY}, s AS (SELECT g, count(*) AS n FROM x GROUP BY g), {', '.join(parts)} SELECT s.g AS group_id, {fields}, s.n AS _source_count, coalesce(f1.p, -1)::INTEGER AS from_p_type, coalesce(f2.p, -1)::INTEGER AS from_p_size FROM s {joins}"


_D = f"""m AS ({SQL_PART_MEMBERS}),
d AS (SELECT m.*, g % 6 AS k, r = min(r) OVER (PARTITION BY g) AS is_first, r = max(r) OVER (PARTITION BY g) AS is_last FROM m WHERE n > 1),
t AS (SELECT r, g, CASE k WHEN 0 THEN CASE WHEN is_last THEN 'kept' ELSE 'soft_deleted' END WHEN 1 THEN CASE WHEN is_first THEN 'hard_deleted' END WHEN 3 THEN CASE WHEN is_first THEN 'merged_primary' ELSE 'merged_secondary' END WHEN 4 THEN 'flagged' END AS s,
  CASE k WHEN 0 THEN CASE WHEN is_last THEN 'KEEP' ELSE 'SOFT_DELETE' END WHEN 1 THEN CASE WHEN is_first THEN 'DELETE' END WHEN 3 THEN 'MERGE' WHEN 4 THEN 'FLAG' END AS a FROM d)"""
_SIMPLE = f"WITH m AS ({SQL_PART_MEMBERS}), l AS (SELECT g, string_agg(r::VARCHAR, ',' ORDER BY r) AS ids FROM m WHERE n > 1 GROUP BY g) SELECT {{c}}, {{s}} AS _resolution_status, {{a}} AS _resolution_action, {{i}} AS _merged_from_ids FROM part JOIN m ON r = p_partkey LEFT JOIN l USING (g) {{j}}"
_OWN = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"

QUERIES = {
    "golden_most_complete": (_golden("most_complete"), _pick("c DESC, p")),
    "golden_longest_value": (_golden("longest_value"), _pick("length({f}::VARCHAR) DESC, p")),
    "golden_first_non_null": (_golden("first_non_null"), _pick("p")),
    "golden_most_frequent": (_golden("most_frequent"), _frequent()),
    "golden_most_recent": (
        golden_most_recent,
        "WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS pr FROM orders) SELECT o_custkey AS group_id, first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) FILTER (o_orderstatus IS NOT NULL) AS o_orderstatus, first(pr ORDER BY o_orderdate DESC, o_orderkey) FILTER (pr IS NOT NULL) AS o_orderpriority, first(o_totalprice ORDER BY o_orderdate DESC, o_orderkey) FILTER (o_totalprice IS NOT NULL) AS o_totalprice, count(*) AS _source_count FROM o GROUP BY o_custkey",
    ),
    "golden_statistics": (
        golden_statistics,
        f"WITH {_GAPPY}, y AS (SELECT count(*) AS n, (1 + (count(p_type) > 0)::INT + (count(p_size) > 0)::INT + (count(p_retailprice) > 0)::INT) / 4.0::DOUBLE AS c FROM x GROUP BY g) SELECT count(*) AS golden_records, sum(n)::BIGINT AS source_records, round(sum(n) / count(*), 6) AS consolidation_ratio, round(avg(c), 6) AS avg_completeness, round(min(c), 6) AS min_completeness, round(max(c), 6) AS max_completeness FROM y",
    ),
    "golden_sources": (
        golden_sources,
        f"WITH {_GAPPY}, y AS ({' UNION ALL '.join(f'''SELECT '{f}' AS field, coalesce(min(p) FILTER ({f} IS NOT NULL), -1)::INTEGER AS source FROM x GROUP BY g''' for f in _FIELDS)}) SELECT field, source, count(*) AS records FROM y GROUP BY ALL",
    ),
    "resolve_keep": (_resolved("keep"), _SIMPLE.format(c=_OWN, s="CASE WHEN n = 1 THEN 'original' WHEN r = g THEN 'kept' ELSE 'soft_deleted' END", a="CASE WHEN n > 1 THEN CASE WHEN r = g THEN 'KEEP' ELSE 'SOFT_DELETE' END END", i="NULL::VARCHAR", j="")),
    "resolve_flag": (_resolved("flag"), _SIMPLE.format(c=_OWN, s="CASE WHEN n = 1 THEN 'original' ELSE 'flagged' END", a="CASE WHEN n > 1 THEN 'FLAG' END", i="NULL::VARCHAR", j="")),
    "resolve_merge": (_resolved("merge"), _SIMPLE.format(c=_OWN, s="CASE WHEN n = 1 THEN 'original' WHEN r = g THEN 'merged_primary' ELSE 'merged_secondary' END", a="CASE WHEN n > 1 THEN 'MERGE' END", i="ids", j="")),
    "resolve_mixed": (resolve_mixed, f"WITH {_D} SELECT p_partkey, coalesce(s, 'original') AS _resolution_status, a AS _resolution_action FROM part LEFT JOIN t ON r = p_partkey"),
    "resolve_rejects": (resolve_rejects, f"WITH {_D} SELECT DISTINCT g AS group_id, CASE k WHEN 2 THEN 'DELETE' ELSE 'ERASE' END AS action, CASE k WHEN 2 THEN 'not confirmed' ELSE 'unknown action' END AS reason FROM d WHERE k IN (2, 5)"),
    "resolve_summary": (
        resolve_summary,
        f"WITH {_D}, s AS (SELECT coalesce(s, 'original') AS s FROM part LEFT JOIN t ON r = p_partkey) SELECT count(*) AS total_records, "
        + ", ".join(f"count(*) FILTER (s = '{x}') AS {x}" for x in ("original", "kept", "soft_deleted", "hard_deleted", "merged_primary", "merged_secondary", "flagged"))
        + ", (SELECT count(DISTINCT g) FROM d WHERE k IN (2, 5)) AS rejected FROM s",
    ),
    "merged_gaps": (
        merged_gaps,
        f"WITH {_GAPPY}, b AS (SELECT g, first(r ORDER BY c DESC, p) AS best FROM x GROUP BY g) SELECT x.g AS group_id, min(x.r) AS primary_id, "
        + ", ".join(f"first({f} ORDER BY (r = best) DESC, p) FILTER ({f} IS NOT NULL) AS {f}" for f in _FIELDS[1:])
        + " FROM x JOIN b USING (g) GROUP BY x.g",
    ),
    "soft_delete": (soft_delete, f"WITH m AS ({SQL_PART_MEMBERS}) SELECT r AS p_partkey, CASE WHEN r = g THEN 'original' ELSE 'soft_deleted' END AS _resolution_status, CASE WHEN r <> g THEN 'SOFT_DELETE' END AS _resolution_action FROM m"),
    "hard_delete": (hard_delete, f"WITH m AS ({SQL_PART_MEMBERS}) SELECT part.* FROM part JOIN m ON r = p_partkey WHERE r = g"),
    "clean_chosen": (clean_chosen, f"WITH m AS ({SQL_PART_MEMBERS}), x AS (SELECT *, max(r) OVER (PARTITION BY g) AS top FROM m) SELECT p_partkey, p_name FROM part JOIN x ON r = p_partkey WHERE n = 1 OR g % 2 = 1 OR r = top"),
}
