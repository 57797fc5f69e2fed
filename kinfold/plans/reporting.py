"""Queries of files, outputs, audit and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import audit, exact, files, metrics, output, resolve
from kinfold.operators.storage import fresh_path, stored
from kinfold.plans.common import PART_KEY, SQL_PART_MEMBERS, table


def _files(spark, sf_dir):
    """Documents as files: their source as folder, their size, and a time from their id."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    seconds = F.lit(1_700_000_000) + F.pmod(F.col("doc_id") * 37, F.lit(1000))
    return docs.select(F.concat(F.lit("/data/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.timestamp_seconds(seconds).alias("modified"), "text")


def files_same_size(spark, sf_dir):
    return files.same_size(_files(spark, sf_dir).drop("text")).select("path", "length", "files_of_size")


def _hashed(spark, sf_dir):
    return files.same_size(_files(spark, sf_dir)).select("path", "length", "modified", F.sha2("text", 256).alias("hash"))


def files_duplicates(spark, sf_dir):
    return files.duplicates(_hashed(spark, sf_dir)).select("hash", "files", "total_size")


def files_best(spark, sf_dir):
    return files.best_files(_hashed(spark, sf_dir), ["/src3/", "/src1/"]).select("path", "hash", "is_best")


def files_cleanup_plan(spark, sf_dir):
    return files.cleanup_plan(files.best_files(_hashed(spark, sf_dir)), "archive")


def files_statistics(spark, sf_dir):
    return files.statistics(_hashed(spark, sf_dir))


def files_scanned(spark, sf_dir):
    """Real files: every text of the benchmark and a copy of it, written, scanned and hashed."""
    root = fresh_path(spark, "tree")
    items = table(spark, sf_dir, "benchmark").select("text")
    for name in ("a", "b"):
        items.coalesce(1).write.text(f"{root}/{name}")
    found = files.find(spark, root, [".txt"])
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.count_if("is_best").alias("best")).select("files", "best")


def _groups(spark, sf_dir, fields=None):
    return stored(exact.groups(table(spark, sf_dir, "part"), "p_partkey", fields or ["p_name", "p_brand"], unicode=False), "groups")


def _resolved(spark, sf_dir):
    members = stored(exact.members(table(spark, sf_dir, "part"), "p_partkey", PART_KEY, unicode=False), "members")
    return resolve.apply(table(spark, sf_dir, "part").withColumn("p_name_normalized", F.lower("p_name")), "p_partkey", members, resolve.simple_decisions(members, "keep"))[0]


def output_cleaned(spark, sf_dir):
    return output.cleaned(_resolved(spark, sf_dir))


def output_written(spark, sf_dir):
    """The cleaned parts, written as CSV and read again."""
    path = output.write(output.cleaned(_resolved(spark, sf_dir)), fresh_path(spark, "cleaned"), "csv")
    return spark.read.option("header", True).csv(path)


def output_audit_log(spark, sf_dir):
    """The audit log, written and read again."""
    path = output.write_audit_log(output.audit_entries(_resolved(spark, sf_dir)), fresh_path(spark, "audit"))
    return spark.read.option("header", True).csv(path).select("record_id", "action", "reason", "user_decision")


def output_analyze(spark, sf_dir):
    return output.analyze(_groups(spark, sf_dir))


def output_quality(spark, sf_dir):
    return output.quality(table(spark, sf_dir, "part"), _groups(spark, sf_dir)).select("records", "groups", *[F.round(c, 6).alias(c) for c in ("duplicate_rate", "exact_rate", "fuzzy_rate", "completeness_score")])


def audit_entries_from_log(spark, sf_dir):
    """Log lines with an object in each, some of them broken."""
    k = F.col("o_orderkey")
    good = F.to_json(F.struct(k.cast("string").alias("record_id"), F.when(k % 2 == 0, "KEEP").otherwise("MERGE").alias("action"), F.col("o_orderpriority").alias("reason"), (F.col("o_totalprice") / 1000).alias("similarity_score")))
    line = F.concat(F.lit("INFO audit: "), F.when(k % 10 == 3, F.substring(good, 1, 20)).when(k % 10 == 7, "no entry").otherwise(good))
    path = fresh_path(spark, "log")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return output.entries_from_log(spark, path).select("record_id", "action", "reason", "similarity_score")


def _events(spark, sf_dir):
    kind = F.col("event_type")
    data = F.to_json(F.struct(F.when(kind == "view", F.floor("value")).alias("record_count"), F.when(kind == "click", F.floor("value")).alias("records_affected")))
    events = table(spark, sf_dir, "events")
    return events.select(F.lit("s").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.when(kind == "view", "DATA_LOADED").when(kind == "click", "DUPLICATE_DETECTION").otherwise(F.upper(kind)).alias("event_type"), data.alias("event_data"))


def audit_report(spark, sf_dir):
    return audit.report(_events(spark, sf_dir))


def audit_duplicate_rate(spark, sf_dir):
    return audit.duplicate_rate(_events(spark, sf_dir)).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


def audit_events(spark, sf_dir):
    """Events of a session, written in batches and read again."""
    log = audit.AuditLog(spark, fresh_path(spark, "events"), "s")
    log.detected("exact", ["p_name", "p_brand"], _groups(spark, sf_dir))
    log.close()
    return log.events().groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def _part_members(spark, sf_dir, fields):
    return stored(exact.members(table(spark, sf_dir, "part"), "p_partkey", fields, unicode=False), "members")


def metric_pairs(spark, sf_dir):
    return metrics.pairs(_part_members(spark, sf_dir, PART_KEY))


def metric_confusion(spark, sf_dir):
    """Groups by name and type against groups by name and brand."""
    found, truth = (_part_members(spark, sf_dir, f) for f in (["p_name", "p_type", "p_size"], ["p_name", "p_brand"]))
    return _rounded(metrics.confusion(found, truth, table(spark, sf_dir, "part").count()))


def metric_confusion_by_group(spark, sf_dir):
    found, truth = (_part_members(spark, sf_dir, f) for f in (["p_name", "p_type", "p_size"], ["p_name", "p_brand"]))
    return _rounded(metrics.confusion_by_group(found, truth, table(spark, sf_dir, "part").count()))


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if c in ("precision", "recall", "accuracy", "f1") else F.col(c) for c in df.columns])


def metric_averages(spark, sf_dir):
    """Averages over test results, one a supplier."""
    unit = lambda k: F.pmod(F.col("s_suppkey") * k, F.lit(101)) / 100.0
    results = table(spark, sf_dir, "supplier").select(unit(3).alias("precision"), unit(5).alias("recall"), unit(7).alias("f1"), unit(11).alias("accuracy"), (unit(13) * 4).alias("seconds"))
    return metrics.averages(results)


_F = "f AS (SELECT '/data/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS length, 1700000000 + (doc_id * 37) % 1000 AS modified, sha256(text) AS hash FROM documents WHERE text IS NOT NULL)"
_G = f"{_F}, h AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM f)"
_BEST = "row_number() OVER (PARTITION BY hash ORDER BY {p}modified DESC, path) = 1"
_M = f"m AS ({SQL_PART_MEMBERS})"
_P = "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON {on} AND a.p_partkey < b.p_partkey"
_CONFUSED = f"""WITH f AS ({_P.format(on='lower(a.p_name) = lower(b.p_name) AND lower(a.p_type) = lower(b.p_type) AND a.p_size = b.p_size')}), t AS ({_P.format(on='lower(a.p_name) = lower(b.p_name) AND lower(a.p_brand) = lower(b.p_brand)')}),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM t)) AS tp, (SELECT count(*) FROM f) AS p, (SELECT count(*) FROM t) AS q, (SELECT count(*) * (count(*) - 1) // 2 FROM part)::BIGINT AS n),
s AS (SELECT *, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(q, 0)::DOUBLE, 0) AS re FROM c)
SELECT tp AS true_positives, p - tp AS false_positives, q - tp AS false_negatives, n - p - q + tp AS true_negatives, round(pr, 9) AS precision, round(re, 9) AS recall, round((n - p - q + 2 * tp) / n::DOUBLE, 9) AS accuracy, round(coalesce(2.0::DOUBLE * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM s"""
_SIZES = "g AS (SELECT count(*) AS n FROM part GROUP BY lower(p_name), lower(p_brand) HAVING count(*) > 1)"

QUERIES = {
    "files_same_size": (files_same_size, f"WITH {_F} SELECT path, length, n AS files_of_size FROM (SELECT *, count(*) OVER (PARTITION BY length) AS n FROM f) WHERE n > 1"),
    "files_duplicates": (files_duplicates, f"WITH {_F} SELECT hash, count(*) AS files, sum(length)::BIGINT AS total_size FROM f GROUP BY hash HAVING count(*) > 1"),
    "files_best": (files_best, f"WITH {_G} SELECT path, hash, {_BEST.format(p='''CASE WHEN contains(path, '/src3/') THEN 0 WHEN contains(path, '/src1/') THEN 1 ELSE 2 END, ''')} AS is_best FROM h WHERE n > 1"),
    "files_cleanup_plan": (files_cleanup_plan, f"WITH {_G}, r AS (SELECT *, {_BEST.format(p='')} AS best FROM h WHERE n > 1) SELECT path, hash, length AS bytes_freed, 'archive' AS action FROM r WHERE NOT best"),
    "files_statistics": (
        files_statistics,
        f"WITH {_F}, d AS (SELECT count(*) AS n, sum(length) AS t, min(length) AS s FROM f GROUP BY hash HAVING count(*) > 1) SELECT count(*) AS duplicate_groups, sum(n)::BIGINT AS files_in_groups, sum(n - 1)::BIGINT AS duplicate_files, sum(t - s)::BIGINT AS wasted_bytes, sum(t - s)::BIGINT / 1048576.0::DOUBLE AS wasted_mb, max(n) AS largest_group, avg(n) AS avg_group FROM d",
    ),
    "files_scanned": (files_scanned, "SELECT 2::BIGINT AS files, 1::BIGINT AS best"),
    "output_cleaned": (output_cleaned, f"WITH {_M} SELECT part.* FROM part JOIN m ON r = p_partkey WHERE r = g"),
    "output_written": (output_written, f"WITH {_M} SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, p_retailprice::VARCHAR AS p_retailprice FROM part JOIN m ON r = p_partkey WHERE r = g"),
    "output_audit_log": (output_audit_log, f"WITH {_M} SELECT r::VARCHAR AS record_id, CASE WHEN r = g THEN 'KEEP' ELSE 'SOFT_DELETE' END AS action, CASE WHEN r = g THEN 'kept' ELSE 'soft_deleted' END AS reason, 'true' AS user_decision FROM m WHERE n > 1"),
    "output_analyze": (
        output_analyze,
        f"WITH {_SIZES} SELECT 'group_size' AS dimension, n::VARCHAR AS value, count(*) AS groups FROM g GROUP BY n UNION ALL SELECT 'detection_method', 'exact', count(*) FROM g HAVING count(*) > 0 UNION ALL SELECT 'recommended_action', CASE WHEN n = 2 THEN 'keep_first' WHEN n <= 5 THEN 'merge' ELSE 'flag' END, count(*) FROM g GROUP BY 2",
    ),
    "output_quality": (
        output_quality,
        f"WITH {_SIZES}, c AS (SELECT (SELECT count(*) FROM part) AS records, (SELECT count(*) FROM g) AS groups) SELECT records, groups, round(groups * 2 / records * 100.0::DOUBLE, 6) AS duplicate_rate, round(groups * 2 / records * 100.0::DOUBLE, 6) AS exact_rate, 0.0::DOUBLE AS fuzzy_rate, round(least(100.0::DOUBLE, 85.0::DOUBLE + (1.0::DOUBLE - groups / records) * 15.0::DOUBLE), 6) AS completeness_score FROM c",
    ),
    "audit_entries_from_log": (
        audit_entries_from_log,
        "SELECT o_orderkey::VARCHAR AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN 'KEEP' ELSE 'MERGE' END AS action, o_orderpriority AS reason, o_totalprice / 1000 AS similarity_score FROM orders WHERE o_orderkey % 10 NOT IN (3, 7)",
    ),
    "audit_report": (
        audit_report,
        "SELECT CASE event_type WHEN 'view' THEN 'DATA_LOADED' WHEN 'click' THEN 'DUPLICATE_DETECTION' ELSE upper(event_type) END AS event_type, count(*) AS events, sum(CASE WHEN event_type = 'view' THEN floor(value) ELSE 0 END)::BIGINT AS record_count, sum(CASE WHEN event_type = 'click' THEN floor(value) ELSE 0 END)::BIGINT AS records_affected FROM events GROUP BY 1",
    ),
    "audit_duplicate_rate": (
        audit_duplicate_rate,
        "WITH s AS (SELECT coalesce(sum(floor(value)) FILTER (event_type = 'view'), 0)::BIGINT AS l, coalesce(sum(floor(value)) FILTER (event_type = 'click'), 0)::BIGINT AS a FROM events) SELECT l AS records_loaded, a AS records_affected, round(coalesce(a * 100.0::DOUBLE / nullif(l, 0), 0), 6) AS duplicate_rate FROM s",
    ),
    "audit_events": (audit_events, f"WITH {_SIZES} SELECT 'SESSION_START' AS event_type, 1::BIGINT AS events UNION ALL SELECT 'DUPLICATE_DETECTION', 1 UNION ALL SELECT 'SESSION_END', 1 UNION ALL SELECT 'DUPLICATE_GROUP_IDENTIFIED', count(*) FROM g HAVING count(*) > 0"),
    "metric_pairs": (metric_pairs, _P.format(on="lower(a.p_name) = lower(b.p_name) AND lower(a.p_brand) = lower(b.p_brand) AND lower(a.p_type) = lower(b.p_type)")),
    "metric_confusion": (metric_confusion, _CONFUSED),
    "metric_confusion_by_group": (metric_confusion_by_group, _CONFUSED),
    "metric_averages": (
        metric_averages,
        "SELECT " + ", ".join(f"round(avg((s_suppkey * {k}) % 101 / 100.0::DOUBLE), 4) AS avg_{c}" for c, k in (("precision", 3), ("recall", 5), ("f1", 7), ("accuracy", 11))) + ", round(avg((s_suppkey * 13) % 101 / 100.0::DOUBLE * 4), 2) AS avg_seconds, count(*) AS tests FROM supplier",
    ),
}
