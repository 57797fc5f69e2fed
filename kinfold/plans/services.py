"""Queries of scores, checks, summaries, decisions, outputs, audit services and database texts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import functions as F

from kinfold import errors, types
from kinfold.functions import normalize as N
from kinfold.functions.similarity import SCORERS
from kinfold.operators import audit, exact, fuzzy, golden, metrics, output, profile, resolve
from kinfold.operators.storage import fresh_path, stored
from kinfold.plans import detection, reporting
from kinfold.plans.common import PART_KEY, SQL_PART_MEMBERS, sql_aggressive, sql_text, table
from kinfold.plans.preparation import _sparse
from kinfold.sources import files, jdbc


def _names(spark, sf_dir):
    """Names of parts, odd ones with a word more, so that lengths and words differ."""
    name = F.lower(F.trim("p_name"))
    return table(spark, sf_dir, "part").select(F.when(F.length(name) % 2 == 1, F.concat(name, F.lit(" for ring gear"))).otherwise(name).alias("name")).distinct()


def _score(algorithm: str) -> Callable:
    def query(spark, sf_dir):
        a, b = _names(spark, sf_dir).withColumnRenamed("name", "a"), _names(spark, sf_dir).withColumnRenamed("name", "b")
        return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(SCORERS[algorithm](F.col("a"), F.col("b")), 6).alias("score"))

    return query


def profile_validate(spark, sf_dir):
    r = profile.validate(_sparse(spark, sf_dir))
    return spark.createDataFrame([(r.is_valid, r.record_count, len(r.errors), "; ".join(r.warnings), ",".join(r.field_names))], "is_valid boolean, record_count long, errors int, warnings string, fields string")


#: What is wrong with the first one: everything that is checked but the threshold, which mode `none` leaves unread.
CONFIGURATIONS = {
    "invalid": {"matching": {"mode": "none", "fields": [], "fuzzy_threshold": 150}, "resolution": {"default_action": "DROP"}, "performance": {"memory_limit_mb": -100, "batch_size": 0}},
    "threshold": {"matching": {"mode": "fuzzy", "fields": ["a"], "fuzzy_threshold": 150}},
    "valid": {"matching": {"mode": "both", "fields": ["a"], "fuzzy_threshold": 85}, "resolution": {"default_action": "KEEP", "merge_strategy": "most_recent"}, "performance": {"memory_limit_mb": 512, "batch_size": 1000}},
}


def configuration_errors(spark, sf_dir):
    rows = [(name, e.partition(":")[0]) for name, c in CONFIGURATIONS.items() for e in errors.validate_configuration(c)]
    return spark.createDataFrame(rows, "configuration string, setting string")


def normalized_record(spark, sf_dir):
    return N.normalized_record(table(spark, sf_dir, "part"), {"p_name": "text", "p_brand": "text_aggressive", "absent": "email"}, unicode=False)


def key_from_values(spark, sf_dir):
    key = N.composite_key_from_values([F.col("s_name"), F.col("s_nationkey").cast("string")], ["text", "numeric"], "|")
    return table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("key"))


def inferred_kinds(spark, sf_dir):
    names = ["id", "Key", "index", "work_email", "Phone 2", *table(spark, sf_dir, "supplier").columns]
    return spark.createDataFrame(list(N.infer_kinds(names).items()), "column string, kind string")


def exact_summary_text(spark, sf_dir):
    return spark.createDataFrame([(exact.text_summary(reporting._groups(spark, sf_dir)),)], "text string")


def fuzzy_summary_text(spark, sf_dir):
    return spark.createDataFrame([(fuzzy.text_summary(fuzzy.grouped(detection._blocks(spark, sf_dir), "levenshtein", 96.0)[0]),)], "text string")


def golden_of_groups(spark, sf_dir):
    """Golden records straight from groups."""
    part = table(spark, sf_dir, "part")
    found = golden.merge_groups(part, stored(exact.members(part, "p_partkey", ["p_name", "p_brand"], unicode=False), "members"), "p_partkey", default="first_non_null")
    return found.select(F.col("_group_id").alias("group_id"), "p_name", "p_type", "p_size", F.col("_source_count").alias("sources"))


def decisions_listed(spark, sf_dir):
    made = [types.Decision(4, "MERGE", (4, 9, 7), "confirmed"), types.Decision(2, "KEEP", (2,)), types.Decision(5, "FLAG")]
    return types.decisions_frame(spark, made).withColumn("selected", F.array_join(F.transform("selected", lambda x: x.cast("string")), ","))


def output_report(spark, sf_dir):
    """The summary report, number by number."""
    stats = types.ProcessingStats(exact_duplicates=3, fuzzy_duplicates=1, processing_time=4.0, memory_usage=64.0)
    made = output.summary_report("s", table(spark, sf_dir, "part"), reporting._groups(spark, sf_dir), stats, ["p_name", "p_brand"])
    rows = [(section, key, float(value)) for section, own in made.items() for key, value in own.items() if isinstance(value, (int, float))]
    rows += [("data", "fields", float(len(made["data"]["fields"]))), ("duplicates", "exact_method", float(made["duplicates"]["detection_method"]["exact"]))]
    return spark.createDataFrame(rows, "section string, key string, value double").withColumn("value", F.round("value", 6))


def output_all(spark, sf_dir):
    """All outputs, written and read again: rows of each."""
    paths = output.write_all(reporting._resolved(spark, sf_dir), reporting._groups(spark, sf_dir), fresh_path(spark, "outputs"), kind="csv")
    found = {"cleaned": spark.read.option("header", True).csv(paths["cleaned"]).count(), "audit": spark.read.option("header", True).csv(paths["audit"]).count()}
    report = spark.read.text(paths["report"], wholetext=True).select(F.get_json_object("value", "$.data.records").cast("long")).first()[0]
    return spark.createDataFrame([*found.items(), ("report", report)], "output string, records long")


def output_checked(spark, sf_dir):
    """What the check of a written frame says of right and wrong expectations."""
    path = output.write(table(spark, sf_dir, "nation"), fresh_path(spark, "nations"), "json")
    wanted = {"right": (["n_name"], 25), "rows": (["n_name"], 24), "columns": (["n_name", "n_flag"], None), "both": (["n_flag"], 26)}
    rows = [(name, wrong) for name, (columns, n) in wanted.items() for wrong in output.check_written(spark, path, "json", columns, n)]
    return spark.createDataFrame(rows, "expectation string, wrong string")


def _read(log):
    data = lambda key: F.get_json_object("event_data", f"$.{key}")
    return log.events().select("event_type", data("record_count").cast("long").alias("record_count"), F.coalesce(data("path"), data("action"), data("context"), data("strategy"), data("reason"), data("name")).alias("what"))


def audit_loaded(spark, sf_dir):
    log = audit.AuditLog(spark, fresh_path(spark, "events"), "s")
    part = table(spark, sf_dir, "part")
    log.loaded("part.parquet", part)
    log.normalized({"p_name": "text"}, part.count())
    return _read(log).where("event_type != 'SESSION_START'")


def audit_decided(spark, sf_dir):
    """Decisions, golden records and deletions, an event each."""
    log = audit.AuditLog(spark, fresh_path(spark, "events"), "s")
    resolved = stored(reporting._resolved(spark, sf_dir), "resolved")
    log.decided(resolved)
    log.golden(golden_of_groups(spark, sf_dir).select(F.col("group_id").alias("_group_id"), F.col("sources").alias("_source_count")), "first_non_null")
    log.deleted(resolved.where("_resolution_status = 'soft_deleted'").select(F.col("p_partkey").alias("record_id")), "duplicate")
    return _read(log).where("event_type != 'SESSION_START'").groupBy("event_type", "what").agg(F.count(F.lit(1)).alias("events"))


def audit_services(spark, sf_dir):
    log = audit.AuditLog(spark, fresh_path(spark, "events"), "s")
    log.exported("out.csv", table(spark, sf_dir, "nation"), "csv")
    log.performance(name="exact", seconds=1.5)
    log.error(ValueError("it's None"), "loading")
    log.user_action("merge", group=4)
    log.close()
    return _read(log)


def audit_session(spark, sf_dir):
    """The process's own log: one while it is open, another after."""
    audit.close_session()
    log = audit.session(spark, fresh_path(spark, "events"))
    same = audit.session() is log
    seconds = audit.close_session()
    rows = [("same", same), ("lasted", seconds > 0), ("ended", not log.events().where("event_type = 'SESSION_END'").isEmpty()), ("closed", audit.close_session() == 0.0)]
    return spark.createDataFrame(rows, "check string, holds boolean")


def content_hashes(spark, sf_dir):
    """The hash of a frame's content sees rows, not their order."""
    df = table(spark, sf_dir, "supplier")
    one = audit.content_hash(df)
    rows = [("shuffled", audit.content_hash(df.repartition(7).orderBy(F.desc("s_suppkey"))) == one), ("row_twice", audit.content_hash(df.unionByName(df.orderBy("s_suppkey").limit(1))) == one), ("value_changed", audit.content_hash(df.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 1, F.lit(-1.0)).otherwise(F.col("s_acctbal")))) == one)]
    return spark.createDataFrame(rows, "change string, same boolean")


class _Lines(logging.Handler):
    def __init__(self, logger: logging.Logger):
        super().__init__()
        self.logger, self.lines = logger, []

    def emit(self, record):
        self.lines.append(record.getMessage())

    def __enter__(self):
        self.level_before = self.logger.level
        self.logger.setLevel(logging.INFO)
        self.logger.addHandler(self)
        return self.lines

    def __exit__(self, *_):
        self.logger.removeHandler(self)
        self.logger.setLevel(self.level_before)


def processing_log(spark, sf_dir):
    """Lines of the processing log, read as audit entries."""
    log = audit.ProcessingLog()
    with _Lines(log.logger) as lines:
        log.started("part.parquet", 3, mode="exact")
        log.action(4, "KEEP", "it's first", 100.0)
        log.action(9, "DELETE", 'a "copy"', 97.5)
        log.ended("part.parquet", 1, 0.5)
    path = fresh_path(spark, "log")
    spark.createDataFrame([(f"INFO audit: {x}",) for x in lines], "value string").write.text(path)
    return output.entries_from_log(spark, path).select("record_id", "action", "reason", "similarity_score", "user_decision")


def activity_log(spark, sf_dir):
    """Events of every kind, numbered."""
    log = audit.ActivityLog()
    with _Lines(log.logger) as lines:
        log.file("a.csv", "read", 120)
        log.data("exact", 1000, 0.5)
        log.user("merge", group=4)
        log.system("start", cores=8)
        log.performance("memory", 64.0, "MB")
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return df.select(F.from_json("value", "operation long, kind string, what string, path string, size long, succeeded boolean, records_per_second double, details map<string,long>, value double, unit string").alias("x")).select("x.operation", "x.kind", "x.what", "x.path", "x.size", "x.succeeded", "x.records_per_second", F.coalesce(F.element_at("x.details", "group"), F.element_at("x.details", "cores")).alias("detail"), "x.value", "x.unit")


def handled_errors(spark, sf_dir):
    """Errors of Python, Spark and the library as kinds with advice, and their counts."""
    handler = errors.ErrorHandler()
    kinds = []
    for name, make in {"absent_file": lambda: spark.read.parquet(fresh_path(spark, "absent")).count(), "absent_column": lambda: table(spark, sf_dir, "nation").select("n_flag"), "memory": lambda: _raise(MemoryError("full")), "own": lambda: _raise(errors.ResolutionError("no group")), "other": lambda: _raise(ValueError("odd"))}.items():
        try:
            make()
        except Exception as error:
            found = handler.handle(error)
            kinds.append((name, type(found).__name__, bool(handler.advice(found)), handler.counts[type(found).__name__]))
    kinds += [("limit", handler.limit("memory", 600, 512), handler.limit("memory", 400, 512) is None, len(handler.summary()))]
    return spark.createDataFrame(kinds, "case string, kind string, holds boolean, count int")


def _raise(error):
    raise error


def metric_precision_recall(spark, sf_dir):
    found, truth = (reporting._part_members(spark, sf_dir, f) for f in (["p_name", "p_type", "p_size"], ["p_name", "p_brand"]))
    return reporting._rounded(metrics.precision_recall(found, truth, table(spark, sf_dir, "part").count()))


def metric_run_test(spark, sf_dir):
    """A timed test whose truth is what it finds."""
    members = reporting._part_members(spark, sf_dir, PART_KEY)
    n = table(spark, sf_dir, "part").count()
    r = metrics.run_test("self", lambda: members, members, n)
    return spark.createDataFrame([(r["name"], r["true_positives"], r["precision"], r["recall"], r["seconds"] > 0, abs(r["records_per_second"] * r["seconds"] - n) < 1e-3)], "name string, true_positives long, precision double, recall double, timed boolean, rate boolean")


def encodings_detected(spark, sf_dir):
    """Names with an accent, written in each encoding, detected and read again."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" é")).alias("n_name"))
    rows = []
    for encoding in ("UTF-8", "ISO-8859-1", "UTF-16"):
        path = fresh_path(spark, "encoded") + ".csv"
        df.coalesce(1).write.option("header", True).option("encoding", encoding).csv(path)
        back = files.load_csv(spark, path)
        rows.append((encoding, files.detect_encoding(spark, path), back.where(F.col("n_name").endswith(" é")).count(), files.replaced(back)))
    return spark.createDataFrame(rows, "written string, detected string, names long, replaced long")


def csv_file_loaded(spark, sf_dir):
    path = fresh_path(spark, "region") + ".csv"
    table(spark, sf_dir, "region").write.option("header", True).option("sep", ";").csv(path)
    return files.load_csv_file(spark, path, separator=";")


def json_file_loaded(spark, sf_dir):
    """One array of objects."""
    path = fresh_path(spark, "region-array") + ".json"
    one = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("x"))
    one.select(F.to_json("x").alias("value")).coalesce(1).write.text(path)
    return files.load_json_file(spark, path)


def tables_listed(spark, sf_dir):
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"listed_{name}")
    return jdbc.list_tables(spark).where(F.col("table_name").startswith("listed_")).select("table_name", "is_temporary")


def database_texts(spark, sf_dir):
    """URLs, drivers and the text that runs in each kind of database."""
    rows = []
    for kind in ("mysql", "postgresql"):
        db = jdbc.Database(kind, "host", "shop", "u", "p")
        rows.append((kind, db.url, db.options()["driver"], jdbc.table_sql("s.orders", ["id", "total"], "total > 5", 10, kind), db.driver_present(spark)))
    return spark.createDataFrame(rows, "kind string, url string, driver string, sql string, present boolean")


def resolve_single_records(spark, sf_dir):
    """DELETE and KEEP decisions about chosen members of groups."""
    part = table(spark, sf_dir, "part")
    members = stored(exact.members(part, "p_partkey", PART_KEY, unicode=False), "members")
    per = members.groupBy("group_id").agg(F.max("record_id").alias("last"))
    delete = F.col("group_id") % 2 == 0
    decisions = per.select(F.col("group_id").alias("seq"), "group_id", F.when(delete, "DELETE").otherwise("KEEP").alias("action"), F.array("last").alias("selected"), F.when(delete, "confirmed").otherwise("").alias("notes"))
    return resolve.apply(part, "p_partkey", members, decisions)[0].select("p_partkey", F.col("_resolution_status").alias("status"), F.col("_resolution_action").alias("action"))


_NAMES = "n AS (SELECT DISTINCT CASE WHEN length(lower(trim(p_name))) % 2 = 1 THEN lower(trim(p_name)) || ' for ring gear' ELSE lower(trim(p_name)) END AS s FROM part), q AS (SELECT x.s AS a, y.s AS b FROM n x JOIN n y ON x.s < y.s)"
#: Rows of the LCS table of all needed(x, y), one character of x after the other: a running maximum along y.
_LCS = """need AS (SELECT DISTINCT x, y FROM ({need}) WHERE x <> '' AND y <> ''),
t AS (SELECT x, y, 0 AS i, unnest(range(0, length(y) + 1)) AS j, 0 AS v FROM need
  UNION ALL SELECT x, y, i + 1, j, max(c) OVER (PARTITION BY x, y ORDER BY j) FROM (
    SELECT x, y, i, j, greatest(v, coalesce(lag(v) OVER (PARTITION BY x, y ORDER BY j) + (substr(x, i + 1, 1) = substr(y, j, 1))::INT, 0)) AS c FROM t WHERE i < length(x))),
r AS (SELECT x, y, 200.0::DOUBLE * v / (length(x) + length(y)) AS score FROM t WHERE i = length(x) AND j = length(y))"""
_SORTED = "array_to_string(list_sort(string_split({c}, ' ')), ' ')"
_SETS = """k AS (SELECT a, b, list_sort(list_distinct(string_split(a, ' '))) AS wa, list_sort(list_distinct(string_split(b, ' '))) AS wb FROM q),
l AS (SELECT a, b, array_to_string(list_filter(wa, lambda w: list_contains(wb, w)), ' ') AS shared, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS oa, array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS ob FROM k),
m AS (SELECT *, trim(shared || ' ' || oa) AS xa, trim(shared || ' ' || ob) AS xb FROM l)"""
_NEED_SET = "SELECT xa AS x, xb AS y FROM m UNION ALL SELECT shared, xa FROM m UNION ALL SELECT shared, xb FROM m"
_SET = "CASE WHEN shared <> '' AND (oa = '' OR ob = '') THEN 100.0::DOUBLE WHEN shared <> '' THEN greatest(r1.score, r2.score, r3.score) ELSE r1.score END"
_SET_FROM = "m LEFT JOIN r r1 ON r1.x = xa AND r1.y = xb LEFT JOIN r r2 ON r2.x = shared AND r2.y = xa LEFT JOIN r r3 ON r3.x = shared AND r3.y = xb"


def _sides(c):
    """The shorter text s and the longer one l of all pairs of texts (c: pairs a, b); of one length, both ways."""
    return f"(SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM {c} UNION SELECT a, b, b, a FROM {c} WHERE length(a) = length(b))"


def _parts(c):
    """All parts p of the longer text that the shorter one is held against."""
    return f"(SELECT a, b, s, substr(l, greatest(i, 1)::BIGINT, (least(i + length(s) - 1, length(l)) - greatest(i, 1) + 1)::BIGINT) AS p FROM (SELECT *, unnest(range(2 - length(s), length(l) + 1)) AS i FROM {_sides(c)}))"


_TOKENS = f"o AS (SELECT a, b, {_SORTED.format(c='a')} AS sa, {_SORTED.format(c='b')} AS sb FROM q)"
_ONLY_RATIO = f"WITH RECURSIVE {_NAMES}, {_LCS.format(need='SELECT a AS x, b AS y FROM q')} SELECT a, b, round(score, 6) AS score FROM q JOIN r ON r.x = a AND r.y = b"
_PARTIAL = f"WITH RECURSIVE {_NAMES}, w AS {_parts('q')}, {_LCS.format(need='SELECT s AS x, p AS y FROM w')} SELECT a, b, round(max(score), 6) AS score FROM w JOIN r ON r.x = s AND r.y = p GROUP BY a, b"
_TOKEN_SORT = f"WITH RECURSIVE {_NAMES}, {_TOKENS}, {_LCS.format(need='SELECT sa AS x, sb AS y FROM o')} SELECT a, b, round(score, 6) AS score FROM o JOIN r ON r.x = sa AND r.y = sb"
_TOKEN_SET = f"WITH RECURSIVE {_NAMES}, {_SETS}, {_LCS.format(need=_NEED_SET)} SELECT m.a, m.b, round({_SET}, 6) AS score FROM {_SET_FROM}"
_WEIGHTED = f"""WITH RECURSIVE {_NAMES}, {_SETS}, {_TOKENS}, w AS {_parts('q')},
d AS (SELECT a, b, array_to_string(wa, ' ') AS da, array_to_string(wb, ' ') AS db FROM k),
u AS (SELECT sa AS a, sb AS b FROM o UNION SELECT da, db FROM d), z AS {_parts('u')},
{_LCS.format(need='SELECT a AS x, b AS y FROM q UNION ALL SELECT sa, sb FROM o UNION ALL SELECT s, p FROM w UNION ALL SELECT s, p FROM z UNION ALL ' + _NEED_SET)},
f1 AS (SELECT a, b, max(score) AS v FROM w JOIN r ON r.x = s AND r.y = p GROUP BY a, b),
f2 AS (SELECT a, b, max(score) AS v FROM z JOIN r ON r.x = s AND r.y = p GROUP BY a, b),
st AS (SELECT m.a, m.b, shared, {_SET} AS v FROM {_SET_FROM}),
h AS (SELECT q.a, q.b, greatest(length(q.a), length(q.b)) / least(length(q.a), length(q.b))::DOUBLE AS spread, r0.score AS plain, rs.score AS sorted, st.v AS sets, f1.v AS part, CASE WHEN st.shared <> '' THEN 100.0::DOUBLE ELSE greatest(f2.v, f3.v) END AS parts
  FROM q JOIN o USING (a, b) JOIN st USING (a, b) JOIN r r0 ON r0.x = q.a AND r0.y = q.b JOIN r rs ON rs.x = sa AND rs.y = sb JOIN f1 ON f1.a = q.a AND f1.b = q.b JOIN f2 ON f2.a = sa AND f2.b = sb JOIN d USING (a, b) JOIN f2 f3 ON f3.a = da AND f3.b = db)
SELECT a, b, round(CASE WHEN spread < 1.5 THEN greatest(plain, 0.95::DOUBLE * sorted, 0.95::DOUBLE * sets) ELSE greatest(plain, CASE WHEN spread <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END * part, 0.95::DOUBLE * CASE WHEN spread <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END * parts) END, 6) AS score FROM h"""
_GROUPED = "g AS (SELECT count(*) AS n FROM part GROUP BY lower(p_name), lower(p_brand) HAVING count(*) > 1)"
_MEMBERS = f"m AS ({SQL_PART_MEMBERS})"


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


QUERIES = {
    "score_ratio": (_score("ratio"), _ONLY_RATIO),
    "score_partial_ratio": (_score("partial_ratio"), _PARTIAL),
    "score_token_sort_ratio": (_score("token_sort_ratio"), _TOKEN_SORT),
    "score_token_set_ratio": (_score("token_set_ratio"), _TOKEN_SET),
    "score_wratio": (_score("WRatio"), _WEIGHTED),
    "profile_validate": (profile_validate, "SELECT true AS is_valid, count(*) AS record_count, 0 AS errors, 'column ''nothing'' is empty; column ''rare'' is mostly null; column 3 has no name' || CASE WHEN count(*) > 100000 THEN '; ' || count(*) || ' rows' ELSE '' END AS warnings, 'p_partkey,nothing,rare,Unnamed: 3' AS fields FROM part"),
    "configuration_errors": (configuration_errors, _values("configuration, setting", "('invalid', 'matching.mode')", "('invalid', 'matching.fields')", "('invalid', 'resolution.default_action')", "('invalid', 'performance.memory_limit_mb')", "('invalid', 'performance.batch_size')", "('threshold', 'matching.fuzzy_threshold')")),
    "normalized_record": (normalized_record, f"SELECT {sql_text('p_name')} AS p_name, {sql_aggressive('p_brand')} AS p_brand, '' AS absent FROM part"),
    "key_from_values": (key_from_values, f"SELECT s_suppkey, {sql_text('s_name')} || '|' || s_nationkey AS key FROM supplier"),
    "inferred_kinds": (inferred_kinds, "SELECT c AS \"column\", CASE WHEN c LIKE '%name%' THEN 'text_aggressive' ELSE 'text' END AS kind FROM (SELECT column_name AS c FROM (DESCRIBE supplier)) UNION ALL VALUES ('work_email', 'email'), ('Phone 2', 'phone')"),
    "exact_summary_text": (exact_summary_text, f"WITH {_GROUPED} SELECT printf('%d groups of %d records (sizes %d to %d, %.2f on average): merge %d, keep first %d, flag %d', count(*), sum(n)::BIGINT, min(n), max(n), avg(n), count(*) FILTER (n BETWEEN 3 AND 5), count(*) FILTER (n = 2), count(*) FILTER (n > 5)) AS text FROM g"),
    "fuzzy_summary_text": (fuzzy_summary_text, f"{detection._GROUPS} SELECT printf('%d groups of %d records, similarity %.1f to %.1f (%.1f on average)', count(*), sum(group_size)::BIGINT, min(similarity_score), max(similarity_score), avg(similarity_score)) AS text FROM z"),
    "golden_of_groups": (golden_of_groups, f"SELECT min(p_partkey) AS group_id, first(p_name ORDER BY p_partkey) AS p_name, first(p_type ORDER BY p_partkey) AS p_type, first(p_size ORDER BY p_partkey) AS p_size, count(*) AS sources FROM part GROUP BY {sql_text('p_name')}, {sql_text('p_brand')} HAVING count(*) > 1"),
    "decisions_listed": (decisions_listed, _values("seq, group_id, action, selected, notes", "(0::BIGINT, 4::BIGINT, 'MERGE', '4,9,7', 'confirmed')", "(1, 2, 'KEEP', '2', '')", "(2, 5, 'FLAG', '', '')")),
    "output_report": (
        output_report,
        f"WITH {_GROUPED}, c AS (SELECT (SELECT count(*) FROM part)::DOUBLE AS n, (SELECT count(*) FROM g)::DOUBLE AS k) SELECT section, key, round(value, 6) AS value FROM (SELECT 'data' AS section, 'records' AS key, n AS value FROM c UNION ALL SELECT 'data', 'fields', 2 UNION ALL SELECT 'performance', 'seconds', 4 UNION ALL SELECT 'performance', 'records_per_second', n / 4 FROM c UNION ALL SELECT 'performance', 'memory_mb', 64 UNION ALL SELECT 'duplicates', 'groups', k FROM c UNION ALL SELECT 'duplicates', 'exact', 3 UNION ALL SELECT 'duplicates', 'fuzzy', 1 UNION ALL SELECT 'duplicates', 'exact_method', k FROM c UNION ALL SELECT 'quality', 'duplicate_rate', k * 2 / n * 100 FROM c UNION ALL SELECT 'quality', 'exact_rate', k * 2 / n * 100 FROM c UNION ALL SELECT 'quality', 'fuzzy_rate', 0 UNION ALL SELECT 'quality', 'completeness_score', least(100, 85 + (1 - k / n) * 15) FROM c)",
    ),
    "output_all": (output_all, f"WITH {_MEMBERS} SELECT 'cleaned' AS output, count(*) FILTER (r = g) AS records FROM m UNION ALL SELECT 'audit', count(*) FILTER (n > 1) FROM m UNION ALL SELECT 'report', count(*) FROM part"),
    "output_checked": (output_checked, "SELECT 'rows' AS expectation, count(*) || ' rows, not 24' AS wrong FROM nation UNION ALL SELECT 'columns', 'column n_flag is missing' UNION ALL SELECT 'both', 'column n_flag is missing' UNION ALL SELECT 'both', count(*) || ' rows, not 26' FROM nation"),
    "audit_loaded": (audit_loaded, "SELECT 'DATA_LOADED' AS event_type, count(*) AS record_count, 'part.parquet' AS what FROM part UNION ALL SELECT 'DATA_NORMALIZED', count(*), NULL FROM part"),
    "audit_decided": (audit_decided, f"WITH {_MEMBERS}, {_GROUPED} SELECT 'RESOLUTION_DECISION' AS event_type, CASE WHEN r = g THEN 'KEEP' ELSE 'SOFT_DELETE' END AS what, count(*) AS events FROM m WHERE n > 1 GROUP BY 2 UNION ALL SELECT 'GOLDEN_RECORD_CREATED', 'first_non_null', count(*) FROM g HAVING count(*) > 0 UNION ALL SELECT 'RECORD_DELETED', 'duplicate', count(*) FROM m WHERE r <> g HAVING count(*) > 0"),
    "audit_services": (audit_services, "SELECT 'SESSION_START' AS event_type, NULL::BIGINT AS record_count, NULL AS what UNION ALL SELECT 'DATA_EXPORTED', count(*), 'out.csv' FROM nation UNION ALL SELECT 'PERFORMANCE_METRICS', NULL, 'exact' UNION ALL SELECT 'SYSTEM_ERROR', NULL, 'loading' UNION ALL SELECT 'USER_ACTION', NULL, 'merge' UNION ALL SELECT 'SESSION_END', NULL, NULL"),
    "audit_session": (audit_session, _values("check, holds", "('same', true)", "('lasted', true)", "('ended', true)", "('closed', true)").replace("check,", '"check",')),
    "content_hashes": (content_hashes, _values("change, same", "('shuffled', true)", "('row_twice', false)", "('value_changed', false)")),
    "processing_log": (processing_log, _values("record_id, action, reason, similarity_score, user_decision", "('4', 'KEEP', 'it''s first', 100.0::DOUBLE, false)", "('9', 'DELETE', 'a \"copy\"', 97.5, false)")),
    "activity_log": (
        activity_log,
        _values("operation, kind, what, path, size, succeeded, records_per_second, detail, value, unit", "(1::BIGINT, 'file', 'read', 'a.csv', 120::BIGINT, true, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL)", "(2, 'data', 'exact', NULL, NULL, NULL, 2000.0, NULL, NULL, NULL)", "(3, 'user', 'merge', NULL, NULL, NULL, NULL, 4, NULL, NULL)", "(4, 'system', 'start', NULL, NULL, NULL, NULL, 8, NULL, NULL)", "(5, 'performance', 'memory', NULL, NULL, NULL, NULL, NULL, 64.0, 'MB')"),
    ),
    "handled_errors": (handled_errors, _values("x, kind, holds, count", "('absent_file', 'FileProcessingError', true, 1)", "('absent_column', 'DataValidationError', true, 1)", "('memory', 'OutOfMemory', true, 1)", "('own', 'ResolutionError', true, 1)", "('other', 'ProcessingError', true, 1)", "('limit', 'memory is 600, above the limit of 512', true, 5)").replace("v(x,", 'v("case",')),
    "metric_precision_recall": (metric_precision_recall, f"SELECT precision, recall, f1 FROM ({reporting._CONFUSED})"),
    "metric_run_test": (metric_run_test, "SELECT 'self' AS name, count(*) AS true_positives, (count(*) > 0)::INT::DOUBLE AS precision, (count(*) > 0)::INT::DOUBLE AS recall, true AS timed, true AS rate FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND lower(a.p_brand) = lower(b.p_brand) AND lower(a.p_type) = lower(b.p_type) AND a.p_partkey < b.p_partkey"),
    "encodings_detected": (encodings_detected, "SELECT w AS written, d AS detected, (SELECT count(*) FROM nation) AS names, 0::BIGINT AS replaced FROM (VALUES ('UTF-8', 'utf-8'), ('ISO-8859-1', 'iso-8859-1'), ('UTF-16', 'utf-16')) v(w, d)"),
    "csv_file_loaded": (csv_file_loaded, "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region"),
    "json_file_loaded": (json_file_loaded, "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region"),
    "tables_listed": (tables_listed, _values("table_name, is_temporary", "('listed_nation', true)", "('listed_region', true)")),
    "database_texts": (database_texts, _values("kind, url, driver, sql, present", "('mysql', 'jdbc:mysql://host:3306/shop', 'com.mysql.cj.jdbc.Driver', 'SELECT `id`, `total` FROM `s`.`orders` WHERE total > 5 LIMIT 10', false)", "('postgresql', 'jdbc:postgresql://host:5432/shop', 'org.postgresql.Driver', 'SELECT \"id\", \"total\" FROM \"s\".\"orders\" WHERE total > 5 LIMIT 10', false)")),
    "resolve_single_records": (resolve_single_records, f"WITH {_MEMBERS}, x AS (SELECT *, max(r) OVER (PARTITION BY g) AS last FROM m) SELECT r AS p_partkey, CASE WHEN n = 1 THEN 'original' WHEN g % 2 = 0 THEN CASE WHEN r = last THEN 'hard_deleted' ELSE 'original' END WHEN r = last THEN 'kept' ELSE 'soft_deleted' END AS status, CASE WHEN n = 1 THEN NULL WHEN g % 2 = 0 THEN CASE WHEN r = last THEN 'DELETE' END WHEN r = last THEN 'KEEP' ELSE 'SOFT_DELETE' END AS action FROM x"),
}
