"""Record operators on the fixtures and edge cases."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinfold import errors
from kinfold.functions import similarity as S
from kinfold.operators import audit, exact, files, fuzzy, golden, metrics, output, profile, resolve
from kinfold.operators.components import components
from kinfold.sources import files as sources
from kinfold.sources import jdbc
from kinfold.types import Decision, ProcessingStats, decisions_frame

CUSTOMERS = [
    (1, "John Smith", "john.smith@email.com", "555-0101", "123 Main St", "Springfield", "IL", "62701", "2023-01-15"),
    (2, "Jane Doe", "jane.doe@email.com", "555-0102", "456 Oak Ave", "Springfield", "IL", "62702", "2023-01-16"),
    (3, "John Smith", "john.smith@gmail.com", "555-0101", "123 Main Street", "Springfield", "Illinois", "62701", "2023-01-17"),
    (4, "Bob Johnson", "bob.johnson@email.com", "555-0103", "789 Pine Rd", "Chicago", "IL", "60601", "2023-01-18"),
    (5, "Jane Doe", "jane.doe@email.com", "555-0102", "456 Oak Avenue", "Springfield", "IL", "62702", "2023-01-19"),
    (6, "Alice Brown", "alice.brown@email.com", "555-0104", "321 Elm St", "Peoria", "IL", "61601", "2023-01-20"),
    (7, "John Smith", "j.smith@email.com", "555-0101", "123 Main St", "Springfield", "IL", "62701", "2023-01-21"),
]
SCHEMA = "id long, name string, email string, phone string, address string, city string, state string, zip_code string, created_date string"


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(CUSTOMERS, SCHEMA)


def as_sets(members):
    out = {}
    for r in members.collect():
        out.setdefault(r["group_id"], set()).add(r["record_id"])
    return out


@pytest.mark.parametrize(
    ("fields", "kinds", "want", "actions"),
    [
        (["name"], ["text"], {1: {1, 3, 7}, 2: {2, 5}}, {1: "merge", 2: "keep_first"}),
        (["name", "phone"], ["text", "phone"], {1: {1, 3, 7}, 2: {2, 5}}, {1: "merge", 2: "keep_first"}),
        (["email", "phone"], ["email", "phone"], {2: {2, 5}}, {2: "keep_first"}),
    ],
)
def test_exact(customers, fields, kinds, want, actions):
    assert as_sets(exact.members(customers, "id", fields, dict(zip(fields, kinds, strict=True)))) == want
    found = exact.by_composite_key(customers, "id", fields, kinds)
    assert {r["group_id"]: r["recommended_action"] for r in found.collect()} == actions
    assert "groups of" in exact.text_summary(found)


def test_exact_edges(spark, customers):
    empty = customers.limit(0)
    assert exact.groups(empty, "id", ["name"]).count() == 0
    assert exact.statistics(exact.groups(empty, "id", ["name"])).first()["total_groups"] == 0
    nulls = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "", "x")], "id long, name string, z string")
    assert as_sets(exact.members(nulls, "id", ["name"])) == {1: {1, 2, 3}}
    assert as_sets(exact.members(nulls, "id", ["name"], use_normalized=False)) == {1: {1, 2}}
    for fields in ([], ["absent"]):
        with pytest.raises(errors.DataValidationError):
            exact.groups(customers, "id", fields)
    clash = spark.createDataFrame([(1, "a||b", "c"), (2, "a", "b||c")], "id long, x string, y string")
    assert exact.groups(clash, "id", ["x", "y"], use_normalized=False).count() == 0


def test_fuzzy_fixture(spark):
    rows = [(1, "John Smith", "john.smith@email.com"), (2, "Jon Smith", "j.smith@email.com"), (3, "John Smyth", "john.smyth@email.com"), (4, "Jane Doe", "jane.doe@email.com"), (5, "Jane Do", "jane.doe@email.com")]
    df = spark.createDataFrame(rows, "id long, name string, email string")
    found, members = fuzzy.find(df, "id", ["name", "email"], 70, "WRatio", {"name": "text_aggressive", "email": "email"})
    groups = as_sets(members)
    assert any({1, 3} <= g for g in groups.values()) and any({4, 5} <= g for g in groups.values())
    assert {r["recommended_action"] for r in found.collect()} == {"flag"}
    with pytest.raises(errors.ConfigurationError):
        fuzzy.pairs(fuzzy.blocked(fuzzy.keys(df, "id", ["name"])), "jaro")
    with pytest.raises(errors.ConfigurationError):
        fuzzy.pairs(fuzzy.blocked(fuzzy.keys(df, "id", ["name"])), "ratio", 101)


SCORES = {"ratio": S.indel, "partial_ratio": S.partial, "token_sort_ratio": S.token_sort, "token_set_ratio": S.token_set, "WRatio": S.weighted}


@pytest.mark.parametrize("algorithm", sorted(SCORES))
def test_fuzzy_brute_force(spark, algorithm):
    """Groups and scores against all pairs, with repeated keys, blocks and small cells."""
    rng = random.Random(5)
    words = ["alpha", "alpine", "beta", "betas", "gamma ray", "gamma", "delta x", "delta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(90)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "id long, name string")
    for limit, threshold in ((100_000, 88.0), (10, 80.0)):
        blocks = fuzzy.blocked(fuzzy.keys(df, "id", ["name"]), limit)
        found, members = fuzzy.grouped(blocks, algorithm, threshold)
        keys = {i: n for i, n in rows if n}
        block = {i: "all" if limit == 100_000 else f"{n[:2]}_{len(n) // 10}" for i, n in keys.items()}
        links = {(a, b): s for a, b in itertools.combinations(keys, 2) if block[a] == block[b] and (s := SCORES[algorithm](keys[a], keys[b])) >= threshold}
        group = {i: i for i in keys}

        def root(i):
            while group[i] != i:
                i = group[i]
            return i

        for a, b in links:
            x, y = sorted((root(a), root(b)))
            group[y] = x
        want = {}
        for i in keys:
            want.setdefault(root(i), set()).add(i)
        want = {g: m for g, m in want.items() if len(m) > 1}
        assert as_sets(members) == want
        for r in found.collect():
            own = [s for (a, _), s in links.items() if root(a) == r["group_id"]]
            assert abs(r["similarity_score"] - sum(own) / len(own)) <= 0.051 and r["group_size"] == len(want[r["group_id"]])
        small = fuzzy.pairs(blocks, algorithm, threshold, part=7).collect()
        assert {(r["a"], r["b"]) for r in small} == set(links) and len(small) == len(links)


def test_fuzzy_order_of_work(spark):
    """Keys are normalized once, whatever they are asked for afterwards; pairs are scored only if their bounds allow it."""
    df = spark.createDataFrame([(i, f"Blue ring {i % 50}!") for i in range(200)], "id long, name string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    blocks = fuzzy.blocked(fuzzy.keys(df, "id", ["name"]), 10)
    assert "regexp" not in plan(blocks) and blocks.count() == 200
    links = fuzzy.pairs(fuzzy.classes(blocks), "levenshtein", 90.0)
    condition = next(line for line in plan(links).splitlines() if "Join Inner" in line and "levenshtein" in line)
    assert condition.index("bit_count") < condition.index("levenshtein")
    keys = {i: f"blue ring {i}" for i in range(50)}
    want = {(a, b) for a, b in itertools.combinations(keys, 2) if len(keys[a]) // 10 == len(keys[b]) // 10 and sum(x != y for x, y in zip(keys[a], keys[b], strict=False)) + abs(len(keys[a]) - len(keys[b])) <= 1}
    assert {(r["a"], r["b"]) for r in links.collect()} >= want and links.count() == links.select("a", "b").distinct().count()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    assert {r["id"]: r["component"] for r in components(df).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(df.limit(0)).count() == 0


def merge_sample(spark):
    rows = [
        (1, "John Smith", "john@email.com", "555-123-4567", "123 Main St", "Springfield", None, "12345"),
        (2, "John Smith", None, "555-123-4567", None, "Springfield", "IL", "12345"),
        (3, "John Smith", "j.smith@email.com", "555-123-4567", "123 Main Street", None, "Illinois", None),
    ]
    return spark.createDataFrame(rows, "id long, name string, email string, phone string, address string, city string, state string, zip_code string")


def test_merge(spark):
    records = merge_sample(spark)
    members = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "group_id long, record_id long")
    out, rejects = resolve.apply(records, "id", members, decisions_frame(spark, [Decision(1, "MERGE", (1, 2, 3))]))
    first = out.where("_resolution_status = 'merged_primary'").first()
    assert (first["id"], first["email"], first["address"], first["state"]) == (1, "john@email.com", "123 Main St", "IL")
    assert first["_merged_from_ids"] == "1,2,3" and rejects.count() == 0
    assert output.cleaned(out).count() == 1


def test_decisions(spark, customers):
    members = exact.members(customers, "id", ["name"])
    decisions = [Decision(1, "MERGE", (1, 3, 7)), Decision(2, "KEEP", (2,)), Decision(2, "DELETE", (5,)), Decision(9, "FLAG"), Decision(2, "BURN"), Decision(1, "MERGE", (1, 3)), Decision(1, "MERGE", (1,)), Decision(2, "KEEP", ())]
    out, rejects = resolve.apply(customers, "id", members, decisions_frame(spark, decisions))
    status = {r["_original_index"]: r["_resolution_status"] for r in out.collect()}
    assert status == {1: "merged_primary", 3: "merged_secondary", 7: "merged_secondary", 2: "kept", 5: "soft_deleted", 4: "original", 6: "original"}
    assert {r["seq"]: r["reason"] for r in rejects.collect()} == {2: "not confirmed", 3: "unknown group", 4: "unknown action", 5: "second merge of a group", 6: "fewer than two records selected", 7: "no record selected"}
    assert output.cleaned(out).count() == 4
    later = decisions_frame(spark, [Decision(2, "FLAG"), Decision(2, "DELETE", (5,), "Confirmed")])
    status = {r["_original_index"]: r["_resolution_status"] for r in resolve.apply(customers, "id", members, later)[0].collect()}
    assert (status[2], status[5]) == ("flagged", "hard_deleted")


def test_golden(spark):
    rows = [(1, 1, "a", "x", "2020-01-01"), (1, 2, "bbb", None, "2022-01-01"), (1, 3, "bbb", "y", "2021-01-01"), (2, 4, None, " ", None)]
    df = spark.createDataFrame(rows, "g long, id long, v string, w string, ts string")
    pick = lambda rule, **o: {r["_group_id"]: (r["v"], r["w"]) for r in golden.golden_records(df, "g", "id", fields=["v", "w"], default=rule, **o).collect()}
    assert pick("most_complete") == {1: ("a", "x"), 2: (None, None)}
    assert pick("longest_value")[1] == ("bbb", "x")
    assert pick("most_frequent")[1] == ("bbb", "x")
    assert pick("first_non_null")[1] == ("a", "x")
    assert pick("most_recent", timestamp_field="ts")[1] == ("bbb", "y")
    assert pick("no such rule") == pick("most_complete")
    bad = df.withColumn("ts", F.lit("not a time"))
    assert golden.golden_records(bad, "g", "id", fields=["v"], default="most_recent", timestamp_field="ts").where("_group_id = 1").first()["v"] == "a"
    sources = golden.golden_records(df, "g", "id", fields=["v", "w"]).where("_group_id = 2").first()["_field_sources"]
    assert sources == {"v": -1, "w": -1}


def test_profile(spark):
    df = spark.createDataFrame([(1, None, " "), (2, None, "x")], "a long, b string, `Unnamed: 2` string")
    found = profile.validate(df)
    assert found.is_valid and len(found.warnings) == 2 and found.record_count == 2
    assert not profile.validate(df.limit(0)).is_valid
    assert not profile.validate(df.select("a", "a")).is_valid
    assert not profile.validate(df.select()).is_valid


def test_configuration():
    good = {"matching": {"mode": "both", "fields": ["a"], "fuzzy_threshold": 80}, "resolution": {"default_action": "FLAG", "merge_strategy": "most_complete"}, "performance": {"memory_limit_mb": 100, "batch_size": 10}}
    assert errors.validate_configuration(good) == []
    bad = {"matching": {"mode": "wild", "fields": [], "fuzzy_threshold": 150}, "resolution": {"default_action": "BURN"}, "performance": {"memory_limit_mb": -100, "batch_size": 0}}
    assert len(errors.validate_configuration(bad)) == 5
    handler = errors.ErrorHandler()
    assert isinstance(handler.handle(MemoryError("x")), errors.OutOfMemory) and isinstance(handler.handle(FileNotFoundError("x")), errors.FileProcessingError)
    assert handler.summary() == {"OutOfMemory": 1, "FileProcessingError": 1} and handler.limit("records", 2, 1) and handler.limit("records", 1, 2) is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,\"x,\ny\"\n2,N/A\n3,é\n".encode("iso-8859-1"))
    assert sources.detect_encoding(spark, str(tmp_path / "a.csv")) == "iso-8859-1"
    got = sources.load_csv(spark, str(tmp_path / "a.csv"), encoding=None).orderBy("id").collect()
    assert [r["name"] for r in got] == ["x,\ny", None, "é"]
    (tmp_path / "b.json").write_text('[{"a": 1, "b": null}, {"a": 2, "b": "y"}]')
    assert [tuple(r) for r in sources.load_file(spark, str(tmp_path / "b.json")).orderBy("a").collect()] == [("1", None), ("2", "y")]
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(errors.FileProcessingError):
        sources.load_json(spark, str(tmp_path / "c.json"))
    with pytest.raises(errors.FileProcessingError):
        sources.load_file(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(errors.FileProcessingError):
        sources.load_file(spark, "x.xlsx")
    with pytest.raises(errors.ConfigurationError):
        jdbc.Database("oracle", "h", "d", "u", "p")
    assert jdbc.Database("mysql", "h", "d", "u", "p").url == "jdbc:mysql://h:3306/d"
    assert jdbc.table_sql("a.t", ["x"], "x > 1", 5, "postgresql") == 'SELECT "x" FROM "a"."t" WHERE x > 1 LIMIT 5'


def test_files(spark, tmp_path):
    tree = {"documents/report.txt": b"r" * 40, "backup/report.txt": b"r" * 40, "backup/report_copy.txt": b"r" * 40, "documents/data.csv": b"d" * 37, "downloads/data.csv": b"d" * 37, "documents/image.txt": b"i" * 1500, "documents/image_backup.txt": b"i" * 1500, "downloads/readme.txt": b"n" * 22}
    for name, data in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.find(spark, str(tmp_path), preferred=["documents"])
    assert found.count() == 7
    plan = files.cleanup_plan(found)
    assert plan.count() == 4 and plan.agg(F.sum("bytes_freed")).first()[0] == 1617
    kept = {r["path"].rsplit(str(tmp_path) + "/", 1)[-1] for r in found.where("is_best").collect()}
    assert {"documents/report.txt", "documents/data.csv"} <= kept
    assert all(what.startswith("would") for _, what in files.cleanup(plan))
    files.cleanup(plan, dry_run=False, root=str(tmp_path))
    assert files.find(spark, str(tmp_path)).count() == 0  # what is recycled is hidden from scans
    assert len(list((tmp_path / ".recycle").rglob("*.*"))) == 4
    assert files.scan(spark, str(tmp_path), [".CSV"]).count() == 1  # the other one was recycled
    odd = tmp_path / "more" / "a b%20c é.txt"
    odd.parent.mkdir()
    odd.write_bytes(b"x" * 5_000_000)
    (tmp_path / "more" / "copy.txt").write_bytes(b"x" * 5_000_000)
    assert {r["hash"] for r in files.find(spark, str(tmp_path / "more")).collect()} == {hashlib.sha256(b"x" * 5_000_000).hexdigest()}
    assert files.find(spark, str(tmp_path / "more")).count() == 2


def test_encodings_and_lines(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,name\n1,José\n2,Zoë\n".encode("iso-8859-1"))
    (tmp_path / "utf.csv").write_text("id,name\n1,José\n2,\"a\nb\"\n", encoding="utf-8")
    (tmp_path / "wide.csv").write_text("id,name\n1,José\n", encoding="utf-16")
    assert [r["name"] for r in sources.load_csv(spark, str(tmp_path / "latin.csv")).collect()] == ["José", "Zoë"]
    assert [r["name"] for r in sources.load_csv(spark, str(tmp_path / "utf.csv")).collect()] == ["José", "a\nb"]
    assert [r["name"] for r in sources.load_csv(spark, str(tmp_path / "wide.csv")).collect()] == ["José"]
    assert sources.replaced(sources.load_csv(spark, str(tmp_path / "latin.csv"), encoding="utf-8")) == 2
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n{"b": "y"}\n')
    assert [(r["a"], r["b"]) for r in sources.load_json(spark, str(tmp_path / "lines.json")).collect()] == [("1", "x"), ("2", None), (None, "y")]
    (tmp_path / "array.json").write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    assert [r["a"] for r in sources.load_json(spark, str(tmp_path / "array.json")).collect()] == ["1", "2"]
    (tmp_path / "one.json").write_text('{\n "a": [1, 2, 3],\n "b": ["x", null, "z"]\n}\n')
    assert [(r["a"], r["b"]) for r in sources.load_json(spark, str(tmp_path / "one.json")).collect()] == [("1", "x"), ("2", None), ("3", "z")]


def test_outputs(spark, customers, tmp_path):
    members = exact.members(customers, "id", ["name"])
    out, _ = resolve.apply(customers, "id", members, resolve.simple_decisions(members, "keep"))
    groups = exact.groups(customers, "id", ["name"])
    paths = output.write_all(out, groups, f"file://{tmp_path}/out", stats=ProcessingStats(processing_time=1.0), kind="csv")
    assert output.check_written(spark, paths["cleaned"], "csv", ["id", "name"], 4) == []
    assert output.check_written(spark, paths["cleaned"], "csv", ["nope"], 5) != []
    empty = output.write_audit_log(output.audit_entries(out.limit(0)), f"file://{tmp_path}/none")
    assert spark.read.text(empty).count() <= 1
    assert resolve.simple_decisions(members, "other").count() == 0
    output.write_json_array(output.cleaned(out), str(tmp_path / "x.json"))
    assert sources.load_json(spark, str(tmp_path / "x.json")).count() == 4


def test_audit(spark, customers, tmp_path):
    log = audit.AuditLog(spark, f"file://{tmp_path}/log", "s")
    log.loaded("x.csv", customers)
    log.user_action("click", where="here")
    log.error(ValueError("it's None"))
    assert log.close() > 0
    assert log.events().count() == 5
    assert audit.content_hash(customers) == audit.content_hash(customers.orderBy(F.desc("id")).repartition(3))
    with pytest.raises(ValueError):
        log.log("NO_SUCH")


def test_metrics(spark):
    m = lambda rows: spark.createDataFrame(rows, "group_id long, record_id long")
    found, truth = m([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]), m([(1, 1), (1, 2), (3, 3), (4, 4), (4, 5), (4, 6)])
    a = metrics.confusion(metrics.pairs(found), metrics.pairs(truth), 6).first()
    b = metrics.confusion_by_group(found, truth, 6).first()
    assert a == b and (a["true_positives"], a["false_positives"], a["false_negatives"], a["true_negatives"]) == (2, 2, 2, 9)
    none = metrics.confusion(metrics.pairs(found.limit(0)), metrics.pairs(truth.limit(0)), 0).first()
    assert none["precision"] == 0 and none["f1"] == 0


def test_metric_pairs(spark):
    """Pairs in cells, of records in several groups and of repeated memberships; none is gathered to be told apart."""
    rng = random.Random(7)
    rows = [(0, i) for i in range(40)] + [(rng.randint(1, 9), rng.randint(20, 90)) for _ in range(150)] + [(0, 3), (None, 1), (None, 2), (1, None)]
    df = spark.createDataFrame(rows, "group_id long, record_id long")
    groups = {}
    for g, r in rows:
        if g is not None and r is not None:
            groups.setdefault(g, set()).add(r)
    want = sorted({p for m in groups.values() for p in itertools.combinations(sorted(m), 2)})
    for part in (7, 1000):
        assert sorted((r["a"], r["b"]) for r in metrics.pairs(df, part).collect()) == want
    assert metrics.pairs(df.limit(0)).count() == 0
    once = metrics.pairs(df.where("group_id = 0"), 7)
    assert once.select(F.spark_partition_id()).distinct().count() > 1  # the cells of one group are tasks of their own


def test_metric_confusion_of_memberships(spark, monkeypatch):
    """Memberships give what their pairs give, and no pair is made unless a record is in several groups."""
    rng = random.Random(3)
    make = lambda rows: spark.createDataFrame(rows, "group_id long, record_id long")
    one, two = ([(rng.randint(1, 8), r) for r in rng.sample(range(80), 60)] for _ in range(2))
    dirty = [*one, one[0], (None, 5), (3, None), (3, None)]
    several = [*two, (9, two[0][1]), (9, two[1][1]), (9, two[2][1])]
    cases = [(one, two), (dirty, two), (one, several), (several, dirty), ([], two), ([], [])]
    listed = [metrics.confusion(metrics.pairs(make(x)), metrics.pairs(make(y)), 80).first() for x, y in cases]
    assert [metrics.confusion(make(x), make(y), 80).first() for x, y in cases] == listed
    assert metrics.confusion(make(one), metrics.pairs(make(two)), 80).first() == listed[0]
    # More pairs than a double tells apart.
    assert metrics.confusion(make(one), make(two), 2_000_000_001).first()["true_negatives"] == 2_000_000_001 * 1_000_000_000 - sum(listed[0][:3])
    with pytest.raises(Exception, match="several groups"):
        metrics.confusion_by_group(make(one), make(several), 80).first()
    monkeypatch.setattr(metrics, "pairs", None)
    for x, y in (cases[0], cases[1], cases[4]):
        assert metrics.confusion(make(x), make(y), 80).first() == listed[cases.index((x, y))]
    assert metrics.precision_recall(make(one), make(one), 80).first()[:] == (1.0, 1.0, 1.0)
    assert metrics.run_test("self", lambda: make(one), make(one), 80)["true_positives"] == listed[0]["true_positives"] + listed[0]["false_positives"]


def test_stream(spark, tmp_path):
    from kinfold.streaming.exact import deduplicated

    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:10:00"), (2, "b", "2024-01-01 00:20:00")], "k long, v string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "ts")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
