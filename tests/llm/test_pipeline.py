"""The pipeline's stages, one by one, against brute force over planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from test_edges import VOCABULARY, brute_near, brute_passages, text


def test_stages(spark, docs, folder):
    rng = random.Random(1)
    rows = [(i, text(80, i), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, " ".join(f"{w.upper()}!!" for w in text(80, 900 + i).split()), "s1") for i in range(12)]
    near = text(80, 5).split()
    for i in range(4):
        words = list(near)
        words[rng.randrange(80)] = rng.choice(VOCABULARY)
        rows.append((200 + i, " ".join(words), "s2"))
    passage, leak = text(60, 4000), "uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici"
    rows += [(300 + i, f"{text(60, 5000 + i)} {passage}", "s0") for i in range(3)]
    rows += [(400, f"{text(30, 6000)} {leak}", "s0"), (500, text(80, 7), None)]
    rows += [(401 + i, f"{text(900 * i + 40, 6100 + i)} {leak} {text(30, 6200 + i)}", "s0") for i in range(3)]  # also in long texts
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(12)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    table = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    sf = folder(documents=table, labels=labels, benchmark=items)
    seen, current = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, current, sf), name)
        seen[name] = (current.collect(), out.collect())
        if name != "mixture":
            assert out.columns == table.columns
        current = out
    ids = {n: {r["doc_id"] for r in after} for n, (_, after) in seen.items()}
    assert {r[0] for r in rows if not 100 <= r[0] < 112} <= ids["quality"] and not {100 + i for i in range(12)} <= ids["quality"]
    before, after = seen["near_duplicates"]
    keep = {d for d, (_, c) in brute_near([(r["doc_id"], r["text"]) for r in before], 5).items() if c == d}
    assert {r["doc_id"] for r in after} == keep
    before, after = seen["repeated_passages"]
    want = brute_passages([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: len(r["text"].split()) for r in after} == {d: n - gone for d, (n, gone, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    # Of documents that share the leak the first still has it when the stage runs; alone, the stage finds all of them.
    holders = {r["doc_id"] for r in seen["leaks"][0] if leak in r["text"]}
    assert 400 in holders and ids["leaks"] == ids["repeated_passages"] - holders
    alone = corpus_pipeline.leaks(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r["doc_id"] for r in alone.collect()} == {r[0] for r in rows} - {400, 401, 402, 403}
    mixed = seen["mixture"][1]
    size = sum(len(r["text"].split()) for r in seen["mixture"][0])
    assert abs(sum(len(r["text"].split()) for r in mixed) - size) <= 4
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, docs, folder):
    table = docs([(1, "a", "s")]).limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, folder(documents=table, labels=labels, benchmark=items)).count() == 0


def test_rows_without_own_ids(spark, docs, folder):
    """Decisions are about rows: null and repeated ids lose no other rows."""
    leak = "uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici"
    rows = [(None, text(50, 1)), (None, f"{text(20, 2)} {leak}"), (1, f"{text(20, 3)} {leak}"), (1, text(50, 4)), (1, text(50, 4)), (2, text(50, 4)), (None, text(50, 4)), (3, None), (4, "")]
    table = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    sf = folder(documents=table, labels=spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").limit(0), benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    read = spark.read.parquet(f"{sf}/documents.parquet")
    left = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.where("length(text) > 0").collect())
    assert corpus_pipeline.quality(spark, read, sf).count() == len(rows)
    assert left(corpus_pipeline.leaks(spark, read, sf)) == sorted((r[0] or 0, r[1]) for r in rows if r[1] and leak not in r[1])
    once = corpus_pipeline.near_duplicates(spark, read, sf)
    assert left(once) == sorted([(0, text(50, 1)), (0, f"{text(20, 2)} {leak}"), (1, f"{text(20, 3)} {leak}"), (1, text(50, 4))])
    assert corpus_pipeline.repeated_passages(spark, read, sf).count() == len(rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where(F.col("repetition") > 3).count() == 0
