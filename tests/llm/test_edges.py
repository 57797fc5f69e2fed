"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm import _segments as S
from kinfold.llm import (
    op1_fingerprints,
    op2_decontamination,
    op3_language,
    op4_mixing,
    op5_warc,
    op6_quality,
    op7_lm_scoring,
    op8_substrings,
    op9_passages,
    op10_near_duplicates,
)
from test_queries import brute_substrings

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Null, empty, blank, short and long texts, copies, and a passage that many share."""
    shared = text(60, 1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two three four"), (6, text(40, 2)), (7, text(40, 2)), (8, text(30000, 3)), (9, "a " * 3000)]
    rows += [(20 + i, f"{text(50, 100 + i)} {shared} {text(20, 200 + i)}") for i in range(6)]
    rows += [(40 + i, text(80, 300)[:-i] if i else text(80, 300)) for i in range(5)]
    return rows


def test_kernel():
    texts = ["", "a b  c", "é x\ty", None, "z" * 10, " lead", "trail "]
    (at, buf, offsets), = K.blocks(pa.array(texts, pa.string()))
    start, end, bounds = K.words(buf, offsets)
    found = [[bytes(buf[s:e]) for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [(t or "").encode().split() for t in texts]
    assert [b[0] for b in K.blocks(pa.array(texts, pa.string()), 4)][0] == at == 0
    data = np.frombuffer(b"abcabcab", np.uint8)
    names = K.names_of_length(data, 3)
    assert names[0] == names[3] and len(set(names.tolist())) == 3
    assert K.name(data, np.array([0]), np.array([3]))[0] != K.name(data, np.array([1]), np.array([4]))[0]
    for size in range(1, 20):
        rng = random.Random(size)
        parts = [bytes(rng.choice(b"ab") for _ in range(size)) for _ in range(40)]
        joined = np.frombuffer(b"".join(parts), np.uint8)
        named = K.name(joined, np.arange(40) * size, np.arange(1, 41) * size).tolist()
        assert len(set(named)) == len(set(zip(parts, named, strict=True))) == len(set(parts))
        names = K.names_of_length(joined, size).tolist()
        assert len(set(names)) == len({bytes(joined[i : i + size]) for i in range(len(names))})
    keys = np.random.default_rng(1).integers(0, 9, 50).astype(np.uint64)
    for w in (1, 3, 7, 50):
        assert K.window_minimum(keys, w).tolist() == [int(keys[i : i + w].min()) for i in range(len(keys) - w + 1)]
    assert K.spread(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def thue_morse(n):
    """Two texts of n letters that every polynomial modulo 2**64 gives one name to, from 2048 letters on."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words(spark, docs, folder, n):
    a, b = thue_morse(n)
    data = np.frombuffer((a + b).encode(), np.uint8)
    assert K.name(data, np.array([0]), np.array([n]))[0] != K.name(data, np.array([n]), np.array([2 * n]))[0]
    rows = [(1, a), (2, b), (3, f"{text(6, 1)} {a}"), (4, f"{text(6, 1)} {b}")]
    got = {r["doc_id"]: r["component_id"] for r in op10_near_duplicates.near_duplicates(docs(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    sf = folder(documents=docs(rows))
    assert {r[0]: tuple(r[1:]) for r in op9_passages.query(spark, sf).collect()} == brute_passages(rows)
    assert {r[0]: tuple(r[1:]) for r in op8_substrings.query(spark, sf).collect()} == brute_substrings(rows)
    scored = op7_lm_scoring.score(docs(rows).withColumn("train", F.col("doc_id") == 1)).collect()
    assert {r["doc_id"]: r["n_known"] for r in scored} == {1: 2, 2: 1, 3: 2, 4: 1}


def test_fingerprints(spark, docs):
    rows = [(1, None), (2, ""), (3, "One. Two!\n\nThree?\nFour"), (3, "One. Two!\n\nThree?\nFour"), (None, "lost"), (5, "x" * 5000)]
    for ranges in (1, 4, 50):
        got = op1_fingerprints.with_next(docs(rows), ranges).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
        want = sorted((r[0] or -1, r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order))
        assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got) == want
    assert op1_fingerprints.with_next(docs(rows[:1])).collect()[0]["next_text"] == ""
    assert op1_fingerprints.with_next(docs(rows).limit(0)).count() == 0
    a, b = "Same start. Then this one.\nLine two is kept.\n\nLast section.", "Same start. Then that one.\nLine two is kept.\n\nLast section."
    df = spark.createDataFrame([(a, b, a)], "a string, b string, c string")
    for c in "abc":
        df = op1_fingerprints.with_fingerprint(df, F.col(c), f"f{c}")
    row = df.select(op1_fingerprints.differing_leaves("fa", "fb").alias("d"), op1_fingerprints.differing_leaves("fa", "fc").alias("e"), op1_fingerprints.likeness("fa", "fb").alias("l"), op1_fingerprints.likeness("fa", "fc").alias("m")).first()
    assert [tuple(x) for x in row["d"]] == [(0, 0, 1)] and row["e"] == [] and 0.5 < row["l"] < 1 == row["m"]


def test_decontamination(spark, docs):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = spark.createDataFrame([(1, phrase + " xi"), (2, "rare short"), (3, None), (4, "..."), (5, phrase.upper())], "item_id long, text string")
    rows = [(1, f"{phrase} XI!"), (2, "a rare-short b"), (3, None), (4, ""), (5, "alpha beta gamma"), (6, "word " * 500 + phrase), (7, f"{phrase} XI!"), (7, f"{phrase} XI!")]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in op2_decontamination.decontaminate(docs(rows), items).collect())
    assert got == [(1, 14, 14, "1,5", True), (2, 4, 2, "2", True), (3, 0, 0, "", False), (4, 0, 0, "", False), (5, 3, 0, "", False), (6, 513, 13, "1,5", False), (7, 14, 14, "1,5", True), (7, 14, 14, "1,5", True)]
    whole = op2_decontamination.stored(op2_decontamination.index(docs(rows)), "index")
    assert whole.count() == sum(r[1] for r in got) + len(got)
    again = op2_decontamination.decontaminate(docs(rows), items, postings=whole).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in again) == got
    assert {r["n_hit"] for r in op2_decontamination.decontaminate(docs(rows), items.limit(0)).collect()} == {0}
    assert op2_decontamination.decontaminate(docs(rows).limit(0), items).count() == 0
    keyed = spark.createDataFrame([(1, ["gamma", "beta"])], "phrase_id long, phrase array<string>")
    terms = spark.createDataFrame([("beta", 1), ("gamma", 2)], "term string, term_id long")
    postings = op2_decontamination.index(docs([(1, "beta x x gamma"), (2, "gamma x x x x beta")]), terms)
    assert op2_decontamination.proximity(keyed, postings, terms, 3).count() == 1


def test_language(spark, docs):
    model = op3_language.learn([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "die katze und der hund " * 3000), (5, "the"), (None, "und der"), (6, "½ ² ① Ⅷ ٣"), (7, "der\nhund\n" * 5000), (8, "²the ½dog")]
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in op3_language.identify(docs(rows), model).collect())
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "en"), (6, "und"), (7, "de"), (8, "en")]
    assert len(op3_language.training_sample(docs([(1, f"text {i}") for i in range(9)] + [(2, "b")]))) == 2
    assert {r["lang_pred"] for r in op3_language.identify(docs(rows), None).collect()} == {"und"}
    assert op3_language.identify(docs(rows).limit(0), model).count() == 0
    labels = [lang for _, lang, _ in op3_language.words(model, "the dog and the cat der hund und die katze")]
    assert labels[:4] == ["en"] * 4 and labels[-4:] == ["de"] * 4


def test_forward_backward():
    rng = np.random.default_rng(3)
    emissions, transitions = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    post, expected = op3_language.forward_backward(emissions, lengths, transitions)
    alone = op3_language._posteriors_only(emissions, lengths, transitions)
    total = np.zeros((3, 3))
    for row, n in enumerate(lengths):
        weights, marginal = 0.0, np.zeros((n, 3))
        moves = np.zeros((3, 3))
        for path in np.ndindex(*(3,) * n):
            w = np.exp(sum(emissions[row, t, path[t]] for t in range(n)) + sum(transitions[path[t], path[t + 1]] for t in range(n - 1)))
            weights += w
            for t in range(n):
                marginal[t, path[t]] += w
            for t in range(n - 1):
                moves[path[t], path[t + 1]] += w
        assert np.allclose(post[row, :n], marginal / weights) and np.allclose(alone[row, :n], marginal / weights)
        total += moves / weights
    assert np.allclose(expected, total)


def test_mixing(spark, docs):
    rows = [(i, text(20 + i % 7, i), f"s{i % 4}" if i % 4 else None) for i in range(200)] + [(900, None, "s1"), (901, "", "empty"), (902, "a b", "tiny"), (5, text(25, 5), "s1"), (5, text(25, 5), "s1")]
    got = op4_mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["mix_extra"] <= r["mix_size"] and r["mix_whole"] * r["mix_size"] + r["mix_extra"] <= 3 * r["mix_size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        taken = sum(r["mix_whole"] * r["mix_size"] + r["mix_extra"] for r in own)
        assert abs(taken - own[0]["mix_target"]) <= 0.5
    repeated = op4_mixing.repeated(docs(rows))
    assert repeated.select(F.sum(op4_mixing.word_count())).first()[0] == sum(r["mix_whole"] * r["mix_size"] + r["mix_extra"] for r in got)
    assert repeated.columns == [*docs(rows).columns, "repetition"]
    assert op4_mixing.mix(docs(rows).limit(0)).count() == 0
    assert {r["mix_extra"] for r in op4_mixing.mix(docs([(1, None), (2, "")])).collect()} == {0}


def test_warc(spark, tmp_path):
    rows = [(3, "http://a", "x" * 100), (1, "http://b", "x" * 100), (2, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é" * 70000), (5, "http://d", "é" * 70000), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = op5_warc.write_warc(pages, f"file://{tmp_path}/w", min_revisit=50, roll_bytes=300, ranges=2)
    read = op5_warc.read_warc(spark, manifest, payload=True).collect()
    got = {r["page_id"]: r for r in read if r["page_id"] != 5 or r["record_type"] == "response"}
    assert sorted(r["page_id"] for r in read) == [1, 2, 3, 4, 5, 5, 6, 7] and len({(r["file"], r["offset"]) for r in read}) == len(read)
    assert [(r["refers_to"], r["payload_bytes"]) for r in read if r["page_id"] == 5 and r["record_type"] == "revisit"] == [(5, 140000)]
    assert (got[3]["record_type"], got[3]["refers_to"], got[3]["payload_bytes"]) == ("revisit", 1, 100)
    assert [got[i]["record_type"] for i in (1, 2, 4, 5, 6, 7)] == ["response"] * 6
    assert bytes(got[5]["payload"]) == ("é" * 70000).encode() and got[2]["payload_bytes"] == 0
    odd = [(None, "a", "x"), (None, "a", "x"), (None, "b", "yy"), (4, "c", "x"), (4, "c", "z"), (4, "d", "z"), (2, "e", None), (2, "e", None), (2, "e", "")]
    frame = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("row", F.lit("r")).withColumn("copy", F.lit(1)).withColumn("kind", F.lit("k"))
    back = op5_warc.read_warc(spark, op5_warc.write_warc(frame, f"file://{tmp_path}/o"), payload=True).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"]) for r in back) == sorted((p or 0, len(h or "")) for p, _, h in odd)
    assert sorted((r["payload_bytes"], r["page_id"]) for r in back if r["record_type"] == "response" and r["payload_bytes"] < 2) == [(0, 2), (1, 4), (1, 4)]
    assert {(r["page_id"], r["refers_to"]) for r in back if r["record_type"] == "revisit"} == {(2, 2), (4, 4), (None, 4)}
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 2 and not list((tmp_path / "w").glob("_temporary*"))
    again = op5_warc.write_warc(pages.repartition(3), f"file://{tmp_path}/v", min_revisit=50, roll_bytes=300, ranges=2)
    assert {f.name: f.read_bytes() for f in files} == {f.name: f.read_bytes() for f in (tmp_path / "v").glob("*.gz")} and again
    assert op5_warc.read_warc(spark, op5_warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_quality(spark, docs):
    good = [(i, text(60, i)) for i in range(80)]
    bad = [(100 + i, " ".join(f"{w.upper()}###" for w in text(60, 500 + i).split())) for i in range(20)]
    rows = [*good, *bad, (200, None), (201, ""), (1, text(60, 1))]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = op6_quality.resample(docs(rows), labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(80)) and sum(kept[100 + i] for i in range(20)) < 20
    assert all(r["kept"] for r in op6_quality.resample(docs(rows), labels.limit(0)).collect())
    assert op6_quality.resample(docs(rows).limit(0), labels).count() == 0
    keys = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, 3, 9, 2, 2]], "key double")
    for k, want in ((1, (9.0, 1)), (4, (2.0, 1)), (5, (2.0, 2)), (7, (1.0, 2)), (8, (1.0, 3))):
        assert op6_quality.kth_greatest(keys, k, "key", bins=4) == want


def test_lm(spark, docs):
    rows = odd_rows()
    df = docs(rows).withColumn("train", F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r for r in op7_lm_scoring.score(df).collect()}
    assert set(got) == {r[0] for r in rows} and got[1]["n_tokens"] == 1 and got[8]["n_tokens"] == 30001
    assert op7_lm_scoring.score(df.limit(0)).count() == 0
    none = op7_lm_scoring.score(df.withColumn("train", F.lit(False))).collect()
    assert {r["n_known"] for r in none} == {0} and {r["train_tokens"] for r in none} == {0}
    twice = op7_lm_scoring.score(docs([(1, "a b"), (1, "a b"), (None, "a b")]).withColumn("train", F.lit(True))).collect()
    assert len(twice) == 3 and len({round(r["score"], 6) for r in twice}) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_elias_fano(n):
    values = np.sort(np.random.default_rng(n).integers(0, 10 * n + 1, n)).astype(np.uint64)
    assert op7_lm_scoring.EliasFano(values)[np.arange(n)].tolist() == values.tolist()
    for width in (1, 7, 10, 33):
        raw = values % np.uint64(1 << min(width, 20))
        assert op7_lm_scoring.read_bits(op7_lm_scoring.pack_bits(raw, width), np.arange(n), width).tolist() == raw.tolist()


def test_trie():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (500, 2))})
    c, w = (np.array([p[i] for p in pairs], np.uint64 if i == 0 else np.uint32) for i in (0, 1))
    logs = rng.uniform(-8, 0, len(pairs))
    trie = op7_lm_scoring.Trie(c, w, logs)
    ask = [(a, b) for a in range(62) for b in range(62)]
    got = trie.find(np.array([a for a, _ in ask], np.uint64), np.array([b for _, b in ask], np.uint32))
    want = dict(zip(pairs, logs, strict=True))
    for x, g in zip(ask, got, strict=True):
        assert (x in want) == (not np.isnan(g)) and (x not in want or abs(g - want[x]) < 0.008)


def test_substrings(spark, docs):
    rows = [r for r in odd_rows() if r[0] != 8] + [(8, text(3000, 3)), (60, "ü" * 300), (61, "xü" + "ü" * 200), (62, text(900, 3))]
    want = brute_substrings(rows)
    out = op8_substrings.strip_substrings(docs(rows))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    digests = op8_substrings._applied(docs(rows), op8_substrings._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert {r[0]: tuple(r[1:]) for r in digests.collect()} == want
    # Every key counts as common: all segments are cut further, and a line that many texts hold ends up in many groups.
    line = text(40, 900)[:150]
    rows += [(1000 + i, f"{text(12, 2000 + i)} {line} {text(12, 3000 + i)}") for i in range(60)]
    cut = op8_substrings._applied(docs(rows), op8_substrings._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot=0)
    assert {r[0]: tuple(r[1:]) for r in cut.collect()} == brute_substrings(rows)
    assert got[1] is None and got[2] == "" and got[7] == "" or len(rows[6][1].encode()) < 100
    assert op8_substrings.strip_substrings(docs(rows).limit(0)).count() == 0
    # Rows of one id and text are one document; of one id alone, documents of their own; those without an id come last.
    odd = [(1, "a" * 150), (1, "a" * 150), (1, "c" + "b" * 140), (None, "b" * 150), (None, "d" * 99), (None, None)]
    twice = op8_substrings.strip_substrings(docs(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in twice) == [(0, ""), (0, ""), (0, "d" * 99), (1, "a"), (1, "a"), (1, "cb")]


def test_equal_windows():
    rng = np.random.default_rng(4)
    for size, kinds, length in ((1, 2, 5), (40, 2, 5), (400, 2, 12), (300, 1, 100), (600, 3, 7)):
        data = rng.integers(97, 97 + kinds, size).astype(np.uint8)
        data = np.concatenate([data, data[: size // 2], [255]]).astype(np.uint8)
        kind = op8_substrings.equal_windows(data, length)
        starts = range(len(data) - length)
        by = {}
        for i in starts:
            by.setdefault(bytes(data[i : i + length]), set()).add(int(kind[i]))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def asked_segments(texts):
    """Records for which the exchange of segments asks the text, of documents numbered in order."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["row", "text"])
    sent = pa.Table.from_batches(list(S._cut(op8_substrings.cutter, 1, False)([batch])))
    settled = S._settle(False, S.HOT)(sent)
    return sum(len(S.unpack(r["blob"], *S.ASKED)[0]) for r in settled.to_pylist() if r["kind"] == 2)


def test_segments_asked():
    """Anchors that texts share by chance, without a window, ask for nothing: their number grows with the square of the input."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for shared, wanted in ((40, 0), (60, 0), (100, 50), (130, 50)):
        phrase = noise(shared)
        got = asked_segments([noise(300) + phrase + noise(300) for _ in range(50)])
        assert got == 0 if not wanted else got >= wanted


def test_rows_of_marks():
    """Every shard may send a row to every group of documents, so there are as many groups whatever the table."""
    doc = np.arange(400_000)
    rows = list(S._rows(1, doc, [np.zeros(len(doc), np.int32), np.ones(len(doc), np.int32)]))
    assert len(rows) <= 4096
    assert sorted(x for _, _, blob in rows for x in S.unpack(blob, *S.COVERED)[0].tolist()) == doc.tolist()


def test_splitter_in_bulk(monkeypatch):
    """Segments of common keys are cut many at a time; their time is not spent on each."""
    calls = []
    monkeypatch.setattr(K, "names_of_length", lambda buf, k, f=K.names_of_length: calls.append(1) or f(buf, k))
    line, texts = text(40, 900)[:150].encode(), [text(30, 2000 + i).encode() for i in range(200)]
    data = [t + line + t[::-1] for t in texts]
    key, _, _, doc, pos, n = op8_substrings.cutter(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    calls.clear()
    payloads = [data[d][p : p + m + 99] for d, p, m in zip(doc.tolist(), pos.tolist(), n.tolist(), strict=True)]
    which, _, at, many, _, parts = op8_substrings.splitter(payloads, key, pos, n)
    assert len(calls) == 1
    windows = sorted((w, p + i) for w, p, m in zip(which.tolist(), at.tolist(), many.tolist(), strict=True) for i in range(m))
    assert windows == [(j, p + i) for j, (p, m) in enumerate(zip(pos.tolist(), n.tolist(), strict=True)) for i in range(m)]
    assert all(data[doc[w]][p : p + m + 99] == x for w, p, m, x in zip(which, at, many, parts, strict=True))


def brute_passages(rows, n=13):
    first, split = {}, {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - n + 1):
            first.setdefault(b" ".join(split[d][i : i + n]), d)
    out = {}
    for d, words in split.items():
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if first[b" ".join(words[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
    return out


def test_passages(spark, docs, folder):
    rows = odd_rows() + [(70, "b c " * 200), (71, "x b c " * 70), (72, "b b b c " * 60), (73, "c b b b " * 60), (74, " ".join(["b"] * 40)), (75, " ".join(["b"] * 30))]
    got = {r[0]: tuple(r[1:]) for r in op9_passages.query(spark, folder(documents=docs(rows))).collect()}
    assert got == brute_passages(rows)
    out = op9_passages.strip_passages(docs(rows))
    assert out.columns == docs(rows).columns and {r["kind"] for r in out.collect()} == {"a"}
    assert op9_passages.strip_passages(docs(rows).limit(0)).count() == 0
    shared = text(20, 41)
    odd = [(1, shared), (1, shared), (1, f"x {shared}"), (None, f"{shared} y"), (None, "z"), (2, shared), (None, None)]
    got = op9_passages.strip_passages(docs(odd)).collect()
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
    assert left[:3] == [(0, ""), (0, "y"), (0, "z")] and left[6:] == [(2, "")]
    assert sorted(t for _, t in left[3:6]) in (sorted([shared, shared, "x"]), sorted(["", "", f"x {shared}"]))
    rng = random.Random(9)  # few words, so that anchors meet by chance
    tight = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(5, 120)))) for i in range(60)]
    assert {r[0]: tuple(r[1:]) for r in op9_passages.query(spark, folder(documents=docs(tight))).collect()} == brute_passages(tight)


def test_recompression(spark, docs):
    """Symbols are global numbers: equal ones stand for equal words in every chunk, whatever stands around them."""
    rng = random.Random(3)
    base = [text(200, 50 + i).split() for i in range(4)]
    rows = [(i, " ".join(base[i % 4][rng.randrange(50) :] + text(30, 700 + i).split())) for i in range(24)]
    split = dict((i, t.split()) for i, t in rows)
    df = docs(rows, 6).withColumn("row", F.col("doc_id"))
    count = 5
    table = op9_passages.stored(df.select("row", "text").mapInArrow(op9_passages._tokenise(count), op9_passages._ROWS), "t")
    meaning: dict[int, tuple] = {}
    for level in range(op9_passages.ROUNDS + 1):
        answers = table.where("kind = 1").groupBy("shard").applyInArrow(op9_passages._named(level, count), op9_passages._ROWS)
        states = table.where("kind = 0").groupBy("chunk")
        table = op9_passages.stored(states.cogroup(answers.groupBy("chunk")).applyInArrow(op9_passages._advance(level, count), op9_passages._ROWS), "t")
        if level == op9_passages.ROUNDS:  # windows and what chunks settled alone
            break
        chunks = [op9_passages.Chunk.unpacked(bytes(r["blob"])) for r in table.where("kind = 0").collect()]
        assert len(chunks) > 1
        for chunk in chunks:
            at = 0
            for doc, place, size in zip(chunk.doc.tolist(), chunk.place.tolist(), chunk.size.tolist(), strict=True):
                for i in range(size):
                    symbol = int(chunk.ids[chunk.stream[at + i]])
                    assert symbol == 0 or meaning.setdefault(symbol, (split[doc][place + i],)) == (split[doc][place + i],)
                at += size
            for x, y, number in zip(*(v.tolist() for lv in chunk.levels for v in lv), strict=True) if len(chunk.levels) == 1 else []:
                runs = [(v >> op9_passages.RUN_BITS, v & 0xFFFF) for v in (x, y) if v]
                words = tuple(w for s, n in runs for w in meaning[s] * n)
                assert meaning.setdefault(number, words) == words
    assert len(set(meaning.values())) == len(meaning) and any(len(w) > 1 for w in meaning.values())
    windows = [op9_passages.S.unpack(bytes(r["blob"]), "u8", "u4", "i8", "i4") for r in table.where("kind = 1").collect()]
    assert windows and all(split[d][p : p + 13] in [o[i : i + 13] for e, o in split.items() if e != d for i in range(len(o) - 12)] for w in windows for d, p in list(zip(w[2].tolist(), w[3].tolist(), strict=True))[:3])


def brute_near(rows, n=4, percent=80):
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, docs):
    rng = random.Random(11)
    rows = odd_rows()
    base = text(120, 77).split()
    for i in range(60):  # a family at every distance, so that chains are needed
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        rows.append((1000 + i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_near_duplicates.near_duplicates(docs(rows)).collect()}
    assert got == brute_near(rows)
    five = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_near_duplicates.near_duplicates(docs(rows), size=5).collect()}
    assert five == brute_near(rows, 5)
    assert op10_near_duplicates.near_duplicates(docs(rows).limit(0)).count() == 0
    odd = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "A  b"), (None, "a b"), (None, "e"), (None, "E"), (None, None), (3, "c d")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in op10_near_duplicates.near_duplicates(docs(odd)).collect())
    assert got == [(0, 0, False), (0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_many_languages(spark, docs):
    langs = [f"l{i:02}" for i in range(70)]
    words = {x: ["".join(random.Random(f"{x}{j}").choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(12)] for x in langs}
    rows = [(10 * i + j, " ".join(random.Random(10 * i + j).choices(words[x], k=20)), "s", x) for i, x in enumerate(langs) for j in range(4 if i < 64 else 3)]
    table = docs(rows)
    chosen = op3_language.training_sample(table)
    assert {lang for _, lang in chosen} == set(langs) and len(chosen) == len(rows)
    assert len(op3_language.training_sample(table, 2)) == 2 * len(langs)
    got = {r["doc_id"]: r["lang_pred"] for r in op3_language.identify(table, op3_language.learn(chosen)).collect()}
    assert sum(got[d] == x for d, _, _, x in rows if x in langs[64:]) == 18


def test_language_learns_whole_texts(docs):
    rows = [(i, "same " * 500 + " ".join([late] * 20), "s", lang) for i, (lang, late) in enumerate([("en", "thought"), ("de", "zwischen")] * 10)]
    model = op3_language.learn(op3_language.training_sample(docs(rows)))
    got = {r["doc_id"]: r["lang_pred"] for r in op3_language.identify(docs([(1, "thought thought"), (2, "zwischen zwischen")]), model).collect()}
    assert got == {1: "en", 2: "de"} and {"thought", "zwischen"} <= set(model.lexicon)


def test_quality_of_few_labels(spark, docs):
    rows = [(i, text(60, i)) for i in range(80)] + [(100 + i, " ".join(f"{w.upper()}###" for w in text(60, 500 + i).split())) for i in range(20)]
    for good, bad in ((40, 10), (12, 2), (8, 8)):
        labels = spark.createDataFrame([(i, 1) for i in range(good)] + [(100 + i, 0) for i in range(bad)], "doc_id long, quality int")
        kept = {r["doc_id"] for r in op6_quality.resample(docs(rows), labels).where("kept").collect()}
        assert kept == set(range(80))


def test_quality_of_toxic_labels(spark, docs):
    rude = [(100 + i, " ".join(w if j % 3 else "idiot moron" for j, w in enumerate(text(60, 500 + i).split()))) for i in range(20)]
    rows = [(i, text(60, i)) for i in range(80)] + rude
    labels = spark.createDataFrame([(i, 1, 0 if i % 2 else None) for i in range(40)] + [(100 + i, 1 if i < 9 else None, 1) for i in range(10)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in op6_quality.resample(docs(rows), labels).where("kept").collect()}
    assert kept == set(range(80))
