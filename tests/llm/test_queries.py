"""The registered queries on the small tables: SQL where there is some, brute force elsewhere."""

import base64
import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from compare import assert_equal
from kinfold.llm import _kernel as K
from kinfold.llm import op6_quality, registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(name, spark, oracle):
    assert_equal(registry.queries()[name](spark, SF), oracle("sf0.001"), ORACLE[name])


def rows(oracle, sql):
    return oracle("sf0.001").execute(sql).fetchall()


def tree(text):
    """Fingerprint and distinct leaf prefixes of a text, from the definition: sections after blank lines, paragraphs
    after line ends, leaves of at most 64 code points with the marks that end them."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sections, leaves = [], []
    for section in re.split(r"(?<=\n\n)(?!\n)", text):
        paragraphs = [[sha(m.group()) for m in re.finditer(r"[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+", p)] for p in re.split(r"(?<=\n)(?!\n)", section)]
        digest = sha("".join(sha("".join(p)) for p in paragraphs))
        sections.append((digest, ",".join("".join(x[:8] for x in p) for p in paragraphs)))
        leaves += [x[:8] for p in paragraphs for x in p]
    return sha("".join(d for d, _ in sections)) + "/" + ";".join(f"{d[:16]}:{body}" for d, body in sections), set(leaves)


def likeness(a, b):
    return 1.0 if a[0] == b[0] else 2 * len(a[1] & b[1]) / max(len(a[1]) + len(b[1]), 1)


def test_op1(spark, oracle):
    docs = sorted(rows(oracle, "select doc_id, coalesce(text, '') from documents"), reverse=True)
    got = {r["doc_id"]: r for r in registry.queries()["op1_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    prints = {}
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, own, new, other = got[d], tree(text), tree(edited), tree(after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[0], new[0])
        assert math.isclose(r["near_edited"], likeness(own, new)) and math.isclose(r["near_next"], likeness(own, other), abs_tol=1e-12)
        assert prints.setdefault(r["fingerprint"], text) == text
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
    assert len(set(prints.values())) == len(prints)
    wins = sum(r["near_edited"] > r["near_next"] for r in got.values())
    assert wins > 0.9 * len(got)


def test_op3(spark, oracle):
    truth = dict(rows(oracle, "select doc_id, lang from documents"))
    got = registry.queries()["op3_language"](spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op5(spark, oracle):
    first, want = {}, {}
    for page, html in rows(oracle, "select page_id, coalesce(html, '') from pages order by 1"):
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        f = first.setdefault(digest, page)
        want[page] = (len(data), digest, "response" if f == page else "revisit", None if f == page else f)
    assert {r[0]: tuple(r[1:]) for r in registry.queries()["op5_warc"](spark, SF).collect()} == want


def test_op6(spark, oracle):
    """Weights from the definition, over features counted by their texts; decisions by weight and noise."""
    text = {d: (t or "").encode() for d, t in rows(oracle, "select doc_id, text from documents")}
    labels = rows(oracle, "select doc_id, quality = 1 and coalesce(toxic, 0) <> 1 from labels where quality is not null")
    good = {d: min(g for e, g in labels if e == d) for d in {d for d, _ in labels}}

    @functools.cache
    def word(x):
        return int(K.name(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) % (op6_quality.BUCKETS // 2)

    @functools.cache
    def gram(x):
        return int(K.names_of_length(np.frombuffer(x, np.uint8), 3)[0]) % (op6_quality.BUCKETS // 2)

    found = {d: (Counter(map(word, t.split())), Counter(gram(t[i : i + 3]) for i in range(len(t) - 2))) for d, t in text.items()}
    raw, target = ([sum((found[d][k] for d in found if all_of or good.get(d)), Counter()) for k in (0, 1)] for all_of in (True, False))
    sizes = [(sum(target[k].values()), sum(raw[k].values())) for k in (0, 1)]

    def ratio(k, bucket):
        share = (raw[k][bucket] + 1) / (sizes[k][1] + op6_quality.BUCKETS // 2)
        return math.log((target[k][bucket] + op6_quality.PRIOR * share) / (sizes[k][0] + op6_quality.PRIOR)) - math.log(share)

    got = registry.queries()["op6_quality"](spark, SF).collect()
    assert len(got) == len(text)
    kept = {r["doc_id"]: r["kept"] for r in got}
    for r in got:
        own = found[r["doc_id"]]
        count = max(sum(sum(c.values()) for c in own), 1)
        want = sum(times * ratio(k, b) for k in (0, 1) for b, times in own[k].items()) * (sizes[0][1] + sizes[1][1]) / len(text) / count
        assert math.isclose(r["log_weight"], want, rel_tol=1e-6, abs_tol=1e-6)
    keys = sorted(((r["log_weight"] + r["gumbel"], -r["doc_id"], r["kept"]) for r in got), reverse=True)
    k = sum(kept.values())
    assert 0 < k < len(got) and all(x[2] for x in keys[:k])  # the k greatest keys
    assert sum(kept[d] for d, g in good.items() if g) >= 0.97 * sum(good.values()) and not all(kept[d] for d, g in good.items() if not g)


def test_op7(spark, oracle):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = {d: (t or "").encode().translate(lower).split() + [None] for d, t in rows(oracle, "select doc_id, text from documents")}
    held = {d for d in tokens if zlib.crc32(str(d).encode()) % 7 == 2}
    count = Counter(w for d, t in tokens.items() if d not in held for w in t)
    pairs = Counter(p for d, t in tokens.items() if d not in held for p in zip(t[:-1], t[1:], strict=True))
    n, v = sum(count.values()), len(count)
    one = lambda w: (count[w] + 1) / (n + v + 1)
    got = {r["doc_id"]: r for r in registry.queries()["op7_lm_scoring"](spark, SF).collect()}
    assert set(got) == set(tokens)
    for d, t in tokens.items():
        score = math.log10(one(t[0]))
        for u, w in zip(t[:-1], t[1:], strict=True):
            mass = 100 + 0.5 * count[u]
            score += math.log10((pairs[u, w] + mass * one(w)) / (count[u] + mass))
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d in held, len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10(one(w)) for w in t), rel_tol=1e-9)
        assert abs(r["score"] - score) < 0.0125 * len(t)  # steps of the codes


def brute_substrings(docs, length=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = (b"\0" + bytes(gone)).count(b"\0\1")
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_op8(spark, oracle):
    want = brute_substrings(rows(oracle, "select doc_id, text from documents"))
    assert {r[0]: tuple(r[1:]) for r in registry.queries()["op8_substrings"](spark, SF).collect()} == want
