"""Scores against independent versions of their public definitions, and the queries that have no SQL against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from compare import DATA
from kinfold.functions import similarity as S
from kinfold.operators import fuzzy
from kinfold.plans import detection


def common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(zip(b, row[1:], row, strict=False), lambda left, t: max(left, t[1], t[2] + (t[0] == x)), initial=0))
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a, b):
    """The best ratio of the shorter text with any part of the longer one that is no longer than it."""
    def one(short, long):
        if not short:
            return 0.0 if long else 100.0
        parts = {long[i:j] for i in range(len(long)) for j in range(i + 1, min(len(long), i + len(short)) + 1) if j - i == len(short) or i == 0 or j == len(long)}
        return max((ratio(short, p) for p in parts), default=0.0)

    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(*sorted((a, b), key=len))


def ordered(words):
    return " ".join(sorted(words))


def token_sort_ratio(a, b):
    return ratio(ordered(a.split()), ordered(b.split()))


def token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 100.0
    shared = ordered(x & y)
    texts = [t.strip() for t in (shared, f"{shared} {ordered(x - y)}", f"{shared} {ordered(y - x)}")]
    return max(ratio(p, q) for p, q in itertools.combinations(texts, 2)) if shared else ratio(texts[1], texts[2])


def weighted(a, b):
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if spread <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    tokens = 100.0 if x & y else max(partial_ratio(ordered(a.split()), ordered(b.split())), partial_ratio(ordered(x), ordered(y)))
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * tokens)


SCORES = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "WRatio": weighted}


def test_published_values():
    assert round(S.indel("this is a test", "this is a test!"), 4) == 96.5517
    assert S.partial("this is a test", "this is a test!") == 100
    assert round(S.indel("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), 4) == 90.9091
    assert S.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert round(S.token_sort("fuzzy was a bear", "fuzzy fuzzy was a bear"), 4) == 84.2105
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100


def samples(n=150):
    rng = random.Random(8)
    words = ["red", "ring", "brand", "15", "medium", "zoë", "a", "widget", "gizmo", "12", "economy"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    texts += ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [(rng.choice(texts), rng.choice(texts)) for _ in range(2 * n)] + [("", ""), ("a", ""), (" ", "a")]


@pytest.mark.parametrize("algorithm", sorted(SCORES))
def test_values(spark, algorithm):
    pairs = samples()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", S.SCORERS[algorithm](F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - SCORES[algorithm](a, b)) < 1e-9, (a, b)


@pytest.mark.parametrize("algorithm", ["levenshtein", "ratio", "token_sort_ratio"])
def test_bounds_lose_nothing(spark, algorithm):
    """What length, signature and limit rule out is below the threshold."""
    pairs = samples()
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (50.0, 75.0, 90.0, 100.0):
        x = df.select("a", "b", F.struct(F.length("a").alias("n"), S.signature(F.col("a")).alias("m")).alias("x"), F.struct(F.length("b").alias("n"), S.signature(F.col("b")).alias("m")).alias("y"))
        rows = x.select(S.SCORERS[algorithm](F.col("a"), F.col("b")).alias("full"), S.scored(algorithm, F.col("a"), F.col("b"), threshold).alias("limited"), S.bound(algorithm, "x", "y", threshold).alias("kept")).collect()
        for r in rows:
            assert r["full"] < threshold or (r["kept"] and r["limited"] == r["full"])
            assert r["limited"] in (r["full"], 0.0)


@pytest.mark.parametrize("algorithm", ["ratio", "token_sort_ratio", "token_set_ratio", "WRatio"])
def test_queries(spark, algorithm):
    """fuzzy_groups_*: groups, sizes and mean scores against all pairs under the independent scores."""
    keys = {r["record_id"]: r["key"] for r in detection._keys(spark, f"{DATA}/sf0.001").collect() if r["key"]}
    first = {}
    for i in sorted(keys):
        first.setdefault(keys[i], []).append(i)
    kinds = sorted(first)
    n = sum(1 for _ in keys)
    block = {k: "all" if n * (n - 1) // 2 <= 100_000 else (k[:2], len(k) // 10) for k in kinds}
    links = {}
    for a, b in itertools.combinations(kinds, 2):
        if block[a] == block[b] and (s := SCORES[algorithm](a, b)) >= 97:
            links[a, b] = s
    root = {k: k for k in kinds}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        root[find(a)] = find(b)
    want, groups = {}, {}
    for k in kinds:
        groups.setdefault(find(k), []).append(k)
    for members in groups.values():
        ids = [i for k in members for i in first[k]]
        if len(ids) > 1:
            own = [(len(first[a]) * len(first[b]), s) for (a, b), s in links.items() if find(a) == find(members[0])]
            inner = sum(len(first[k]) * (len(first[k]) - 1) // 2 for k in members)
            want[min(ids)] = (len(ids), (sum(c * s for c, s in own) + 100.0 * inner) / (sum(c for c, _ in own) + inner))
    got = {r["group_id"]: (r["group_size"], r["similarity_score"]) for r in detection._scored(algorithm, 97.0)(spark, f"{DATA}/sf0.001").collect()}
    assert set(got) == set(want)
    assert all(got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 0.0501 for g in want)


def test_blocking(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "xbc"), (3, "abd")], "record_id long, key string")
    assert {r["block"] for r in fuzzy.blocked(df).collect()} == {r["block"] for r in fuzzy.blocked(df, 0, "all").collect()} == {"all"}
    assert {r["block"] for r in fuzzy.blocked(df, blocking="prefix").collect()} == {"ab_0", "xb_0"}
