"""Quality classifier by importance resampling of hashed n-grams.

Two generative models over hashed features (words, and byte n-grams, which see spelling, markup and case) are counted
over all documents: the target model over those labelled good, the raw model over every document. A document's
importance weight is the log ratio of its probability under the two, the sum over its features, normalised for its
length: that of a document of the mean number of features that has the same mix of them (normalise=False leaves the sum
as it is). A sample without replacement in proportion to the weights takes the k greatest of weight + Gumbel noise
(seeded by doc_id). k is the number of documents whose weight is above a cut: the one that leaves the fewest labelled
documents on the wrong side, in the middle of the gap between the weights next to it. There a good document has the
weight it would have without its own label, as the others have.

The counts are vectors of fixed size, summed by blocks of buckets; the k-th greatest key is found by counting ever finer
bins of the keys, so neither is any list sent to the driver nor anything sorted as a whole; ties at the cut go by doc_id.

Defined cases: documents without text have no features: weight 0, and they are ranked like others; labels of null count
as no label, one of a toxic document is not good whatever its quality, a document with several labels is good only if all
are; without any good label, or any other, nothing is told apart and all are kept; repeated rows are rows of their own,
and those without an id have no label; very long texts count whole; empty documents give an empty result; columns other
than those named here are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm._base import broadcast_if_small, stored, table

NAME = "op6_quality"
ORACLE_SQL = None
BUCKETS = 1 << 16
#: Buckets of one row of counts.
SLICE = 1 << 12
GRAM = 3
SEED = 0
#: Features of weight with which the raw share of a bucket smooths the target's.
PRIOR = 20.0
#: Bins of weights between which the cut can be.
BINS = 1 << 14


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of all words and byte n-grams of a block."""
    start, end, bounds = K.words(buf, offsets)
    words = K.name(buf, start, end)
    count = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    grams = K.names_of_length(buf, GRAM)[K.spread(offsets[:-1], count)] if count.sum() else np.empty(0, np.uint64)
    docs = np.concatenate([np.repeat(np.arange(len(count)), np.diff(bounds)), np.repeat(np.arange(len(count)), count)])
    # Words have the lower half of the buckets, n-grams the upper one.
    half = np.uint64(buckets // 2)
    return np.concatenate([words % half, grams % half + half]).astype(np.int64), docs


def _count(buckets: int):
    """text, good -> a row per slice of buckets: target counts, raw counts."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for at, buf, offsets in K.blocks(batch.column(0)):
                bucket, doc = features(buf, offsets, buckets)
                total[1] += np.bincount(bucket, minlength=buckets)
                total[0] += np.bincount(bucket[good[at + doc]], minlength=buckets)
        for i in range(0, buckets, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([total[:, i : i + SLICE].tobytes()], pa.binary())], ["slice", "counts"])

    return run


def _add(buckets: int):
    width = min(SLICE, buckets)

    def run(one: pa.Table) -> pa.Table:
        total = np.zeros(2 * width, np.int64)
        for blob in one.column("counts").to_pylist():
            total += np.frombuffer(blob, np.int64)
        return pa.table({"slice": one.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """(target, raw) counts of each bucket, from docs(text, good). The result has a fixed size."""
    parts = docs.select("text", "good").mapInArrow(_count(buckets), "slice int, counts binary")
    summed = parts.groupBy("slice").applyInArrow(_add(buckets), "slice int, counts binary").collect()
    counts = np.zeros((2, buckets), np.float64)
    for row in summed:
        counts[:, row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64).reshape(2, -1)
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray, size: np.ndarray | float, total: np.ndarray | float, width: int) -> np.ndarray:
    """Log of target over raw probability of buckets of one half, given their counts, those of the half and its width."""
    share = (raw + 1) / (total + width)
    return np.log((target + PRIOR * share) / (size + PRIOR)) - np.log(share)


def _weigh(counts: np.ndarray, buckets: int, length: float | None):
    half = buckets // 2
    sizes = counts.reshape(2, 2, half).sum(2)  # (target, raw) of words and of n-grams
    ratios = np.concatenate([log_ratios(*counts[:, i * half : (i + 1) * half], *sizes[:, i], half) if sizes[:, i].all() else np.zeros(half) for i in (0, 1)])

    def run(batches):
        for batch in batches:
            ids, labels, row = batch.column(0), batch.column(2), batch.column(3)
            good = labels.fill_null(False).to_numpy(zero_copy_only=False)
            for at, buf, offsets in K.blocks(batch.column(1)):
                bucket, doc = features(buf, offsets, buckets)
                n = len(offsets) - 1
                scale = length / np.maximum(np.bincount(doc, minlength=n), 1) if length else 1.0
                weight = np.bincount(doc, ratios[bucket], n)
                # Good documents without their own features in the target.
                mine = good[at + doc]
                kinds, times = np.unique(doc[mine] * buckets + bucket[mine], return_counts=True)
                b, d = kinds % buckets, kinds // buckets
                side = b // half
                own = np.bincount(2 * d + side, times, 2 * n)
                left = sizes[0, side] - own[2 * d + side]
                alone = np.bincount(d, times * log_ratios(counts[0, b] - times, counts[1, b], left, sizes[1, side], half), n)
                fair = np.where(good[at : at + n], alone, weight)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(scale * weight), labels.slice(at, n), pa.array(scale * fair), row.slice(at, n)], ["doc_id", "log_weight", "good", "fair", "row"])

    return run


def best_cut(weighed: DataFrame, bins: int = BINS) -> float | None:
    """The cut of `fair` that leaves the fewest rows of weighed(fair, good) on the wrong side, of several the one in the
    widest gap; None if all stay. The rows are counted in bins, so the driver gets a bounded number of them."""
    labelled = weighed.where("good is not null")
    low, high = labelled.agg(F.min("fair"), F.max("fair")).first()
    if low is None:
        return None
    # Weights of long documents are large; bins of their inverse hyperbolic sine are fine near 0, whatever the longest.
    low, high = math.asinh(low), math.asinh(high)
    spot = F.least(F.greatest(F.floor((F.asinh("fair") - F.lit(low)) / F.lit(max((high - low) / bins, 1e-9))), F.lit(0)), F.lit(bins - 1))
    rows = sorted(labelled.groupBy(spot.alias("bin")).agg(F.count_if("good"), F.count_if(~F.col("good")), F.min("fair"), F.max("fair")).collect())
    good, bad = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    if not good.sum() or not bad.sum():
        return None
    wrong = np.cumsum(good) - good + bad[::-1].cumsum()[::-1]  # with the cut below each bin
    gaps = [0.0, *(b[3] - a[4] for a, b in zip(rows[:-1], rows[1:], strict=True))]
    i = min(range(len(rows)), key=lambda i: (wrong[i], -gaps[i]))
    return None if i == 0 else (rows[i - 1][4] + rows[i][3]) / 2


def kth_greatest(keys: DataFrame, k: int, column: str, bins: int = 4096) -> tuple[float, int]:
    """(value, how many rows of that value belong to the k greatest) by counting finer and finer bins."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    left = k
    while True:
        width = (high - low) / bins
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        if width <= 0 or low + width <= low or high - width >= high:
            values = inside.groupBy(column).count().orderBy(F.col(column).desc()).limit(bins).collect()
            for value, n in values:
                if n >= left:
                    return value, left
                left -= n
            return low, left
        spot = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        rows = sorted(inside.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect(), reverse=True)
        for _, n, a, b in rows:
            if n >= left:
                low, high, total = a, b, n
                break
            left -= n
        if low == high:
            return low, left
        if total <= bins:
            values = sorted((r[0] for r in keys.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            value = values[left - 1]
            return value, left - sum(v > value for v in values)


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, buckets: int = BUCKETS, normalise: bool = True, row: str | None = None) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality[, toxic]) -> doc_id, log_weight, gumbel, kept; a row per document.
    row: a column of docs with whole numbers that the result keeps, as `row`."""
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good &= F.coalesce("toxic", F.lit(0)) != 1
    marks = labels.select("doc_id", good.alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"))
    # Small tables of labels go to every task; larger ones meet the documents in a shuffle.
    joined = docs.join(broadcast_if_small(marks, 1_000_000), "doc_id", "left")
    counts = bucket_counts(joined, buckets)
    length = counts[1].sum() / max(docs.count(), 1) if normalise else None
    weights = joined.select("doc_id", "text", "good", "row").mapInArrow(_weigh(counts, buckets, length), "doc_id long, log_weight double, good boolean, fair double, row long")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = weights.withColumn("gumbel", -F.log(-F.log(uniform))).withColumn("key", F.col("log_weight") + F.col("gumbel"))
    keyed = stored(keyed, "keys")
    columns = ["doc_id", "log_weight", "gumbel"] + ["row"] * bool(row)
    cut = best_cut(keyed)
    n = keyed.count()
    k = n if cut is None else keyed.where(F.col("log_weight") > cut).count()
    if k >= n or k == 0:
        return keyed.select(*columns, F.lit(True).alias("kept"))
    value, ties = kth_greatest(keyed, k, "key")
    tied = keyed.where(F.col("key") == value).orderBy(F.col("doc_id").asc_nulls_last()).limit(ties).agg(F.max("doc_id")).first()[0]
    kept = (F.col("key") > value) | ((F.col("key") == value) & (F.coalesce("doc_id", F.lit((1 << 63) - 1)) <= F.lit(tied if tied is not None else (1 << 63) - 1)))
    return keyed.select(*columns, kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
