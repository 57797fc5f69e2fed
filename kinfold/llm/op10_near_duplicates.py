"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

Circulant MinHash: a first permutation places every shingle on a circle of 2**32 places, a second one ranks the
places; coordinate k of a signature is the lowest rank after the circle is shifted by k steps. So two permutations
give all coordinates. Bands of coordinates name the buckets in which candidates meet.

Documents with equal shingle sets are one class (a link of similarity 1 needs no search); candidates are sought
between classes. Within a bucket no pairs are listed: first every member is compared with the bucket's smallest one
(a star), verified on the full sets, and components are taken. Buckets that still hold several components are joined
into families; a family is dealt in cells of two of its parts to tasks, which compare members of different components
there: a pair whose signatures agree in fewer coordinates than a linked pair's would (by six standard deviations) is
passed over, the others are verified on the full sets until they are joined. Tasks return only links that join
components, at most one a member, so nothing is listed by pairs; pairs whose set sizes alone rule out the similarity
are dropped before. Links are confirmed on whole shingle sets, made again from the whole texts.

With 32 bands of 4 coordinates a pair of similarity 0.8 shares no bucket with probability (1 - 0.8**4)**32 < 5e-8.

Defined cases: null or wordless texts have no shingles, are linked with nothing and are kept; texts of fewer words
than a shingle have one shingle, the whole sequence; very long texts are compared whole. Every row has a row in the
result: rows that share a doc_id are documents of their own in the order of digests of their texts, rows without an id
come after all others and are linked like them; rows that agree in both id and text are one document, and each gets its
result. A component is known by its first document's id, and only that document is kept. An empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm._base import numbered, stored, table
from kinfold.operators.components import components as linked_components

NAME = "op10_near_duplicates"
WORDS, PERCENT = 4, 80
BANDS, BAND = 32, 4
_STEP = 0x9E3779B1  # the circle is shifted by multiples of this odd number


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first document, sorted distinct shingle names of each document) for blocks of documents."""
    for at, buf, offsets in K.blocks(column):
        buf = K.lowered(buf)
        start, end, bounds = K.words(buf, offsets)
        word = K.name(buf, start, end)
        run = K.runs_of(word, size)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                sets.append(np.unique(run[a : b - size + 1]))
            else:
                sets.append(K.runs_of(word[a:b], b - a) if b > a else np.empty(0, np.uint64))
        yield at, sets


def _rank(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), coordinates), np.uint32)
    at = 0
    while at < len(sets):  # in slices that stay in the cache
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15, "right")))
        place = np.concatenate(sets[at:to])
        place = _rank((place >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0xA511E9B3))
        firsts = np.concatenate([[0], np.cumsum(sizes[at:to])[:-1]])
        for k in range(coordinates):
            out[at:to, k] = np.minimum.reduceat(_rank(place + np.uint32(k * _STEP & 0xFFFFFFFF)), firsts)
        at = to
    return out


def _sketch(size: int):
    """row, text -> row, n_shingles, set_hi, set_lo (the set's name)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, sets in shingle_sets(batch.column(1), size):
                n = np.array([len(s) for s in sets], np.int64)
                hi = np.array([int(np.bitwise_xor.reduce(K.mix(s))) if len(s) else 0 for s in sets], np.uint64)
                lo = np.array([int(np.add.reduce(K.mix(s + np.uint64(1)), dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array(n), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["row", "n_shingles", "set_hi", "set_lo"])

    return run


def _bands(size: int, bands: int, band: int):
    """row, text of non-empty documents -> a row per document: row, bands (bucket names)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, sets in shingle_sets(batch.column(1), size):
                full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                if not len(full):
                    continue
                got = signatures([sets[i] for i in full], bands * band)
                names = np.empty((len(full), bands), np.uint64)
                for b in range(bands):
                    names[:, b] = K.runs_of(np.zeros(1, np.uint64), 1)[0] + np.uint64(b)
                    for k in range(band):
                        names[:, b] = K.mix(names[:, b] * K.BASE + got[:, b * band + k])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, names.size + 1, bands, dtype=np.int32)), pa.array(names.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)).take(pa.array(full)), lists], ["row", "bands"])

    return run


def _compare(size: int, percent: int):
    """Sorted rows (center, part, member, text; member null for the center's own text) -> the confirmed links."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            centers, parts, members = (batch.column(i).to_pylist() for i in range(3))
            a, b = [], []
            for at, sets in shingle_sets(batch.column(3), size):
                for i, s in enumerate(sets, at):
                    if members[i] is None:
                        key, own = (centers[i], parts[i]), s
                    elif key == (centers[i], parts[i]):
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(s) - both):
                            a.append(centers[i])
                            b.append(members[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


#: Members of one center that one task compares; more are dealt to several, each with the center's text.
PART = 256


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts (row, text) are linked. Every text is sent once to each center it meets; a
    center's own text goes once to each part of its members."""
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PART)).cast("int")
    # Stored, as other sides of joins that are sums by the join's key: so both sides are plain exchanges, and adaptive
    # execution can split the partition of a common key.
    counts = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "center-sizes")
    dealt = pairs.join(counts, "a").select(F.col("a").alias("center"), part.alias("part"), F.col("b").alias("member"))
    wanted = dealt.withColumn("row", F.col("member")).unionByName(dealt.select("center", "part").distinct().withColumn("member", F.lit(None).cast("bigint")).withColumn("row", F.col("center")))
    rows = wanted.join(texts, "row").select("center", "part", "member", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "center", "part").sortWithinPartitions("center", "part", F.col("member").asc_nulls_first())
    return rows.mapInArrow(_compare(size, percent), "a long, b long")


def _cells(size: int, percent: int, coordinates: int):
    """Sorted rows (family, i, j, part, row, component, text): parts i and j of a family -> links (a, b) that join
    different components."""
    share = percent / 100.0
    least = share * coordinates - 6.0 * (share * (1 - share) * coordinates) ** 0.5

    def joined(rows: list[tuple]) -> list[tuple[int, int]]:
        part, ids, comp = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sets = [r[3] for r in rows]
        sizes = np.array([len(x) for x in sets])
        if comp.min() == comp.max():
            return []
        sketch = signatures(sets, coordinates)
        low, high = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        a, b, agree = [], [], []
        for at in range(0, len(low), 32):
            x = low[at : at + 32]
            same = (sketch[x][:, None, :] == sketch[high][None]).sum(2)
            fits = 100 * np.minimum(sizes[x][:, None], sizes[high]) >= percent * np.maximum(sizes[x][:, None], sizes[high])
            p, q = np.nonzero((same >= least) & fits & (comp[x][:, None] != comp[high]))
            a.append(x[p])
            b.append(high[q])
            agree.append(same[p, q])
        a, b, agree = np.concatenate(a), np.concatenate(b), np.concatenate(agree)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for k in np.argsort(-agree, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            u, v = find(int(comp[x])), find(int(comp[y]))
            if u != v:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    root[max(u, v)] = min(u, v)
                    links.append((int(ids[x]), int(ids[y])))
        return links

    def run(batches):
        cell, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            part, ids, comp = (batch.column(i).to_pylist() for i in range(3, 6))
            links = []
            for at, sets in shingle_sets(batch.column(6), size):
                for i, s in enumerate(sets, at):
                    if keys[i] != cell:
                        links += joined(held) if held else []
                        cell, held = keys[i], []
                    held.append((part[i], ids[i], comp[i], s))
            yield _links(links)
        yield _links(joined(held) if held else [])

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


#: Members of one part of a family.
FAMILY_PART = 512


def joining(split: DataFrame, texts: DataFrame, size: int, percent: int, coordinates: int) -> DataFrame:
    """Links that join components among the members of split(bucket, row, component), buckets of several components."""
    heads = stored(split.groupBy("bucket").agg(F.min("row").alias("a")), "split-heads")
    met = stored(split.join(heads, "bucket").where("a != row").select("a", F.col("row").alias("b")).distinct(), "met")
    # A member stands for its smallest head from here on, so that few different links are left to spread labels along.
    firsts = stored(met.groupBy("b").agg(F.min("a").alias("first")), "firsts")
    short = met.join(firsts, "b").join(firsts.select(F.col("b").alias("a"), F.col("first").alias("of")), "a", "left")
    short = short.select(F.coalesce("of", "a").alias("a"), F.col("first").alias("b")).where("a != b").distinct()
    heard = split.select("row").distinct().join(firsts.withColumnRenamed("b", "row"), "row", "left").select("row", F.coalesce("first", "row").alias("id"))
    families = heard.join(linked_components(short), "id", "left").select("row", F.coalesce("component", "id").alias("family"))
    own = stored(split.select("row", "component").distinct().join(families, "row"), "families")
    parts = stored(own.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY_PART).cast("int").alias("k")), "family-parts")
    own = own.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("row"), F.col("k")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "row", "component")
    rows = cells.join(texts, "row").select("family", "i", "j", "part", "row", "component", "text")
    n = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return rows.mapInArrow(_cells(size, percent, coordinates), "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(id), links(a, b) -> (id, component): the smallest id that can be reached."""
    return nodes.join(linked_components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, bands: int = BANDS, band: int = BAND) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept and `row`, the document's number; a row per row."""
    docs, own = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    ids, docs = docs.select("row", "doc_id"), docs.select("row", "text")
    sketch = stored(docs.mapInArrow(_sketch(size), "row long, n_shingles long, set_hi long, set_lo long"), "sketches")
    full = sketch.where("n_shingles > 0")
    classes = stored(full.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("row").alias("id")), "classes")
    texts = docs.join(classes.select(F.col("id").alias("row")), "row").select("row", "text")
    banded = docs.mapInArrow(_bands(size, bands, band), "row long, bands array<long>").select("row", F.explode("bands").alias("bucket")).distinct()
    buckets = stored(banded.join(classes.select(F.col("id").alias("row"), F.col("n_shingles").alias("n")), "row"), "buckets")
    heads = stored(buckets.groupBy("bucket").agg(F.min(F.struct("row", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"), "heads")
    met = stored(buckets.join(heads, "bucket").select("bucket", "row", "n", "head", "members"), "met")
    fits = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    star = stored(met.where("row != head.row").select(F.col("head.row").alias("a"), F.col("row").alias("b"), "n", F.col("head.n").alias("m")).where(fits).select("a", "b").distinct(), "star")
    links = stored(confirmed(star, texts, size, percent), "star-links")
    nodes = classes.select("id")
    labels = stored(components(nodes, links), "components")
    placed = met.select("bucket", "row").join(labels.withColumnRenamed("id", "row"), "row")
    several = stored(placed.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d").select("bucket"), "several")
    split = stored(placed.join(several, "bucket").select("bucket", "row", "component"), "split")
    links = links.unionByName(stored(joining(split, texts, size, percent, bands * band), "joining-links"))
    labels = components(nodes, links).withColumnRenamed("id", "class_id")
    member = full.join(classes.select("set_hi", "set_lo", "n_shingles", F.col("id").alias("class_id")), ["set_hi", "set_lo", "n_shingles"]).join(labels, "class_id")
    rows = sketch.select("row", "n_shingles").distinct().join(member.select("row", "component").distinct(), "row", "left").select("row", "n_shingles", F.coalesce("component", "row").alias("component"))
    if own:
        out = rows.select(F.col("row").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "row", "component")
    else:
        first = ids.distinct().select(F.col("row").alias("component"), F.col("doc_id").alias("component_id"))
        out = ids.join(rows.join(first, "component"), "row")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("row") == F.col("component")).alias("kept"), "row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN r USING (g) JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT k.id, t.b FROM k JOIN t ON t.a = k.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS c FROM k GROUP BY 1) m ON m.id = d.doc_id
"""
