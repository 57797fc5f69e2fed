"""Substring dedup by bounded interval expansion on a Burrows-Wheeler transform.

Windows of `length` bytes are brought together by content (see _segments.py: the anchor of a window is the leftmost
smallest of its substrings of ANCHOR bytes). The texts that share an anchor form one string with a separator after
each; from its suffix order comes the Burrows-Wheeler transform, and common prefixes follow from it by breadth-first
backward extension: level by level, every interval of suffixes that begin with a string is extended to the left by
each symbol found in it, and the end of a new interval at which no value stands yet gets the level as its common
prefix length. So the lengths come in increasing order, and the expansion stops at `length`: places that then have no
value share at least that many bytes, and what lies between two values is a set of equal windows. Its earliest member
(smaller document, then smaller place) stays, the others' bytes go.

Suffixes need to be in order only by their first `length` symbols, so sorting doubles a few times and stops.

Defined cases: null and short texts have no window and lose nothing; very long texts are cut whole, in one task each;
repeats within a document count; rows that share a doc_id are documents of their own, in the order of digests of their
texts, and rows without an id come after all others; rows that agree in both id and text are one document, and each gets
its result; an empty table gives an empty result; columns other than those named here are not read. Work is on bytes: what is kept may cut a code point; strip_substrings() then
widens each cut to whole code points, keeping the partly covered ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm import _segments as S
from kinfold.llm._base import numbered, table

NAME = "op8_substrings"
LENGTH = 100
ANCHOR = 32
SEPARATOR = 255  # no byte of UTF-8
#: A window with x of its bytes before the anchor has LENGTH - ANCHOR - x after it: one of both has so many at least.
SIDE = (LENGTH - ANCHOR) // 2
#: Bytes of one string, but for the texts of one anchor, which stay together; its arrays of numbers fit a core's cache.
STRING_BYTES = 1 << 17


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first `depth` symbols (more, up to a power of two times 8); those that
    agree in them in any order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    reach = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        if reach >= depth or new[1:].all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
        further = np.zeros(n, np.uint64)
        if reach < n:
            further[: n - reach] = rank[reach:]
        key = (rank << np.uint64(32)) | further
        reach *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in the order; `length` where it is that or more."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    symbol = text[before].astype(np.int64)  # the transform
    symbol[order == 0] = 256  # nothing stands before the first suffix
    back = place[before]  # where the suffix that is one symbol longer stands
    values = np.full(n + 1, length, np.int32)
    values[0] = values[n] = 0
    low, high = np.array([0]), np.array([n])
    for level in range(length):
        # The interval's suffixes by symbol; the extensions of those of one symbol stand together.
        which = np.repeat(np.arange(len(low)), high - low)
        at = K.spread(low, high - low)
        kind = which * 257 + symbol[at]
        if level == 0 or len(kind) > len(low):
            by = np.argsort(kind)
            kind, at = kind[by], at[by]
        inside = symbol[at] < 256
        kind, to = kind[inside], back[at[inside]]
        if not len(to):
            break
        begins = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        low, high = np.minimum.reduceat(to, begins), np.maximum.reduceat(to, begins) + 1
        fresh = values[high] == length
        low, high = low[fresh], high[fresh]
        values[high] = level
        if not len(low):
            break
    return values[:n]


def equal_windows(text: np.ndarray, length: int) -> np.ndarray:
    """A number for every start: equal for starts whose `length` symbols are equal."""
    order = suffix_order(text, length)
    values = common_prefixes(text, order, length)
    out = np.empty(len(text), np.int64)
    out[order] = np.cumsum(values < length)
    return out


def cutter(buf: np.ndarray, offsets: np.ndarray):
    if len(buf) < LENGTH:
        return (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),) * 3
    names = K.names_of_length(buf, ANCHOR)
    doc, start, n, place = S.anchored(names, offsets, LENGTH - ANCHOR + 1, LENGTH)
    size = n + LENGTH - 1
    content = K.mix((place - start).astype(np.uint64) * K.BASE + size.astype(np.uint64))
    # Names of ANCHOR bytes at places that cover a segment, which has 2 * LENGTH - ANCHOR bytes at most.
    for at in (0, ANCHOR, 2 * ANCHOR, np.minimum(3 * ANCHOR, size - ANCHOR), size - 2 * ANCHOR, size - ANCHOR):
        content = K.mix((content ^ names[start + at]) * K.BASE)
    return names[place], content, _sides(names, start, place, size), doc, start - offsets[doc], n


def _sides(names: np.ndarray, start: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of the SIDE bytes before the anchor and of those after it (0 where the segment has fewer), 32 bits each."""
    out = np.zeros(len(place), np.uint64)
    for far, near, has, shift in ((-SIDE, -ANCHOR, place - start >= SIDE, 32), (SIDE, ANCHOR, start + size - place - ANCHOR >= SIDE, 0)):
        at = place[has]
        # After the anchor, the last ANCHOR bytes of the side begin SIDE bytes behind the anchor's start.
        out[has] |= ((K.mix(names[at + far] * K.BASE + names[at + near]) >> np.uint64(32)) | np.uint64(1)) << np.uint64(shift)
    return out


def reader(data: bytes, pos: np.ndarray, n: np.ndarray) -> list[bytes]:
    return [data[p : p + k + LENGTH - 1] for p, k in zip(pos.tolist(), n.tolist(), strict=True)]


def _classes() -> list[tuple[int, int]]:
    """Ranges of an anchor's place within its window, so that within a range the bytes before and after the anchor that
    all its windows have are at least half of those that any has."""
    out: list[tuple[int, int]] = []
    for place in range(LENGTH - ANCHOR + 1):
        kind = place.bit_length(), (LENGTH - ANCHOR - place).bit_length()
        if out and kind == last:
            out[-1] = out[-1][0], place
        else:
            out.append((place, place))
        last = kind
    return out


CLASSES = _classes()


def splitter(payloads: list[bytes], key: np.ndarray, pos: np.ndarray, n: np.ndarray):
    """Parts of segments by CLASSES: arrays (segment, key, pos, n, content) and bytes. The key of a part names the anchor
    and the bytes beside it that its windows share."""
    sizes = n + LENGTH - 1
    base = np.cumsum(sizes) - sizes
    data = b"".join(payloads)
    buf = np.frombuffer(data, np.uint8)
    # All windows hold the anchor, and it is the leftmost place of its bytes that they all hold.
    tries = LENGTH - ANCHOR + 2 - n
    at, own = K.spread(base + n - 1, tries), np.repeat(np.arange(len(n)), tries)
    hit = np.flatnonzero(K.names_of_length(buf, ANCHOR)[at] == key[own])
    anchor = at[hit[np.unique(own[hit], return_index=True)[1]]]
    ahead = anchor - base
    low, high = (np.array([c[i] for c in CLASSES])[:, None] for i in (0, 1))
    a, b = np.maximum(low, ahead - n + 1), np.minimum(high, ahead)
    kind, which = np.nonzero(a <= b)
    a, b, low, high, anchor = a[kind, which], b[kind, which], low[kind, 0], high[kind, 0], anchor[which]
    name = K.name(buf, anchor - low, anchor + LENGTH - high, 1 + low)
    start, end = anchor - b, anchor - a + LENGTH
    parts = [data[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    return which, name, pos[which] + start - base[which], b - a + 1, K.name(buf, start, end), parts


def comparer(key, doc, pos, n, payloads):
    out = []
    if len(key):
        order = np.lexsort((pos, doc, key))
        sizes = np.cumsum([len(payloads[i]) + 1 for i in order])
        lead = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])).tolist() + [len(order)]
        a = 0
        while a < len(cuts) - 1:
            base, b = (sizes[cuts[a] - 1] if cuts[a] else 0), a + 1
            while b < len(cuts) - 1 and sizes[cuts[b + 1] - 1] - base <= STRING_BYTES:
                b += 1
            out.append(_compare(order[cuts[a] : cuts[b]], doc, pos, n, payloads))
            a = b
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _compare(rows, doc, pos, n, payloads):
    text = np.frombuffer(b"".join(payloads[i] + b"\xff" for i in rows.tolist()), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(payloads[i]) + 1 for i in rows.tolist()])[:-1]])
    count = n[rows].astype(np.int64)
    starts = K.spread(at, count)
    docs, places = np.repeat(doc[rows], count), K.spread(pos[rows].astype(np.int64), count)
    kind = equal_windows(text, LENGTH)[starts]
    order = np.lexsort((places, docs, kind))
    docs, places, kind = docs[order], places[order], kind[order]
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    lead = np.repeat(starts, np.diff(np.append(starts, len(kind))))
    late = (docs != docs[lead]) | (places != places[lead])
    docs, places = docs[late], places[late]
    if not len(docs):
        return (np.empty(0, np.int64),) * 3
    order = np.lexsort((places, docs))  # runs of windows
    docs, places = docs[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + 1)]))
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], places[first], places[last] - places[first] + 1


def _covered(count: int, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal covered runs."""
    edge = np.zeros(count + 1, np.int32)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + n + LENGTH - 1, -1)
    flag = np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]]))
    return np.flatnonzero(flag == 1), np.flatnonzero(flag == -1)


def _left(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))


def _digest(batch: pa.RecordBatch, found):
    texts, rows = batch.column("text"), []
    for i, (_, pos, n) in enumerate(found):
        data = (texts[i].as_py() or "").encode()
        starts, ends = _covered(len(data), pos, n) if len(pos) else (np.empty(0, int),) * 2
        rows.append((len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(_left(data, starts, ends)).hexdigest()))
    columns = [pa.array([r[k] for r in rows], pa.string() if k == 3 else pa.int64()) for k in range(4)]
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _strip(batch: pa.RecordBatch, found):
    texts, out = batch.column("text"), []
    for i, (_, pos, n) in enumerate(found):
        text = texts[i].as_py()
        if text and len(pos):
            data = text.encode()
            starts, ends = _covered(len(data), pos, n)
            tail = lambda k: k < len(data) and data[k] & 0xC0 == 0x80  # noqa: E731  not the first byte of a code point
            spans = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                while tail(a):
                    a += 1
                while tail(b):
                    b -= 1
                spans.append((a, max(a, b)))
            text = _left(data, np.array([s[0] for s in spans]), np.array([s[1] for s in spans])).decode()
        out.append(text)
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def strip_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without bytes covered by a window of LENGTH bytes that also starts earlier."""
    return _applied(docs, _strip, "doc_id long, text string")


def _applied(docs: DataFrame, handle, schema: str, hot: int = S.HOT) -> DataFrame:
    docs, _ = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    marks = S.covered_windows(docs, cutter, reader, splitter, comparer, across=False, hot=hot)
    return S.with_marks(docs, marks, handle, S.COVERED, schema, ("doc_id",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(table(spark, sf_dir, "documents"), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Bytes are pairs of hex digits here.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS i, x FROM d WHERE length(x) >= 200),
h AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS m FROM w),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
g AS (SELECT doc_id, i, i - 100 - max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM c),
s AS (SELECT doc_id, i, sum((gap IS NULL OR gap > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY 1, 2),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM r UNION ALL SELECT doc_id, -1, 0, min(a) FROM r GROUP BY 1),
t AS (SELECT doc_id, string_agg(substr(x, 2 * b + 1, 2 * (coalesce(next, length(x) // 2) - b)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM r GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
