"""Windows of fixed length that occur elsewhere, found through anchored segments.

Every window of a text (100 bytes, 13 words) picks an anchor inside itself by a rule that looks at nothing but the
window's own content, so equal windows pick equal anchors. Windows that follow each other and share an anchor form a
segment, known by the anchor's name (its key) and the name of its whole content. Equal windows lie in segments of
equal key, so all questions are answered key by key:

1. `cut` (map): segments of whole texts. Equal segments of one chunk are settled at once: only the first of them can
   be a first occurrence, so one record a chunk and content is sent, whatever the number of copies.
2. `settle` (by key): contents met again are settled in the same way. Keys with one content end here; where a key
   has several contents, the first segment of each asks for its text, if another content may share a window with it:
   equal windows hold half of their other units at least on one side of the anchor, so the names of these two sides
   tell (anchors of unrelated texts meet by chance, in numbers that grow with the square of the input). Where more than
   HOT contents of a key ask (a line that many texts hold, each in a context of its own), their segments are cut
   further, by bytes beside the anchor.
3. `fetch` (by document): the asked texts.
4. `compare` (by key): the operator's own method finds the windows that these contents share.
5. `apply` (by document): covered parts go.

Contents are equal if the names of both anchor and content are, 128 bits together. Records travel as packed arrays in
few rows. A document is a row, known by the number that _base.numbered() gives it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm._base import partitions, shards, stored

POSITION_BITS = 28
_MASK = np.uint64((1 << POSITION_BITS) - 1)
CHUNK = 1 << 20
#: Groups of documents (the remainder of their number; prime, so that regular ids spread) that share rows of packed
#: marks. Fixed, as the shards grow with the input: every shard may send a row to every group.
GROUPS = 2039
MARK = "g long, kind int, blob binary"


def pack(*columns: np.ndarray) -> bytes:
    """Names first (they don't compress), then the other columns, as differences, compressed."""
    n = len(columns[0])
    raw = b"".join(c.tobytes() for c in columns if c.dtype == np.uint64)
    rest = b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns if c.dtype != np.uint64)
    return n.to_bytes(4, "little") + raw + (pa.compress(rest, codec="zstd", asbytes=True) if rest else b"")


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at, out, widths = 4, [], [np.dtype(k) for k in kinds]
    total = sum(w.itemsize for w in widths if w != np.uint64) * n
    raw_end = 4 + 8 * n * sum(w == np.uint64 for w in widths)
    rest = pa.decompress(blob[raw_end:], decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    place = 0
    for w in widths:
        if w == np.uint64:
            out.append(np.frombuffer(blob, w, n, at))
            at += 8 * n
        else:
            out.append(np.cumsum(np.frombuffer(rest, w, n, place), dtype=w))
            place += w.itemsize * n
    return out


def planes(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte place by byte place."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def from_planes(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.empty(0, np.int64)
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view(np.int64).ravel()


def bundle(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def unbundle(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def anchored(priority: np.ndarray, bounds: np.ndarray, reach: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments (document, first window start, number of windows, anchor) of the documents between bounds.

    priority: of each place to be an anchor, decided by the window - reach + 1 units from it on; the smallest wins,
    the leftmost among equal ones. reach: places of a window that can be its anchor."""
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    if not counts.sum():
        return (np.empty(0, np.int64),) * 4
    tagged = (priority & ~_MASK) | (np.arange(len(priority), dtype=np.uint64) & _MASK)
    least = (K.window_minimum(tagged, reach) & _MASK).astype(np.int64)
    start = K.spread(bounds[:-1], counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    anchor = least[start]
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(start)))
    # The tag holds the low bits of a place only; the window's start gives the others.
    base = start[at]
    place = base + ((anchor[at] - base) & int(_MASK))
    return doc[at], base, n, place


def _groups(*keys: np.ndarray, lead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first is the most significant) and the starts of runs in which the first `lead` agree."""
    order = np.lexsort(keys[::-1])
    cut = np.zeros(len(order), bool)
    cut[:1] = True
    for k in keys[:lead]:
        k = k[order]
        cut[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(cut)


def _first_of(key: np.ndarray, content: np.ndarray, docs: np.ndarray, positions: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(open, covered): records of each name (key, content) that may hold a first occurrence, and those that repeat an
    earlier one. across: a repeat must lie in a later document, else any later place counts. Records of one place (rows
    that share a number) go together."""
    order, starts = _groups(content, key, docs, positions, lead=2)
    lead = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    same = docs[order] == docs[lead]
    if not across:
        same &= positions[order] == positions[lead]
    return order[same], order[~same]


def _rows(kind: int, docs: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A row per group of ids, its records packed (ids first)."""
    if not len(docs):
        return
    order = np.lexsort((columns[0], docs, docs % GROUPS))
    docs, columns = docs[order], [c[order] for c in columns]
    group = docs % GROUPS
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() + [len(docs)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(group[a]), kind, pack(docs[a:b], *[c[a:b] for c in columns])


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"g": pa.int64(), "kind": pa.int32(), "shard": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[c]) for i, c in enumerate(names.split())], names.split())


#: Records of a segment: names of the anchor, the content and the sides, document, first window, windows.
SEGMENT = ("u8", "u8", "u8", "i8", "i4", "i4")
COVERED = ("i8", "i4", "i4")
ASKED = ("i8", "u8", "i1", "i4", "i4")
#: Contents of one key from which on its segments are cut further.
HOT = 4096
#: Segments cut further at a time.
SPLIT = 1 << 13


def _cut(cutter: Callable, shards: int, across: bool):
    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, content, sides, doc, pos, n = (np.concatenate([h[i] for h in held]) for i in range(6))
        kept, covered = _first_of(key, content, doc, pos, across)
        shard = (key[kept] >> np.uint64(33)) % np.uint64(shards)
        order = kept[np.argsort(shard, kind="stable")]
        shard = (key[order] >> np.uint64(33)) % np.uint64(shards)
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() + [len(order)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            at = at[np.lexsort((pos[at], doc[at]))]
            rows.append((int(shard[a]), 0, pack(key[at], content[at], sides[at], doc[at], pos[at], n[at])))
        if len(covered):  # nothing is left to find out; any shard passes them on
            covered = covered[np.lexsort((pos[covered], doc[covered]))]
            for i, part in enumerate(np.array_split(covered, max(1, len(covered) >> 14))):
                rows.append(((int(doc[part[0]]) + i) % shards, 1, pack(doc[part], pos[part], n[part])))
        yield _batch(rows, "shard kind blob")

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, buf, offsets in K.blocks(batch.column(1)):
                key, content, sides, doc, pos, n = cutter(buf, offsets)
                held.append((key, content, sides, ids[at + doc].astype(np.int64), pos.astype(np.int32), n.astype(np.int32)))
                count += len(doc)
                if count >= CHUNK:
                    yield from send(held)
                    held, count = [], 0
        if count:
            yield from send(held)

    return run


def _sharing(key: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether another record of the key has the same name on one side (0: that side is too short to have one)."""
    out = np.zeros(len(key), bool)
    for half in (sides >> np.uint64(32), sides & np.uint64(0xFFFFFFFF)):
        at = np.flatnonzero(half)
        name = K.mix(half[at] * K.BASE) ^ key[at]
        order = np.argsort(name)
        name, at = name[order], at[order]
        same = name[1:] == name[:-1]
        out[at[1:][same]] = True
        out[at[:-1][same]] = True
    return out


def _settle(across: bool, hot: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        rows = []
        passed = [unpack(b, *COVERED) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        if passed:
            doc, pos, n = (np.concatenate([p[i] for p in passed]) for i in range(3))
            rows += _rows(1, doc, [pos, n])
        parts = [unpack(b, *SEGMENT) for k, b in zip(kinds, blobs, strict=True) if k == 0]
        if parts:
            key, content, sides, doc, pos, n = (np.concatenate([p[i] for p in parts]) for i in range(6))
            del parts
            # Only keys that occur more than once matter.
            order = np.argsort(key, kind="stable")
            lead = key[order]
            again = np.zeros(len(lead), bool)
            again[1:] = lead[1:] == lead[:-1]
            again[:-1] |= again[1:].copy()
            at = order[again]
            key, content, sides, doc, pos, n = key[at], content[at], sides[at], doc[at], pos[at], n[at]
            if len(key):
                kept, covered = _first_of(key, content, doc, pos, across)
                rows += _rows(1, doc[covered], [pos[covered], n[covered]])
                # Several contents of one key: the texts decide.
                order, starts = _groups(key[kept], content[kept])
                at = kept[order]
                sizes = np.diff(np.append(starts, len(at)))
                ahead = content[at[starts]] != content[at[starts + sizes - 1]]
                asked = at[np.repeat(ahead, sizes)]
                asked = asked[_sharing(key[asked], sides[asked])]
                _, own, sizes = np.unique(key[asked], return_inverse=True, return_counts=True)
                many = sizes[own] > hot
                rows += _rows(2, doc[asked], [key[asked], many.astype(np.int8), pos[asked], n[asked]])
        return pa.Table.from_batches([_batch(rows, "g kind blob")])

    return run


def _per_document(handle: Callable, kinds: tuple[str, ...]):
    """Rows sorted by (g, kind): packed marks first (kind 0), then the documents (kind 1). handle(batch of documents,
    marks of each as arrays) yields what it makes of them."""

    def run(batches):
        group, marks = None, []
        for batch in batches:
            gs, kind = batch.column("g").to_pylist(), batch.column("kind").to_pylist()
            ids, blobs = batch.column("row").to_pylist(), batch.column("blob")
            rows, found, ready = [], [], None
            for i, g in enumerate(gs):
                if g != group:
                    group, marks, ready = g, [], None
                if kind[i] == 0:
                    marks.append(unpack(blobs[i].as_py(), *kinds))
                    continue
                if ready is None:  # sorted by document, once a group and batch
                    if marks:
                        columns = [np.concatenate([m[j] for m in marks]) for j in range(len(kinds))]
                        at = kinds.index("i8")
                        order = np.lexsort((columns[-2], columns[at]))
                        ready = [c[order] for c in columns]
                        marks = [ready]
                        ready = (columns[at][order], ready)
                    else:
                        ready = (np.empty(0, np.int64), [np.empty(0, np.dtype(k)) for k in kinds])
                docs, columns = ready
                own = slice(*np.searchsorted(docs, [ids[i], ids[i] + 1]))
                rows.append(i)
                found.append([c[own] for c in columns])
            if rows:
                yield from handle(batch.take(pa.array(rows)), found)

    return run


def with_marks(docs: DataFrame, marks: DataFrame, handle: Callable, kinds: tuple[str, ...], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """handle() over docs(row, text, *extra) and their packed marks(g, blob); the texts are shuffled once."""
    spark = docs.sparkSession
    own = docs.select(F.pmod("row", F.lit(GROUPS)).cast("long").alias("g"), F.lit(1).alias("kind"), "row", "text", F.lit(None).cast("binary").alias("blob"), *extra)
    other = marks.select("g", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("string").alias("text"), "blob", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in extra])
    both = own.unionByName(other).repartition(partitions(spark), "g").sortWithinPartitions("g", "kind")
    return both.mapInArrow(_per_document(handle, kinds), schema)


def covered_windows(docs: DataFrame, cutter: Callable, reader: Callable, splitter: Callable, comparer: Callable, across: bool, hot: int = HOT) -> DataFrame:
    """Packed marks (g, blob of COVERED) of all windows of docs(row, text) that repeat an earlier one.

    cutter(bytes, offsets): arrays (key, content, sides, document, first window, windows) of the segments; sides holds
    the names (32 bits each, 0: none) of what lies left and right of the anchor: segments of equal windows have one of them in common.
    reader(text bytes, pos, n): for each asked segment, its bytes for the comparer.
    splitter(payloads, key, pos, n): arrays (segment, key, pos, n, content) and the bytes of the parts of segments of common
    keys; equal windows are in parts of equal keys.
    comparer(key, doc, pos, n, payloads): (doc, pos, n) of the runs of covered windows."""
    count = shards(docs)
    sent = docs.select("row", "text").mapInArrow(_cut(cutter, count, across), "shard int, kind int, blob binary")
    settled = stored(sent.groupBy("shard").applyInArrow(_settle(across, hot), MARK), "settled")

    def fetch(batch, found):
        texts, rows = batch.column("text"), []
        cut = []
        for i, (doc, key, many, pos, n) in enumerate(found):
            if len(key):
                data, raw, own = (texts[i].as_py() or "").encode(), key.tobytes(), int(doc[0])
                to, common = ((key >> np.uint64(33)) % np.uint64(count)).tolist(), many.tolist()
                for j, (p, m, payload) in enumerate(zip(pos.tolist(), n.tolist(), reader(data, pos, n), strict=True)):
                    if common[j]:
                        cut.append((key[j], own, p, m, payload))
                    else:
                        rows.append((to[j], raw[8 * j : 8 * j + 8], own, p, m, payload))
        if cut:  # equal parts are settled here; one that repeats another goes on without its bytes, by any shard
            key, docs, pos, n = (np.array([c[i] for c in cut], t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64)))
            found = []
            for i in range(0, len(cut), SPLIT):
                part = slice(i, i + SPLIT)
                which, *rest = splitter([c[4] for c in cut[part]], key[part], pos[part], n[part])
                found.append((docs[part][which], *rest))
            docs, key, pos, n, content = (np.concatenate([f[i] for f in found]) for i in range(5))
            payloads = [p for f in found for p in f[5]]
            again = np.zeros(len(key), bool)
            again[_first_of(key, content, docs, pos, across)[1]] = True
            to, raw = np.where(again, docs % count, ((key >> np.uint64(33)) % np.uint64(count)).astype(np.int64)).tolist(), key.tobytes()
            parts = zip(to, docs.tolist(), pos.tolist(), n.tolist(), again.tolist(), payloads, strict=True)
            rows += [(t, raw[8 * j : 8 * j + 8], d, p, m, b"" if a else payload) for j, (t, d, p, m, a, payload) in enumerate(parts)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["shard", "key", "doc", "pos", "n", "payload"],
            )

    def compare(table: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint64)
        doc, pos, n = (table.column(c).to_numpy() for c in ("doc", "pos", "n"))
        payloads = table.column("payload").to_pylist()
        open_ = np.array([bool(p) for p in payloads], bool)
        found = comparer(key[open_], doc[open_], pos[open_], n[open_], [p for p in payloads if p])
        got = [np.concatenate([x[~open_], y]) for x, y in zip((doc, pos, n), found, strict=True)]
        return pa.Table.from_batches([_batch(list(_rows(1, got[0].astype(np.int64), [got[1].astype(np.int32), got[2].astype(np.int32)])), "g kind blob")])

    asked = settled.where("kind = 2").select("g", "blob")
    read = with_marks(docs, asked, fetch, ASKED, "shard int, key binary, doc long, pos int, n int, payload binary")
    compared = stored(read.groupBy("shard").applyInArrow(compare, MARK), "compared")
    return settled.where("kind = 1").select("g", "blob").unionByName(compared.select("g", "blob"))

