"""Substring dedup by recompression: Spark rounds name words, runs and pairs globally; shared symbols reveal repeats.

Texts are cut into chunks of words. Round 0 names the words, and each further round names the runs of equal symbols and
the pairs of a "left" and a "right" symbol (the side is a bit of the symbol's name and the round). A round is an exchange:
a chunk sends its distinct words, runs and pairs to shards, once each; a shard numbers those that several documents
have, and answers with the numbers. So equal token sequences have equal symbols in every chunk, different ones different
symbols, and what only one document has becomes a dead symbol, which is never paired again.

A symbol is interior to a window if the words that decide its place and content all lie in the window: its own, and for
each level those of the symbol at either side. This reach is counted exactly. Equal windows have equal interior
symbols, so a window that another document shares has no dead one. Each round drops the windows that hold a dead interior
symbol, and the words that no window is left of; after the rounds nearly all windows that are left are shared ones. They
are verified by their symbols of level 0, the global numbers of their WINDOW words, in a last exchange by 96 bits of them.

In no exchange does a key gather rows: what is common is sent once a chunk. A round's table goes when the next is written.

Defined cases: null, empty and shorter texts have no window and lose nothing; very long texts are a chunk of their own;
repeats within one document stay; rows that share a doc_id are documents of their own in the order of digests of their
texts, rows without an id come after all others, and rows that agree in both id and text are one document, and each gets
its result; an empty table gives an empty result; strip_passages() passes other columns through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm import _segments as S
from kinfold.llm._base import dropped, numbered, shards, stored, table

NAME = "op9_passages"
WINDOW = 13
#: Rounds after that of words. A window of 13 words holds few interior symbols of higher levels.
ROUNDS = 2
#: Bytes of text of one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bits of a run's length beside its symbol's number. Longer runs are in no window.
RUN_BITS = 16
_FAR = 1 << 40
_ROWS = "chunk long, shard int, kind int, blob binary"
STATE, ASKED, COVERED = range(3)


def sides(symbols: np.ndarray, level: int) -> np.ndarray:
    """Whether each symbol is a right one in a round."""
    return (K.mix(symbols.astype(np.uint64) ^ K.U64(0x51ED27 + level)) & K.U64(1)).astype(bool)


def joined(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round over symbols (0: dead; first: those that open a text): (place of each new symbol, x, y, whether it is a
    new run or pair). x and y are the two runs, each a symbol and its length; y is 0 without a second one. Where
    neighbours part is decided by these two alone."""
    n = len(symbols)
    opens = first.copy()
    opens[1:] |= (symbols[1:] != symbols[:-1]) | (symbols[1:] == 0)
    at = np.flatnonzero(opens)
    own, length = symbols[at], np.diff(np.append(at, n))
    right, live = sides(own, level), (own > 0) & (length < 1 << RUN_BITS)
    pair = np.zeros(len(at) + 1, bool)
    pair[:-2] = ~right[:-1] & right[1:] & ~first[at[1:]] & live[:-1] & live[1:]
    lead = np.flatnonzero(~np.concatenate([[False], pair[:-2]])) if n else at
    run = np.append(own << RUN_BITS | length, 0)
    paired = pair[lead]
    dead = ~live[lead]
    x, y = np.where(dead, 0, run[lead]), np.where(paired, run[np.minimum(lead + 1, len(at))], 0)
    return at[lead], x, y, (paired | (length[lead] > 1)) & ~dead


class Chunk:
    """The words of a chunk that are still in question: fragments (number of the document, place in it, words), the
    stream of their words as numbers of `ids`, the words' global numbers, and of each level (x, y, number) of live
    symbols."""

    def __init__(self, doc, place, size, stream, ids, levels):
        self.doc, self.place, self.size, self.stream, self.ids, self.levels = doc, place, size, stream, ids, levels
        self.front: tuple | None = None  # what grown() has reached; not part of the state that is sent

    def packed(self) -> bytes:
        words = [S.pack(self.doc, self.place, self.size), S.planes(self.stream), S.planes(self.ids)]
        return S.bundle(*words, *[S.planes(v) for x, y, number in self.levels for v in (np.diff(x, prepend=0), y, number)])

    @classmethod
    def unpacked(cls, blob: bytes) -> Chunk:
        parts = S.unbundle(blob)
        doc, place, size = S.unpack(parts[0], "i8", "i4", "i4")
        rest = [S.from_planes(p) for p in parts[1:]]
        return cls(doc, place, size, rest[0], rest[1], [(np.cumsum(rest[i]), rest[i + 1], rest[i + 2]) for i in range(2, len(rest), 3)])

    def grown(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words that open a window still in question, (x, y, text) of the runs and pairs of the level that has no
        names yet)."""
        n = len(self.stream)
        opens = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        if self.front is None:
            first = np.zeros(n, bool)
            first[opens] = True
            text = np.repeat(np.cumsum(np.concatenate([[True], self.doc[1:] != self.doc[:-1]])), self.size)
            out = np.zeros(n + 1, np.int64)  # changes of the number of reasons against a window
            self._reach(1, self.ids[self.stream], first, text, np.arange(n), np.arange(1, n + 1), out)
        while self.front[0] <= len(self.levels):
            level, symbols, first, text, low, high, out, (at, x, y, new) = self.front
            # Reach: that of the neighbours as well; beyond the end of a fragment nothing is known.
            last = np.append(first[1:], True)
            end = np.append(at[1:], len(symbols)) - 1
            low, high = np.where(first[at], -_FAR, low[np.maximum(at - 1, 0)]), np.where(last[end], _FAR, high[np.minimum(end + 1, len(high) - 1)])
            symbols, first, text = symbols[at], first[at], text[at]
            symbols[x == 0] = 0
            symbols[new] = self._numbers(level, x[new], y[new])
            self._reach(level + 1, symbols, first, text, low, high, out)
        out, (at, x, y, new) = self.front[6:]
        starts = K.spread(opens, np.maximum(self.size - WINDOW + 1, 0))
        return starts[np.cumsum(out[:-1])[starts] == 0], (x[new], y[new], self.front[3][at[new]])

    def _reach(self, level: int, symbols, first, text, low, high, out) -> None:
        """Counts the windows that hold a dead interior symbol, and finds the runs and pairs of a level."""
        dead = (symbols == 0) & (high - low <= WINDOW)
        out += np.bincount(np.maximum(high[dead] - WINDOW, 0), minlength=len(out)) - np.bincount(low[dead] + 1, minlength=len(out))
        self.front = (level, symbols, first, text, low, high, out, joined(symbols, first, level))

    def _numbers(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Numbers of runs and pairs; 0 for what is dead."""
        p, q, number = self.levels[level - 1]
        if not len(p):
            return np.zeros(len(x), np.int64)
        known, asked = _merged(p, q), _merged(x, y)
        order = np.argsort(known)
        spot = order[np.minimum(np.searchsorted(known[order], asked), len(p) - 1)]
        return np.where((p[spot] == x) & (q[spot] == y), number[spot], 0)

    def narrowed(self, starts: np.ndarray) -> Chunk | None:
        """What is left of the chunk if only the windows that start there are in question."""
        if not len(starts):
            return None
        n = len(self.stream)
        edge = np.bincount(starts, minlength=n + WINDOW) - np.bincount(starts + WINDOW, minlength=n + WINDOW)
        kept = np.cumsum(edge)[:n] > 0
        opens = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        begins = kept.copy()
        begins[1:] &= ~kept[:-1]
        begins[opens] |= kept[opens]
        at = np.flatnonzero(begins)
        which = np.searchsorted(opens, at, "right") - 1
        size = np.add.reduceat(kept.astype(np.int64), at)
        stream = self.stream[kept]
        used = np.zeros(len(self.ids), bool)
        used[stream] = True
        return Chunk(self.doc[which], (self.place[which] + at - opens[which]).astype(np.int32), size.astype(np.int32), (np.cumsum(used) - 1)[stream], self.ids[used], self.levels)


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(x.astype(np.uint64)) * K.BASE + y.astype(np.uint64))


def _distinct(x: np.ndarray, y: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one member of each group of equal (x, y), whether several texts have it). Texts are in order."""
    order, starts = S._groups(x, y, lead=2)
    ends = np.append(starts[1:], len(order)) - 1
    return order[starts], text[order[starts]] != text[order[ends]]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("chunk", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())))})


def _by_shard(names: np.ndarray, count: int):
    """(shard, members) of each shard that occurs, in order."""
    shard = ((names >> K.U64(33)) % K.U64(count)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])).tolist() + [len(order)] if len(order) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _asked(pending: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, whether several texts have it) of the distinct runs and pairs, in a fixed order."""
    x, y, text = pending
    at, many = _distinct(x, y, text)
    return x[at], y[at], many


def _tokenise(count: int):
    """row, text -> a chunk's state (its words numbered by how often they occur; the ids are their shards for now) and
    its distinct words by shard."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, buf, offsets in K.blocks(batch.column(1), CHUNK_BYTES):
                start, end, bounds = K.words(buf, offsets)
                size = np.diff(bounds)
                if size.max(initial=0) < WINDOW:
                    continue
                names = K.name(buf, start, end)
                text = np.repeat(np.arange(len(size)), size)
                order = np.argsort(names, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
                often = np.diff(np.append(cut, len(order)))
                rank = np.argsort(-often, kind="stable")
                place = np.empty(len(rank), np.int64)
                place[rank] = np.arange(len(rank))
                stream = np.empty(len(order), np.int64)
                stream[order] = np.repeat(place, often)
                one, final = order[cut][rank], order[np.append(cut[1:], len(order)) - 1][rank]
                many = text[one] != text[final]
                home = np.empty(len(one), np.int64)
                rows = []
                for shard, own in _by_shard(names[one], count):
                    home[own] = shard
                    a, b = start[one[own]], end[one[own]]
                    data = buf[K.spread(a, b - a)].tobytes()
                    rows.append((number, shard, ASKED, S.bundle(S.pack((b - a).astype(np.int32), many[own].astype(np.int8)), pa.compress(data, codec="zstd", asbytes=True), len(data).to_bytes(8, "little"))))
                full = size > 0
                chunk = Chunk(ids[at : at + len(size)][full], np.zeros(int(full.sum()), np.int32), size[full].astype(np.int32), stream, home, [])
                yield _table([(number, None, STATE, chunk.packed()), *rows]).to_batches()[0]
                number += 1

    return run


def _named(level: int, count: int):
    """The words (level 0), or runs and pairs, of one shard -> each chunk's numbers of them, in the order asked; 0 for
    what one document alone has. Numbers of levels and shards differ."""

    def run(one: pa.Table) -> pa.Table:
        parts, shard = [], one.column("shard")[0].as_py()
        for blob in one.column("blob").to_pylist():
            own = S.unbundle(blob)
            if level:
                parts.append((np.cumsum(S.from_planes(own[0])), S.from_planes(own[1]), S.unpack(own[2], "i1")[0]))
            else:
                size, many = S.unpack(own[0], "i4", "i1")
                buf = np.frombuffer(pa.decompress(own[1], decompressed_size=int.from_bytes(own[2], "little"), codec="zstd", asbytes=True), np.uint8)
                end = np.cumsum(size.astype(np.int64))
                parts.append((*(K.name(buf, end - size, end, seed) for seed in (1, 2)), many))
        x, y, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order, starts = S._groups(x, y, lead=2)
        times = np.diff(np.append(starts, len(order)))
        live = (times > 1) | (np.add.reduceat(many[order], starts, dtype=np.int64) > 0)
        number = np.where(live, ((np.cumsum(live) - 1) * count + shard) * (ROUNDS + 1) + level + 1, 0)
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(number, times)
        rows, at = [], 0
        for chunk, part in zip(one.column("chunk").to_pylist(), parts, strict=True):
            rows.append((chunk, shard, ASKED, S.planes(out[at : at + len(part[0])])))
            at += len(part[0])
        return _table(rows)

    return run


def _advance(level: int, count: int):
    """A chunk's state and the answers to what it asked -> its next state and questions; after the last round the
    windows that are left, by shard, and those that repeat one of a document before it in the chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        number, chunk = left.column("chunk")[0].as_py(), Chunk.unpacked(left.column("blob")[0].as_py())
        answers = dict(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True))
        if not level:
            home, chunk.ids = chunk.ids, np.zeros(len(chunk.ids), np.int64)
            for shard, blob in answers.items():
                chunk.ids[home == shard] = S.from_planes(blob)
        else:
            x, y, _ = _asked(chunk.grown()[1])
            given = np.zeros(len(x), np.int64)
            for shard, own in _by_shard(_merged(x, y), count):
                given[own] = S.from_planes(answers[shard])
            chunk.levels.append((x[given > 0], y[given > 0], given[given > 0]))
        starts = chunk.grown()[0]
        if level == ROUNDS:
            return _windows(number, chunk, starts, count)
        chunk = chunk.narrowed(starts)
        if chunk is None:
            return _table([])
        x, y, many = _asked(chunk.grown()[1])
        rows = [(number, None, STATE, chunk.packed())]
        for shard, own in _by_shard(_merged(x, y), count):
            rows.append((number, shard, ASKED, S.bundle(S.planes(np.diff(x[own], prepend=0)), S.planes(y[own]), S.pack(many[own].astype(np.int8)))))
        return _table(rows)

    return run


def _windows(number: int, chunk: Chunk, starts: np.ndarray, count: int) -> pa.Table:
    words = chunk.ids[chunk.stream].astype(np.uint64)
    names = [K.runs_of(K.mix(words ^ K.U64(seed)), WINDOW)[starts] for seed in (1, 2)]
    names[1] = (names[1] >> K.U64(32)).astype(np.uint32)
    opens = np.concatenate([[0], np.cumsum(chunk.size)[:-1]])
    which = np.searchsorted(opens, starts, "right") - 1
    doc, pos = chunk.doc[which], (chunk.place[which] + starts - opens[which]).astype(np.int32)
    kept, covered = S._first_of(*names, doc, pos, across=True)
    kept = np.sort(kept)
    # What is settled already goes along with the questions of some shard.
    rows = [(number, number % count, COVERED, S.pack(doc[covered], pos[covered]))] if len(covered) else []
    for shard, own in _by_shard(names[0][kept], count):
        own = kept[own]
        rows.append((number, shard, ASKED, S.pack(names[0][own], names[1][own], doc[own], pos[own])))
    return _table(rows)


def _verified(one: pa.Table) -> pa.Table:
    """The windows of one shard -> of each chunk those that also start in an earlier document; what chunks have settled
    passes through."""
    asked = [(c, S.unpack(b, "u8", "u4", "i8", "i4")) for c, k, b in zip(*(one.column(c).to_pylist() for c in ("chunk", "kind", "blob")), strict=True) if k == ASKED]
    rows = [(c, None, COVERED, b) for c, k, b in zip(*(one.column(c).to_pylist() for c in ("chunk", "kind", "blob")), strict=True) if k == COVERED]
    if asked:
        a, b, doc, pos = (np.concatenate([p[i] for _, p in asked]) for i in range(4))
        _, covered = S._first_of(a, b, doc, pos, across=True)
        covered = np.sort(covered)
        cuts = np.searchsorted(covered, np.cumsum([0] + [len(p[0]) for _, p in asked]))
        rows += [(c, None, COVERED, S.pack(doc[covered[i:j]], pos[covered[i:j]])) for (c, _), i, j in zip(asked, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if j > i]
    return _table(rows)


def _spans(one: pa.Table) -> pa.Table:
    """The covered windows of one chunk, as runs."""
    parts = [S.unpack(b, "i8", "i4") for b in one.column("blob").to_pylist()]
    doc, pos = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)]))
    last = np.append(first[1:], len(doc)) - 1
    return pa.Table.from_batches([S._batch(list(S._rows(1, doc[first], [pos[first].astype(np.int32), (pos[last] - pos[first] + 1).astype(np.int32)])), "g kind blob")])


def repeats(docs: DataFrame) -> DataFrame:
    """Packed marks (g, blob of S.COVERED) of the windows of docs(row, text) that also start in an earlier row."""
    count = shards(docs)
    rounds = stored(docs.select("row", "text").mapInArrow(_tokenise(count), _ROWS), "words")
    for level in range(ROUNDS + 1):
        answers = rounds.where(F.col("kind") == ASKED).groupBy("shard").applyInArrow(_named(level, count), _ROWS)
        states = rounds.where(F.col("kind") == STATE).groupBy("chunk")
        after = states.cogroup(answers.groupBy("chunk")).applyInArrow(_advance(level, count), _ROWS)
        if level == ROUNDS:
            found = after.groupBy("shard").applyInArrow(_verified, _ROWS).groupBy("chunk").applyInArrow(_spans, S.MARK)
            after = stored(found.select("g", "blob"), "covered")
        else:
            after = stored(after, f"round-{level}")
        dropped(rounds)
        rounds = after
    return rounds


def _flags(count: int, pos: np.ndarray, n: np.ndarray, reach: int) -> np.ndarray:
    """Which of `count` units the windows (n of them from pos on, each of `reach` units) cover."""
    edge = np.zeros(count + 1, np.int32)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + n + reach - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(batch: pa.RecordBatch, found):
    texts, n_words, removed, kept = batch.column("text"), [], [], []
    for i, (_, pos, n) in enumerate(found):
        words = (texts[i].as_py() or "").encode().split()
        gone = 0
        if len(pos):
            flags = _flags(len(words), pos, n, WINDOW)
            gone = int(flags.sum())
            left = [words[j] for j in np.flatnonzero(~flags).tolist()]
        else:
            left = words
        n_words.append(len(words))
        removed.append(gone)
        kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _strip(extra: tuple[str, ...]):
    def run(batch: pa.RecordBatch, found):
        texts, out = batch.column("text"), []
        for i, (_, pos, n) in enumerate(found):
            text = texts[i].as_py()
            if text and len(pos):
                words = text.encode().split()
                text = b" ".join(words[j] for j in np.flatnonzero(~_flags(len(words), pos, n, WINDOW)).tolist()).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *[batch.column(c) for c in extra]], ["text", *extra])

    return run


def strip_passages(docs: DataFrame) -> DataFrame:
    """docs without the words covered by a window that also starts in a document of smaller doc_id. Texts that lose
    nothing stay as they are; of others, the words left are joined by single spaces."""
    others = [c for c in docs.columns if c != "text"]
    safe = [f"_{i}" for i in range(len(others))]  # names that cannot clash with those used here
    rows, _ = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("others")))
    rows = rows.select("row", "text", *[F.col("others")[c].alias(s) for c, s in zip(others, safe, strict=True)])
    schema = ", ".join(["text string", *[f"`{s}` {rows.schema[s].dataType.simpleString()}" for s in safe]])
    out = S.with_marks(rows, repeats(rows), _strip(tuple(safe)), S.COVERED, schema, tuple(safe))
    return out.select(*[F.col("text" if c == "text" else safe[others.index(c)]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return S.with_marks(docs, repeats(docs), _digest, S.COVERED, "doc_id long, n_words long, n_removed long, kept_sha256 string", ("doc_id",))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
y AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS first FROM y GROUP BY h HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM y JOIN f USING (h) WHERE doc_id > first),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM u ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
