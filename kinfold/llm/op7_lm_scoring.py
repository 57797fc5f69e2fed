"""LM scoring with an Elias-Fano n-gram trie of words, sharded by n-gram.

Model: unigrams with one added; bigrams smoothed in two stages, p(w | u) = (c(u w) + m(u) p(w)) / (c(u) + m(u)) with
m(u) = PRIOR + SHARE * c(u), so that both rare and frequent contexts leave room for words not seen after them.

Trie (one a shard): the first level holds the contexts, the second their successors. Both levels are monotone
sequences in Elias-Fano form: pointers to where a context's successors begin, and the successors' word numbers, each
lifted by its context so that the whole level rises. Smoothed probabilities are quantised to CODE_BITS bits of
log10 and packed. The levels lie in one memory-mapped file; a lookup finds the context and then searches the
successors relative to it. An n-gram that isn't found is scored with the context's remaining mass.

Flow: chunks of documents send their distinct words with training counts to shards, which add them up, number the words
(frequent ones get small numbers) and answer; with counts and numbers known, chunks send their distinct bigrams with
training counts and the documents that hold them; a shard adds up, builds its trie over the words' numbers, scores the
bigrams by it and returns sums by document. A word is told by two names, 96 bits together. Bigrams are dealt by their
context; one that is frequent is spread over shards in proportion to its count. Counts cover all training tokens.

Defined cases: a null text is empty: one end token; the first token of a text has no context and its unigram
probability; repeated rows are rows of their own; very long texts are scored whole, each within
one chunk; without training tokens everything is unknown; an empty table gives an empty result; columns other than
those named here are not read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm._base import dropped, shards, stored, table
from kinfold.llm._segments import _groups, bundle, from_planes, pack, planes, unbundle, unpack

NAME = "op7_lm_scoring"
ORACLE_SQL = None
PRIOR, SHARE = 100.0, 0.5
CODE_BITS, LOWEST = 10, -15.0
#: Steps of a log10 in which unigram probabilities travel to the shards.
CODED = 100
CHUNK_TOKENS = 1 << 20
#: Names of the token that ends a text.
END, END_CHECK = np.uint64(0x5EED0FE2D0C5A11D), np.uint32(0)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values below 2**width, width bits each, in 64-bit words (with one word to spare)."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * K.U64(width)
        word, bit = (at >> K.U64(6)).astype(np.int64), at & K.U64(63)
        values = values.astype(np.uint64)
        np.bitwise_or.at(out, word, values << bit)
        over = bit + K.U64(width) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (K.U64(64) - bit[over]))
    return out


def read_bits(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    at = at.astype(np.uint64) * K.U64(width)
    word, bit = (at >> K.U64(6)).astype(np.int64), at & K.U64(63)
    high = np.where(bit > 0, words[word + 1] << ((K.U64(64) - bit) & K.U64(63)), K.U64(0))
    return ((words[word] >> bit) | high) & K.U64((1 << width) - 1)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits as unary gaps with a running count of ones a word."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // max(self.n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        self.low = pack_bits(values & K.U64((1 << self.width) - 1), self.width)
        ones = (values >> K.U64(self.width)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros((int(ones[-1]) // 64 + 1 if self.n else 1) * 64, np.uint8)
        bits[ones] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high))]).astype(np.uint32)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ranks]

    def take(self, arrays: list[np.ndarray]) -> None:
        self.low, self.high, self.ranks = arrays

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, at, "right") - 1
        left = at - self.ranks[word]
        bits, place = self.high[word].copy(), np.zeros(len(at), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # the place of the left-th one in its word
            ones = np.bitwise_count(bits & K.U64((1 << step) - 1)).astype(np.int64)
            go = left >= ones
            left = left - np.where(go, ones, 0)
            place += np.where(go, step, 0)
            bits = np.where(go, bits >> K.U64(step), bits)
        high = word.astype(np.int64) * 64 + place - at
        return (high.astype(np.uint64) << K.U64(self.width)) | read_bits(self.low, at, self.width)


def encode(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((logs - LOWEST) * ((1 << CODE_BITS) - 1) / -LOWEST), 0, (1 << CODE_BITS) - 1).astype(np.uint64)


def decode(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * -LOWEST / ((1 << CODE_BITS) - 1) + LOWEST


class Trie:
    """contexts, words: numbers of each bigram's words, in order of (context, word); logs: its log10 probability."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, logs: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.empty(0, np.int64)
        self.contexts, self.words = contexts[first], np.unique(words)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(contexts))))
        self.pointers = EliasFano(np.append(first, len(contexts)))
        self.successors = EliasFano(which.astype(np.uint64) * K.U64(len(self.words)) + np.searchsorted(self.words, words).astype(np.uint64))
        self.codes = pack_bits(encode(logs), CODE_BITS)
        self._map()

    def _map(self) -> None:
        """All levels into one memory-mapped file, which goes with the trie."""
        parts = [self.contexts, self.words, self.codes, *self.pointers.arrays(), *self.successors.arrays()]
        self.file = tempfile.TemporaryFile()
        places = []
        for part in parts:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append((self.file.tell(), part.dtype, len(part)))
            self.file.write(part.tobytes())
        self.file.write(b"\0" * 8)
        self.file.flush()
        data = np.memmap(self.file, np.uint8, "r")
        parts = [data[at : at + n * kind.itemsize].view(kind) for at, kind, n in places]
        self.contexts, self.words, self.codes = parts[:3]
        self.pointers.take(parts[3:6])
        self.successors.take(parts[6:9])

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probability of each bigram; NaN where the trie hasn't it."""
        out = np.full(len(words), np.nan)
        if not len(self.contexts) or not len(words):
            return out
        c = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        w = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        ask = np.flatnonzero((self.contexts[c] == contexts) & (self.words[w] == words))
        c, w = c[ask], w[ask]
        low, high = self.pointers[c].astype(np.int64), self.pointers[c + 1].astype(np.int64)
        wanted = c.astype(np.uint64) * K.U64(len(self.words)) + w.astype(np.uint64)
        while len(ask):  # all searches at once; those that end drop out
            middle = (low + high) >> 1
            value = self.successors[middle]
            hit = value == wanted
            out[ask[hit]] = decode(read_bits(self.codes, middle[hit], CODE_BITS))
            above = value > wanted
            low, high = np.where(above, low, middle + 1), np.where(above, middle, high)
            go = ~hit & (low < high)
            ask, low, high, wanted = ask[go], low[go], high[go], wanted[go]
        return out


def _shard(names: np.ndarray, shards: int) -> np.ndarray:
    return ((names >> K.U64(33)) % K.U64(shards)).astype(np.int64)


def _bigram_shard(context: np.ndarray, word: np.ndarray, of: np.ndarray, tokens: int, shards: int) -> np.ndarray:
    """A context's successors stay together, unless it is so frequent that it would fill a shard: then they are dealt to
    more shards, in proportion to its count over all training tokens, which every chunk knows."""
    spread = (1 + of * (4 * shards) // max(tokens, 1)).astype(np.uint64)
    salt = K.mix(word.astype(np.uint64)) % spread
    return _shard(K.mix(K.mix(context.astype(np.uint64)) + salt * K.BASE), shards)


def _parts(shard: np.ndarray):
    """(shard, members in order) for each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    ordered = shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])).tolist() + [len(order)] if len(order) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(ordered[a]), order[a:b]


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"shard": pa.int32(), "chunk": pa.int64(), "kind": pa.int32(), "ids": pa.list_(pa.int64()), "blob": pa.binary(), "words": pa.binary()}
    return pa.table({c: pa.array([r[i] for r in rows], kinds[c]) for i, c in enumerate(names.split())})


def _tokenise(count: int):
    """doc_id, text, train -> a row a chunk: ids; words (distinct names, further bits of them, training counts); blob
    (lengths, whether training, the place of each token's word, and the words' shards)."""

    def run(batches):
        from pyspark import TaskContext

        number, held, ids, tokens = TaskContext.get().partitionId() << 24, [], [], 0

        def send():
            names, checks, lengths, train = (np.concatenate([h[i] for h in held]) for i in range(4))
            order, starts = _groups(names, checks, lead=2)
            often = np.diff(np.append(starts, len(order)))
            by = np.argsort(-often, kind="stable")  # frequent words come first
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by), dtype=np.int32)
            stream = np.empty(len(order), np.int32)
            stream[order] = np.repeat(rank, often)
            words, checks = names[order[starts[by]]], checks[order[starts[by]]]
            seen = np.bincount(stream[np.repeat(train, lengths)], minlength=len(words)).astype(np.int64)
            blob = bundle(pack(lengths.astype(np.int32), train.astype(np.int8)), planes(stream), planes(_shard(words, count)))
            return _table([(number, ids, pack(words, checks, seen), blob)], "chunk ids words blob").to_batches()[0]

        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for at, buf, offsets in K.blocks(batch.column(1)):
                buf = K.lowered(buf)
                start, end, bounds = K.words(buf, offsets)
                names, checks = K.name(buf, start, end), (K.name(buf, start, end, 1) >> K.U64(32)).astype(np.uint32)
                docs = len(offsets) - 1
                held.append((np.insert(names, bounds[1:], END), np.insert(checks, bounds[1:], END_CHECK), np.diff(bounds) + 1, train[at : at + docs]))
                ids += batch.column(0).slice(at, docs).to_pylist()
                tokens += len(names) + docs
                if tokens >= CHUNK_TOKENS:
                    yield send()
                    held, ids, tokens, number = [], [], 0, number + 1
        if held:
            yield send()

    return run


def _ask_words(count: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, checks, seen = unpack(blob, "u8", "u4", "i8")
                rows = [(shard, chunk, pack(words[at], checks[at], seen[at])) for shard, at in _parts(_shard(words, count))]
                yield from _table(rows, "shard chunk blob").to_batches()

    return run


def _count_words(count: int):
    def run(one: pa.Table) -> pa.Table:
        """The words of one shard -> each chunk's words' counts over all chunks, and their numbers; chunk -1: (tokens,
        distinct words)."""
        chunks, shard = one.column("chunk").to_pylist(), one.column("shard")[0].as_py()
        parts = [unpack(b, "u8", "u4", "i8") for b in one.column("blob").to_pylist()]
        names, checks, seen = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order, starts = _groups(names, checks, lead=2)
        sums = np.add.reduceat(seen[order], starts)
        rank = np.empty(len(starts), np.int64)
        rank[np.argsort(-sums, kind="stable")] = np.arange(len(starts))
        times = np.diff(np.append(starts, len(order)))
        total, number = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        total[order], number[order] = np.repeat(sums, times), np.repeat(rank * count + shard, times)
        rows, at = [(shard, -1, pack(np.array([sums.sum(), (sums > 0).sum()])))], 0
        for chunk, part in zip(chunks, parts, strict=True):
            to = at + len(part[0])
            rows.append((shard, chunk, bundle(planes(total[at:to]), planes(number[at:to]))))
            at = to
        return _table(rows, "shard chunk blob")

    return run


def _ask_bigrams(count: int, tokens: int, types: int):
    """A chunk with its words' counts -> the chunk's bigrams by shard (kind 0), its documents' own sums (kind 1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], "shard chunk kind blob")
        chunk, blob = left.column("chunk")[0].as_py(), left.column("blob")[0].as_py()
        head, stream, home = unbundle(blob)
        home = from_planes(home)
        counts, words = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
        answers = dict(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True))
        for shard, at in _parts(home):
            counts[at], words[at] = (from_planes(p) for p in unbundle(answers[shard]))
        lengths, train = unpack(head, "i4", "i1")
        stream = from_planes(stream).astype(np.int32)
        lengths = lengths.astype(np.int64)
        logs = np.log10((counts + 1.0) / (tokens + types + 1.0))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        size = len(stream)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        base = np.add.reduceat(logs[stream], first)
        known = np.add.reduceat((counts[stream] > 0).astype(np.int64), first)
        rows = [(int(chunk % count), chunk, 1, pack(base.view(np.uint64), logs[stream[first]].view(np.uint64), lengths, known))]
        inner = np.ones(size, bool)
        inner[first] = False
        inner = np.flatnonzero(inner)
        pair = stream[inner - 1].astype(np.int64) * len(words) + stream[inner]
        order = np.argsort(pair, kind="stable")
        pair, holder = pair[order], doc[inner][order].astype(np.int32)
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        posts = np.diff(np.append(start, len(pair)))
        u, w = np.divmod(pair[start], len(words)) if len(start) else (np.empty(0, np.int64),) * 2
        seen = np.add.reduceat(train[holder].astype(np.int64), start) if len(start) else np.empty(0, np.int64)
        coded = np.rint(logs * CODED).astype(np.int16)
        for shard, at in _parts(_bigram_shard(words[u], words[w], counts[u], tokens, count)):
            lead = np.flatnonzero(np.concatenate([[True], u[at][1:] != u[at][:-1]]))
            of = u[at][lead]
            held = holder[K.spread(start[at], posts[at])]
            rest = pack(seen[at].astype(np.int32), coded[w[at]], posts[at].astype(np.int32))
            rows.append((shard, chunk, 0, bundle(planes(words[of]), planes(np.diff(np.append(lead, len(at)))), planes(counts[of]), planes(words[w[at]]), rest, planes(held))))
        return _table(rows, "shard chunk kind blob")

    return run


def _score(one: pa.Table) -> pa.Table:
    """The bigrams of one shard -> sums by chunk and document, by the shard's trie."""
    rows, parts = [], []
    for chunk, kind, blob in zip(*(one.column(c).to_pylist() for c in ("chunk", "kind", "blob")), strict=True):
        if kind == 1:
            rows.append((chunk, 1, blob))
            continue
        context, n, of, word, rest, held = unbundle(blob)
        n = from_planes(n)
        seen, coded, posts = unpack(rest, "i4", "i2", "i4")
        parts.append((chunk, np.repeat(from_planes(context), n), from_planes(word), seen, (coded / CODED).astype(np.float32), np.repeat(from_planes(of), n), posts, from_planes(held).astype(np.int32)))
    if not parts:
        return _table(rows, "chunk kind blob")
    context, word, seen, lower, of = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
    parts = [(p[0], p[6], p[7]) for p in parts]
    mass = PRIOR + SHARE * of
    rest = np.log10(mass / (of + mass)) + lower  # of a bigram that was not seen
    trained = np.flatnonzero(seen)
    order = trained[np.lexsort((word[trained], context[trained]))]
    c, w = context[order], word[order]
    lead = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])) if len(order) else order
    at = order[lead]
    total = np.add.reduceat(seen[order].astype(np.int64), lead) if len(order) else np.empty(0)
    trie = Trie(context[at], word[at], np.log10(total / (of[at] + mass[at]) + 10.0 ** rest[at]))
    found = trie.find(context, word)
    logs, place = np.where(np.isnan(found), rest, found), 0
    for chunk, posts, held in parts:
        sums = np.bincount(held, np.repeat(logs[place : place + len(posts)], posts))
        place += len(posts)
        docs = np.flatnonzero(np.bincount(held))
        rows.append((chunk, 0, pack(sums[docs].view(np.uint64), docs.astype(np.int32))))
    return _table(rows, "chunk kind blob")


def _gather(one: pa.Table) -> pa.Table:
    """The sums of one chunk -> chunk, place, n_tokens, n_known, base_score, score of its documents."""
    kinds, blobs = one.column("kind").to_pylist(), one.column("blob").to_pylist()
    base, first, lengths, known = unpack(blobs[kinds.index(1)], "u8", "u8", "i8", "i8")
    score = first.view(np.float64).copy()
    for kind, blob in sorted(zip(kinds, blobs, strict=True)):  # in a fixed order, so that sums are the same again
        if kind == 0:
            sums, docs = unpack(blob, "u8", "i4")
            score[docs] += sums.view(np.float64)
    chunk = one.column("chunk")[0].as_py()
    return pa.table({"chunk": pa.array([chunk] * len(score), pa.int64()), "place": pa.array(np.arange(len(score))), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "base_score": pa.array(base.view(np.float64)), "score": pa.array(score)})


def score(docs: DataFrame, train: str = "train") -> DataFrame:
    """docs(doc_id, text, `train`: boolean) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    count = shards(docs)
    chunks = stored(docs.mapInArrow(_tokenise(count), "chunk long, ids array<long>, words binary, blob binary"), "chunks")
    asked = chunks.select("chunk", "words").mapInArrow(_ask_words(count), "shard int, chunk long, blob binary")
    counted = stored(asked.groupBy("shard").applyInArrow(_count_words(count), "shard int, chunk long, blob binary"), "words")
    totals = [unpack(bytes(r["blob"]), "i8")[0] for r in counted.where("chunk = -1").select("blob").collect()]  # two numbers a shard
    tokens, types = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    pairs = chunks.select("chunk", "blob").groupBy("chunk").cogroup(counted.where("chunk >= 0").groupBy("chunk")).applyInArrow(_ask_bigrams(count, tokens, types), "shard int, chunk long, kind int, blob binary")
    sums = stored(pairs.groupBy("shard").applyInArrow(_score, "chunk long, kind int, blob binary"), "sums")
    dropped(counted)
    rows = sums.groupBy("chunk").applyInArrow(_gather, "chunk long, place long, n_tokens long, n_known long, base_score double, score double")
    ids = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id"))
    return ids.join(rows, ["chunk", "place"]).select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return score(docs).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
