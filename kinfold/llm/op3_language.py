"""Language identification by a linear-chain conditional random field over the words of a text.

Every word is labelled with a language. Its features (hashed) are its affixes, its byte n-grams, its length and its
place in a lexicon, learned from the training texts, of words that are frequent in one language only; weights of
features and of transitions between neighbouring words are learned together by maximising the likelihood of the
training labels, with forward-backward for the gradient. A prediction runs forward-backward over the whole text and adds up the words'
posteriors: the language with most of them is the text's, its share is the score; words() returns the labels of
code-switched text word by word.

Training uses a bounded sample of documents, SAMPLE of each language at most, in the order of a hash of the doc_id,
and the whole text of each, as chains of PIECE words; predictions use whole texts. Every language of the training rows that have a
doc_id is a class; texts and words run in groups of so many cells (CELLS), so that arrays don't grow with the number of
languages, but the work of a step grows with its square.

Defined cases: null texts and texts without a letter (no code point of Unicode category L) are `und` with score 0; ties go to the language that comes first
in order of code points; repeated rows are rows of their own; very long texts are read whole; with no training text
all are `und`; empty documents give an empty result; columns other than those named here are not read. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import _kernel as K
from kinfold.llm._base import table

NAME = "op3_language"
ORACLE_SQL = None
#: Bound of the training sample: documents of each language. Words of a chain in training.
SAMPLE, PIECE = 300, 120
DIMENSIONS = 1 << 15
LEXICON = 300
ROUNDS, RATE, PENALTY = 30, 0.5, 1e-4
#: Words whose features a task remembers at once.
REMEMBERED = 400_000
#: Documents whose chains run together; both numbers are less for many languages.
SLICE = 2048
#: Numbers (words times languages) of an array that chains or new words are worked out in.
CELLS = 1 << 21
#: Parts of a language's rows that are ordered on their own before the sample is taken from the firsts of all parts.
PARTS = 16
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Code points that the pattern takes though they are no letters (Unicode categories No and Nl): fractions, superscripts,
#: circled and Roman numbers.
_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha()) + "]")


def tokens(text: str) -> list[str]:
    """Runs of letters (Unicode categories L), in lower case."""
    found = _WORD.findall(text.lower())
    if found and not text.isascii() and not "".join(found).replace("'", "").replace("’", "").isalpha():
        found = _WORD.findall(_NUMBERS.sub(" ", text).lower())
    return found


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, number of each one's word) of all words at once, by words in order: the word, its length, its
    language in the lexicon, its affixes of 1 to 4 bytes and its n-grams of 2 and 3 bytes, with marks at both ends."""
    data = [f"^{w}$".encode() for w in words]
    size = np.array([len(d) for d in data])
    buf = np.frombuffer(b"".join(data), np.uint8)
    end = np.cumsum(size)
    start = end - size
    numbers = np.arange(len(words))
    found = [
        (K.name(buf, start, end), numbers),
        (np.minimum(size, 14).astype(np.uint64), numbers),
        (np.array([lexicon.get(w, -1) + 1 for w in words], np.uint64), numbers),
    ]
    for k in range(1, 5):
        found += [(K.name(buf, start, np.minimum(start + 1 + k, end)), numbers), (K.name(buf, np.maximum(end - 1 - k, start), end), numbers)]
    for n in (2, 3):
        count = np.maximum(size - n + 1, 0)
        found.append((K.names_of_length(buf, n)[K.spread(start, count)], np.repeat(numbers, count)))
    names = np.concatenate([K.mix(x ^ np.uint64(1 + i)) for i, (x, _) in enumerate(found)])
    owner = np.concatenate([o for _, o in found])
    order = np.argsort(owner, kind="stable")
    return (names[order] % np.uint64(DIMENSIONS)).astype(np.int64), owner[order]


class Model:
    """Learned languages, lexicon, emission weights (feature, language) and transition weights (from, to)."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
        self.transitions = np.zeros((len(languages), len(languages)))
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known, self.scores = {}, np.zeros((1024, len(self.languages)), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words, under which their scores are kept; each distinct word is worked out once while it is
        remembered."""
        known = self.known
        ids = list(map(known.get, words))
        if None in ids:
            new = [w for w in dict.fromkeys(words) if w not in known]
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            while first + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            step = max(64, CELLS // 4 // len(self.languages))
            for at in range(0, len(new), step):
                part = new[at : at + step]
                features, owner = word_features(part, self.lexicon)
                starts = np.searchsorted(owner, np.arange(len(part)))
                self.scores[first + at : first + at + len(part)] = np.add.reduceat(self.weights[features], starts)
            ids = list(map(known.get, words))
        return np.array(ids, np.int32)

    def forget(self) -> None:
        """Before a batch, if too many words are remembered; numbers given out before are void then."""
        if len(self.known) > REMEMBERED // max(1, len(self.languages) // 4):
            self.known.clear()


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (text, step, language) of padded emissions (text, step, language) in descending order of length, and
    the expected transitions (from, to)."""
    n, steps, k = emissions.shape
    emit = np.exp(emissions - emissions.max(2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead, back = np.zeros_like(emit), np.ones_like(emit)
    live = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than each step
    a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = a
    for t in range(1, steps):
        m = live[t]
        a = a[:m] @ move * emit[:m, t]
        a /= a.sum(1, keepdims=True)
        ahead[:m, t] = a
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        b = (back[:m, t + 1] * emit[:m, t + 1]) @ move.T
        back[:m, t] = b / b.sum(1, keepdims=True)
    post = ahead * back
    post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
    post *= (np.arange(steps)[None, :] < lengths[:, None])[:, :, None]
    expected = np.zeros((k, k))
    for t in range(1, steps):
        m = live[t]
        a, b = ahead[:m, t - 1], emit[:m, t] * back[:m, t]
        total = ((a @ move) * b).sum(1, keepdims=True)
        expected += move * ((a / np.maximum(total, 1e-300)).T @ b)
    return post, expected


def _groups(listed: list, lengths: np.ndarray, gold: np.ndarray, lexicon: dict[str, int]) -> list[tuple]:
    """Texts, longest first, in groups of bounded cells: (padded numbers of words within the group, lengths, languages,
    hashed features, the word of each)."""
    out, at, languages = [], 0, int(gold.max()) + 1
    while at < len(listed):
        to = at + max(1, CELLS // (int(lengths[at]) * languages))
        kinds: dict[str, int] = {}
        long = lengths[at:to]
        inside = np.arange(long[0])[None, :] < long[:, None]
        ids = np.zeros(inside.shape, np.int64)
        ids[inside] = [kinds.setdefault(w, len(kinds)) for words, _ in listed[at:to] for w in words]
        flat, owner = word_features(list(kinds), lexicon)
        out.append((ids, long, gold[at:to], flat, owner))
        at = to
    return out


def learn(texts: list[tuple[str, str]], rounds: int = ROUNDS) -> Model | None:
    """Model of (text, language) pairs: gradient ascent (AdaGrad) on the labels' likelihood."""
    listed = [(w[i : i + PIECE], lang) for text, lang in texts for w in [tokens(text)] for i in range(0, len(w), PIECE)]
    languages = sorted({lang for _, lang in listed})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    listed.sort(key=lambda x: -len(x[0]))
    lengths = np.array([len(w) for w, _ in listed])
    gold = np.array([number[lang] for _, lang in listed])
    kinds: dict[str, int] = {}
    flat_ids = np.array([kinds.setdefault(w, len(kinds)) for words, _ in listed for w in words])
    names, all_of = list(kinds), np.bincount(flat_ids)
    pairs, count = np.unique(flat_ids * len(languages) + np.repeat(gold, lengths), return_counts=True)
    # Frequent words of one language that are rare in the others.
    own: list[list[tuple[int, str]]] = [[] for _ in languages]
    for pair, n in zip(pairs.tolist(), count.tolist(), strict=True):
        if n >= 5 and n > 0.9 * all_of[pair // len(languages)]:
            own[pair % len(languages)].append((n, names[pair // len(languages)]))
    lexicon = {w: i for i, found in enumerate(own) for _, w in sorted(found, reverse=True)[:LEXICON]}
    model = Model(languages, lexicon)
    groups = _groups(listed, lengths, gold, lexicon)
    weights, total = np.zeros((DIMENSIONS, len(languages))), lengths.sum()
    seen, moved = np.full_like(weights, 1e-8), np.full_like(model.transitions, 1e-8)
    wanted = np.zeros_like(model.transitions)
    np.add.at(wanted, (gold, gold), lengths - 1.0)
    for _ in range(rounds):
        slope, expected = np.zeros_like(weights), np.zeros_like(wanted)
        for ids, long, right, flat, owner in groups:
            n = int(owner[-1]) + 1
            scores = np.zeros((n, len(languages)))
            for j in range(len(languages)):
                scores[:, j] = np.bincount(owner, weights[flat, j], n)
            post, moves = forward_backward(scores[ids], long, model.transitions)
            expected += moves
            error = -post
            error[np.arange(len(right)), :, right] += 1
            error *= (np.arange(ids.shape[1])[None, :] < long[:, None])[:, :, None]
            for j in range(len(languages)):
                by_kind = np.bincount(ids.ravel(), error[:, :, j].ravel(), n)
                slope[:, j] += np.bincount(flat, by_kind[owner], DIMENSIONS)
        slope = slope / total - PENALTY * weights
        seen += slope**2
        weights += RATE * slope / np.sqrt(seen)
        step = (wanted - expected) / total - 0.01 * model.transitions
        moved += step**2
        model.transitions += RATE / 2 * step / np.sqrt(moved)
    model.weights = weights.astype(np.float32)
    return model


def posteriors(model: Model, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Posteriors (word, language) of each text, given as numbers of its words. Texts of like length run together."""
    out: list[np.ndarray] = [np.zeros((0, len(model.languages)))] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest, to = len(texts[order[at]]), at + 1
        while to < len(order) and 2 * len(texts[order[to]]) >= longest and (to - at + 1) * longest <= CELLS // len(model.languages):
            to += 1
        group = order[at:to]
        lengths = np.array([len(texts[i]) for i in group])
        padded = np.zeros((len(group), longest, len(model.languages)), np.float32)
        padded[np.arange(longest)[None, :] < lengths[:, None]] = model.scores[np.concatenate([texts[i] for i in group])]
        post = _posteriors_only(padded, lengths, model.transitions)
        for row, i, n in zip(post, group, lengths.tolist(), strict=True):
            out[i] = row[:n]
        at = to
    return out


def _posteriors_only(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    n, steps, _ = emissions.shape
    emit = np.exp(emissions - emissions.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    move = np.exp(transitions - transitions.max()).astype(emit.dtype)
    live = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
    ahead = np.zeros_like(emit)
    a = emit[0] / emit[0].sum(1, keepdims=True)
    ahead[0] = a
    for t in range(1, steps):
        m = live[t]
        a = a[:m] @ move
        a *= emit[t, :m]
        a /= a.sum(1)[:, None]
        ahead[t, :m] = a
    b = np.ones_like(emit[0])
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        c = (b[:m] * emit[t + 1, :m]) @ move.T
        b[:m] = c / c.sum(1)[:, None]
        ahead[t, : live[t]] *= b[: live[t]]
    ahead /= np.maximum(ahead.sum(2, keepdims=True), 1e-30)
    return ahead.transpose(1, 0, 2)


def words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of a text."""
    found = tokens(text)
    post = posteriors(model, [model.numbers(found)])[0]
    return [(w, model.languages[p.argmax()], float(p.max())) for w, p in zip(found, post, strict=True)]


def _predict(model: Model | None):
    size = max(64, SLICE // max(1, len(model.languages) // 16)) if model is not None else SLICE

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1)
            for at in range(0, len(ids), size):
                part = texts.slice(at, size)
                langs, scores = ["und"] * len(part), [0.0] * len(part)
                if model is not None:
                    model.forget()
                    found = []
                    for i in range(0, len(part), 64):  # new words of several documents are worked out together
                        lists = [tokens(t.as_py() or "") for t in part.slice(i, 64)]
                        flat = model.numbers([w for own in lists for w in own])
                        found += np.split(flat, np.cumsum([len(x) for x in lists])[:-1])
                    for i, post in enumerate(posteriors(model, found)):
                        if len(post):
                            mean = post.mean(0, dtype=np.float64)
                            langs[i], scores[i] = model.languages[int(mean.argmax())], float(min(1.0, max(0.0, mean.max())))
                yield pa.RecordBatch.from_arrays([ids.slice(at, size), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, lang) of up to `sample` documents of each language: those with the smallest hash of their doc_id. Texts
    are read again only for the chosen ids."""
    docs = docs.where("doc_id is not null and lang is not null and text is not null")
    ranked = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    # All languages at once; the first rows of parts of a language, then of the language.
    for keys in (["lang", F.pmod("hash", F.lit(PARTS))], ["lang"]):
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))).where(F.col("place") <= sample)
    picked = docs.join(F.broadcast(ranked.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    # Of several rows of one id and language the least text counts, so the bound holds for rows too.
    rows = picked.groupBy("doc_id", "lang").agg(F.min(F.col("text").cast("string")).alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"]))]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learn(training_sample(docs.where(~held_out)))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
