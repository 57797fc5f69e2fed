"""String similarity from 0 to 100.

ratio is the normalized insert-delete similarity, 200 * LCS / (len + len), with the LCS found bit-parallel on whole
words of Python's integers; the others are its variants over tokens and parts. They run as vectorised functions over
Arrow batches; levenshtein runs in the JVM. ratio_sql is the same ratio from higher-order functions, kept to check
the kernel inside the engine.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        met = row & places.get(ch, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def partial(a: str, b: str, cutoff: float = 0.0) -> float:
    """The shorter text against every window of the longer one of its length, and shorter ones at the ends; of texts of
    one length, either against the other. 0 if the longest common subsequence of the whole texts already rules the
    cutoff out."""
    if len(a) == len(b):
        return max(_windows(a, b, cutoff), _windows(b, a, cutoff))
    return _windows(a, b, cutoff) if len(a) < len(b) else _windows(b, a, cutoff)


def _windows(short: str, long: str, cutoff: float) -> float:
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    if cutoff:
        common = lcs(short, long)
        if 200.0 * common < cutoff * (n + common):
            return 0.0
    known = set(short)
    best = 0.0
    for i in range(1 - n, len(long)):
        window = long[max(i, 0) : i + n]
        # The best window ends or begins with a character of the shorter text.
        if window[-1] in known or window[0] in known:
            best = max(best, indel(short, window))
    return best


def _joined(tokens) -> str:
    return " ".join(sorted(tokens))


def token_sort(a: str, b: str, score: Callable = indel) -> float:
    return score(_joined(a.split()), _joined(b.split()))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = _joined(x & y), _joined(x - y), _joined(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = indel(with_x, with_y)
    return max(best, indel(both, with_x), indel(both, with_y)) if both else best


def partial_token(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(token_sort(a, b, partial), partial(_joined(x), _joined(y)))


def weighted(a: str, b: str) -> float:
    """The best of the ratios, each scaled for how far the lengths differ."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = indel(a, b)
    if spread < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def _vectorised(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def levenshtein(a: Column, b: Column) -> Column:
    """100 * (1 - distance / longer length), in the JVM."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100.0)).otherwise(F.lit(100.0) * (longer - F.levenshtein(a, b)) / F.greatest(longer, F.lit(1)))


def ratio_sql(a: Column, b: Column) -> Column:
    """ratio by rows of the LCS table, with higher-order functions only."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def row(old: Column, ch: Column) -> Column:
        # new[j] = greatest(new[j - 1], old[j], old[j - 1] + 1 if b[j] == ch)
        steps = F.zip_with(chars(b), F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0))), lambda x, j: F.struct(x.alias("x"), j.alias("j")))
        return F.aggregate(
            steps,
            F.array(F.lit(0)),
            lambda new, s: F.concat(new, F.array(F.greatest(F.element_at(new, -1), F.get(old, s["j"] + 1), F.when(s["x"] == ch, F.get(old, s["j"]) + 1).otherwise(F.lit(0))))),
        )

    first = F.array_repeat(F.lit(0), F.length(b) + 1)
    last = F.aggregate(chars(a), first, row)
    total = F.length(a) + F.length(b)
    common = F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(last, -1))
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common / F.greatest(total, F.lit(1)))


SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "ratio": _vectorised(indel),
    "partial_ratio": _vectorised(partial),
    "token_sort_ratio": _vectorised(token_sort),
    "token_set_ratio": _vectorised(token_set),
    "WRatio": _vectorised(weighted),
    "levenshtein": levenshtein,
}


def scored(algorithm: str, a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """The score; where it is below the cutoff, it may be given as 0 without being worked out."""
    if algorithm == "partial_ratio" and cutoff:
        return _vectorised(lambda x, y: partial(x, y, cutoff))(a, b)
    if algorithm == "levenshtein" and cutoff:
        longer = F.greatest(F.length(a), F.length(b))
        # With a limit for each pair the JVM works out a band of the table only, and gives up (-1) beyond it.
        distance = F.call_function("levenshtein", a, b, F.floor(longer * F.lit((100.0 - cutoff) / 100.0) + F.lit(1e-6)).cast("int"))
        return F.when(longer == 0, F.lit(100.0)).when(distance < 0, F.lit(0.0)).otherwise(F.lit(100.0) * (longer - distance) / F.greatest(longer, F.lit(1)))
    return SCORERS[algorithm](a, b)


#: Groups of characters in a signature: two bits each.
GROUPS = 31


def signature(key: Column) -> Column:
    """62 bits about the characters of a key but its white space: of each group of code points whether one occurs, and
    whether two do. An inserted or deleted character changes one bit at most, a replaced one two."""
    groups = F.transform(F.filter(F.split(F.regexp_replace(key, r"[\s\x1c-\x1f\x85\p{Z}]+", ""), ""), lambda x: x != ""), lambda x: F.pmod(F.ascii(x), F.lit(GROUPS)))
    ordered = F.array_sort(groups)
    again = F.filter(ordered, lambda x, i: (i > 0) & (F.get(ordered, i - 1) == x))
    bits = F.concat(F.array_distinct(ordered), F.transform(F.array_distinct(again), lambda x: x + F.lit(GROUPS)))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda mask, x: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x)))


def bound(algorithm: str, x: str, y: str, threshold: float) -> Column | None:
    """A cheap condition that every pair at or above the threshold meets, on columns n (length of the key) and m (its
    signature) of the frames x and y; None where neither bounds the score."""
    if threshold <= 0:
        return None
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    shorter, longer = F.least(a, b), F.greatest(a, b)
    bits = F.bit_count(F.col(f"{x}.m").bitwiseXOR(F.col(f"{y}.m")))
    away = F.lit(100.0 - threshold)
    if algorithm == "levenshtein":  # distance * 100 <= away * longer
        return (F.lit(100.0) * (longer - shorter) <= away * longer + F.lit(1e-6)) & (F.lit(50.0) * bits <= away * longer + F.lit(1e-6))
    if algorithm == "ratio":  # insertions and deletions * 100 <= away * (a + b)
        return (F.lit(100.0) * (longer - shorter) <= away * (a + b) + F.lit(1e-6)) & (F.lit(100.0) * bits <= away * (a + b) + F.lit(1e-6))
    if algorithm == "token_sort_ratio":  # the sorted tokens have the key's characters, but for white space
        return F.lit(100.0) * bits <= away * (a + b) + F.lit(1e-6)
    return None
