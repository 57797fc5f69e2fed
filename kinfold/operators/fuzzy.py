"""Fuzzy duplicates: blocking, pair scores, connected components.

Within a block all pairs are compared (that is the operator's meaning), so a large block is cut into cells: its records
fall into k parts, and the pairs of parts i and j are one cell, dealt to a task of its own. Every pair meets in one
cell only. Conditions on lengths and on the characters' signatures that any pair at the threshold meets are tested in the
join, before the score; Levenshtein distances stop at the threshold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.errors import ConfigurationError
from kinfold.functions.normalize import normalizer
from kinfold.functions.similarity import SCORERS, bound, scored, signature
from kinfold.operators.components import components
from kinfold.operators.exact import _checked
from kinfold.operators.storage import stored

#: Records of one part of a block.
PART = 512


def keys(df: DataFrame, id_col: str, fields, kinds: Mapping[str, str] | None = None, use_normalized: bool = True, unicode: bool = True) -> DataFrame:
    """record_id and the values joined by a space."""
    _checked(df, fields)
    kinds = kinds or {}
    parts = [normalizer(kinds.get(f, "text_aggressive"), "text_aggressive")(F.col(f"`{f}`"), unicode) if use_normalized else F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    return df.select(F.col(f"`{id_col}`").alias("record_id"), F.trim(F.concat_ws(" ", *parts)).alias("key"))


def blocked(keyed: DataFrame, max_comparisons: int = 100_000, blocking: str = "auto") -> DataFrame:
    """record_id, key, block; empty keys are dropped. blocking: `all` makes one block, so that all pairs are compared;
    `prefix` makes blocks of equal first two characters and tens of length, so that pairs across blocks are never seen,
    however alike; `auto` is `all` if there are max_comparisons pairs at most, else `prefix`. The keys are stored, so that
    they are normalized once: count, filter and block would each repeat their expressions."""
    if blocking not in ("auto", "all", "prefix"):
        raise ConfigurationError(f"unknown blocking: {blocking!r}")
    keyed = stored(keyed, "keys")
    if blocking == "auto":
        n = keyed.count()
        blocking = "all" if n * (n - 1) // 2 <= max_comparisons else "prefix"
    block = F.lit("all") if blocking == "all" else F.concat_ws("_", F.lower(F.substring("key", 1, 2)), F.floor(F.length("key") / 10).cast("string"))
    return keyed.where("key != ''").withColumn("block", block)


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Records and pairs of each block: what a run will compare."""
    n = F.count(F.lit(1))
    return blocks.groupBy("block").agg(n.alias("records"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def classes(blocks: DataFrame) -> DataFrame:
    """Records of equal keys as one: record_id (the smallest), key, block, n. Equal keys score 100 under every
    algorithm, so only distinct keys need to be compared."""
    return blocks.groupBy("block", "key").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n"))


def pairs(blocks: DataFrame, algorithm: str = "WRatio", threshold: float = 80.0, part: int = PART) -> DataFrame:
    """(a, b, score) of all pairs of a block at or above the threshold, a < b."""
    if algorithm not in SCORERS:
        raise ConfigurationError(f"unknown algorithm: {algorithm!r}", known=sorted(SCORERS))
    if not 0 <= threshold <= 100:
        raise ConfigurationError("the threshold must be from 0 to 100")
    sizes = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("k"))
    # Small in bytes, large in work: adaptive execution must not put the keys or the cells together.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = blocks.repartition(tasks, "record_id").withColumn("m", signature(F.col("key"))).join(sizes, "block").withColumn("r", F.pmod(F.xxhash64("record_id"), F.col("k")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("block", F.least("r", "other").alias("i"), F.greatest("r", "other").alias("j"), "r", "record_id", "key", F.length("key").alias("n"), "m")
    cells = cells.repartition(tasks, "block", "i", "j")
    x, y = cells.alias("x"), cells.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("block", "i", "j")]
    once = (F.col("x.r") != F.col("y.r")) | (F.col("x.i") == F.col("x.j"))
    on = same[0] & same[1] & same[2] & once & (F.col("x.record_id") < F.col("y.record_id"))
    cheap = bound(algorithm, "x", "y", threshold)
    on = on & cheap if cheap is not None else on
    score = scored(algorithm, F.col("x.key"), F.col("y.key"), threshold)
    # A later filter would be pushed ahead of the bounds, and every pair scored.
    met = x.join(y, on & (score >= threshold) if algorithm == "levenshtein" else on)
    links = met.select(F.col("x.record_id").alias("a"), F.col("y.record_id").alias("b"), score.alias("score"))
    return links if algorithm == "levenshtein" else links.where(F.col("score") >= threshold)


def grouped(blocks: DataFrame, algorithm: str = "WRatio", threshold: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of all records linked at or above the threshold, over any number of links. A group's score is
    the mean over its linked pairs of records, to one place (half to even); pairs of records are counted, not made."""
    kinds = stored(classes(blocks), "classes")
    links = stored(pairs(kinds, algorithm, threshold), "scored")
    linked = components(links)
    own = kinds.join(linked.withColumnRenamed("id", "record_id"), "record_id", "left").withColumn("group_id", F.coalesce("component", "record_id"))
    own = stored(own.where("component is not null or n > 1").select("block", "key", "record_id", "group_id", "n"), "linked")
    within = own.groupBy("group_id").agg(F.sum("n").alias("group_size"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    n = own.select("record_id", "n", "group_id")
    between = links.join(n.select(F.col("record_id").alias("a"), F.col("n").alias("na"), "group_id"), "a").join(n.select(F.col("record_id").alias("b"), F.col("n").alias("nb")), "b")
    between = between.groupBy("group_id").agg(F.sum(F.col("na") * F.col("nb") * F.col("score")).alias("total"), F.sum(F.col("na") * F.col("nb")).alias("links"))
    mean = (F.coalesce("total", F.lit(0.0)) + F.col("pairs") * 100.0) / (F.coalesce("links", F.lit(0)) + F.col("pairs"))
    found = within.join(between, "group_id", "left").select("group_id", "group_size", F.bround(mean, 1).alias("similarity_score"), F.lit("fuzzy").alias("detection_method"), F.lit("flag").alias("recommended_action"))
    members = blocks.join(own.select("block", "key", "group_id"), ["block", "key"]).select("group_id", "record_id")
    return found, members


def find(df: DataFrame, id_col: str, fields, threshold: float = 80.0, algorithm: str = "WRatio", kinds: Mapping[str, str] | None = None, use_normalized: bool = True, max_comparisons: int = 100_000, unicode: bool = True, blocking: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(groups, members) of fuzzy duplicates."""
    return grouped(blocked(keys(df, id_col, fields, kinds, use_normalized, unicode), max_comparisons, blocking), algorithm, threshold)


def statistics(found: DataFrame) -> DataFrame:
    """One row about groups and their scores."""
    n, s = F.col("group_size"), F.col("similarity_score")
    edges = [(90, 101), (80, 90), (70, 80), (60, 70), (-1, 60)]
    names = ["score_90_100", "score_80_90", "score_70_80", "score_60_70", "score_below_60"]
    return found.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_records"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_size"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_size"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_similarity"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max_similarity"),
        F.coalesce(F.min(s), F.lit(0.0)).alias("min_similarity"),
        *[F.count_if((s >= low) & (s < high)).alias(name) for (low, high), name in zip(edges, names, strict=True)],
    )


def combined(exact_groups: DataFrame, fuzzy_groups: DataFrame, exact_members: DataFrame | None = None, fuzzy_members: DataFrame | None = None) -> DataFrame:
    """Both lists of groups. Given both memberships, fuzzy groups that are exact groups as a whole are left out."""
    columns = ["group_id", "group_size", "similarity_score", "detection_method", "recommended_action"]
    if exact_members is not None and fuzzy_members is not None:
        known = fuzzy_members.join(exact_members.select("record_id", F.col("group_id").alias("e")), "record_id", "left")
        whole = known.groupBy("group_id").agg(F.count_distinct("e").alias("kinds"), F.count_if(F.col("e").isNull()).alias("new")).where("kinds = 1 and new = 0")
        fuzzy_groups = fuzzy_groups.join(whole, "group_id", "left_anti")
    return exact_groups.select(*columns).unionByName(fuzzy_groups.select(*columns))


def text_summary(found: DataFrame) -> str:
    s = statistics(found).first()
    return f"{s['total_groups']} groups of {s['total_records']} records, similarity {s['min_similarity']:.1f} to {s['max_similarity']:.1f} ({s['avg_similarity']:.1f} on average)"
