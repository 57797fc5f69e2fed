"""Mixing sources to target weights by capped water-filling.

A source's target is weight * level, but at most `max_epochs` times its size; the level is the one at which the
targets sum to the wanted total. Sources reach their caps in the order of cap / weight, so the level is found with
running sums over the sources in that order: clamping and re-sharing until nothing is above its cap gives the same
level. A source then takes floor(target / size) whole repetitions of each of its documents and a seeded sample of a
further, fractional one: documents in the order of a salted SHA-256 until the target is used up. The document at
which it is used up gives only its first words, so what a source takes is its target, rounded.

No source meets in one task: the order within a source is cut at the first hex digits of the digest, sums are taken
for each cut (bounded number), and only the cut that holds the end of the sample is ordered row by row.

Defined cases: null or blank text has size 0 and takes 0; very long texts count whole; a null source is a source, last in order; a repeated row is
a document of its own (rows that are equal in the digest are ordered by size and text, and are interchangeable);
an empty table gives an empty result; extra columns pass through mix(), its own columns start with `mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm._base import WORD, broadcast_if_small, stored, table

NAME = "op4_mixing"
CUT_DIGITS = 4


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes: (mix_source, mix_source_size), a row per source. Adds mix_weight and mix_target.

    The windows here run over sources, not documents.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("mix_source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("mix_ratio", F.col("mix_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    weighed = (
        sizes.withColumn("mix_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("mix_cap", F.lit(float(max_epochs)) * F.col("mix_source_size"))
        .withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_weight"))
    )
    total = F.lit(float(share)) * F.sum("mix_source_size").over(everything)
    # The level if exactly the sources before this one are clamped; the true one is the first not above its own ratio.
    level = (total - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / (F.sum("mix_weight").over(everything) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0.0)))
    found = weighed.withColumn("mix_try", level).withColumn("mix_level", F.min(F.when(F.col("mix_try") <= F.col("mix_ratio"), F.struct("mix_ratio", "mix_try"))).over(everything)["mix_try"])
    target = F.when(F.col("mix_level").isNull(), F.col("mix_cap")).otherwise(F.least(F.col("mix_cap"), F.col("mix_weight") * F.col("mix_level")))
    return found.select("mix_source", "mix_source_size", "mix_weight", target.alias("mix_target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """docs(doc_id, text, source, ...) with mix_size, mix_source_size, mix_target, mix_whole (whole repetitions) and
    mix_extra (words of one more, 0 or up to mix_size)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    sized = docs.withColumn("mix_size", word_count()).withColumn("mix_digest", digest)
    cut = F.substring("mix_digest", 1, CUT_DIGITS)
    slim = sized.select(F.col("source").alias("mix_source"), cut.alias("mix_cut"), "mix_size")
    cuts = slim.groupBy("mix_source", "mix_cut").agg(F.sum("mix_size").alias("mix_cut_size"))
    sources = source_targets(cuts.groupBy("mix_source").agg(F.sum("mix_cut_size").alias("mix_source_size")), weights, max_epochs, share)
    wanted = F.round("mix_target").cast("long")
    whole = F.when(F.col("mix_source_size") > 0, F.floor(wanted / F.col("mix_source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("mix_whole_all", whole).withColumn("mix_left", F.when(F.col("mix_source_size") > 0, wanted - F.col("mix_whole_all") * F.col("mix_source_size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("mix_source").orderBy("mix_cut").rowsBetween(Window.unboundedPreceding, -1)
    placed = cuts.withColumn("mix_before", F.coalesce(F.sum("mix_cut_size").over(order), F.lit(0))).withColumnRenamed("mix_source", "mix_s")
    edge = sources.join(placed, F.col("mix_source").eqNullSafe(F.col("mix_s"))).where((F.col("mix_before") <= F.col("mix_left")) & (F.col("mix_left") < F.col("mix_before") + F.col("mix_cut_size")))
    edge = edge.select(F.col("mix_s").alias("mix_edge_source"), F.col("mix_cut").alias("mix_edge"), (F.col("mix_left") - F.col("mix_before")).alias("mix_edge_left"))
    plan = stored(sources.join(edge, F.col("mix_source").eqNullSafe(F.col("mix_edge_source")), "left").drop("mix_edge_source"), "mixture-plan")
    # A row per source: few if a mixture lists them by name, many if they are hosts.
    joined = sized.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    inside = F.col("mix_edge").isNull() | (cut < F.col("mix_edge"))
    clear = joined.where(~F.coalesce(cut == F.col("mix_edge"), F.lit(False)))
    clear = clear.withColumn("mix_extra", F.when(inside & (F.col("mix_left") > 0), F.col("mix_size")).otherwise(F.lit(0)).cast("long"))
    at_edge = joined.where(cut == F.col("mix_edge"))
    running = Window.partitionBy("source").orderBy("mix_digest", "mix_size", "text").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("mix_size").over(running), F.lit(0))
    at_edge = at_edge.withColumn("mix_extra", F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("mix_edge_left") - used)).cast("long"))
    out = clear.unionByName(at_edge)
    return out.withColumn("mix_whole", F.col("mix_whole_all")).drop("mix_digest", "mix_edge", "mix_edge_left", "mix_left", "mix_whole_all", "mix_weight")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: a row per repetition, with `repetition` counting from 1; a fractional one has the first
    words of the text only."""
    columns = docs.columns
    mixed = mix(docs, **options)
    times = F.col("mix_whole") + F.when(F.col("mix_extra") > 0, 1).otherwise(0)
    rows = mixed.where((times > 0) & (F.col("mix_size") > 0)).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col("repetition") > F.col("mix_whole")) & (F.col("mix_extra") < F.col("mix_size"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("mix_extra"), F.lit(1)).cast("int")), " ")
    return rows.withColumn("text", F.when(part, first).otherwise(F.col("text"))).select(*columns, "repetition")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_whole") * F.col("mix_size") + F.col("mix_extra")).cast("long").alias("taken"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         sha256('0:' || coalesce(doc_id::VARCHAR, '')) AS digest, text
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
v AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS lv
      FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lv, ratio) AS level FROM v WHERE lv <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM v, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, round(p.target)::BIGINT - p.whole * p.source_size AS remainder,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.size, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, remainder - used)))::BIGINT AS taken FROM q
"""
