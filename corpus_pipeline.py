"""Corpus preparation in five stages: quality, near duplicates, repeated passages, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the folder that the
cluster shares and reads it again as the next stage's docs. All stages but the last return the columns of documents.
Decisions are about rows, by the number that numbered() gives them, so neither null nor repeated ids lose other rows;
null and empty texts are rows like others; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import op2_decontamination, op4_mixing, op6_quality, op9_passages, op10_near_duplicates
from kinfold.llm._base import broadcast_if_small, numbered, stored, table

#: Near duplicates: words of a shingle, percent of similarity.
SHINGLE, PERCENT = 5, 80


#: The column that holds a row's number within a stage.
ROW = "kinfold_row"


def _asked(rows: DataFrame) -> DataFrame:
    """Numbered rows as documents whose id is that number."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered rows without those of gone(doc_id: their numbers)."""
    return rows.join(broadcast_if_small(gone.select(F.col("doc_id").alias(ROW)).distinct()), ROW, "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample takes."""
    rows, _ = numbered(docs, ROW)
    sample = op6_quality.resample(rows, table(spark, sf_dir, "labels"), row=ROW)
    return _without(rows, sample.where(~F.col("kept")).select(F.col("row").alias("doc_id"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies; of rows that agree in id and text one."""
    rows, own = numbered(docs, ROW)
    groups = op10_near_duplicates.near_duplicates(_asked(rows), size=SHINGLE, percent=PERCENT)
    return _without(rows if own else rows.dropDuplicates([ROW]), stored(groups.where(~F.col("kept")).select("doc_id"), "copies")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows the text."""
    out = op9_passages.strip_passages(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. One window is a leak, however long the text around it: the share
    of hit words, which op2's `contaminated` asks for, would let long documents carry test items into the corpus."""
    rows, _ = numbered(docs, ROW)
    found = op2_decontamination.decontaminate(_asked(rows), table(spark, sf_dir, "benchmark"))
    return _without(rows, stored(found.where("n_hit > 0").select("doc_id"), "leaks")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per repetition of a document, numbered by `repetition`."""
    return op4_mixing.repeated(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("leaks", leaks),
    ("mixture", mixture),
]

#: The importance sample has no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
