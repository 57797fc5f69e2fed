"""Document fingerprints: a Merkle tree over paragraphs and sections, with DataFrame functions only.

A text is cut into sections after blank lines and into paragraphs after line ends; a paragraph is cut further after
the marks that end its sentences and, within a sentence, after every PIECE code points, which gives the leaves. A
leaf's digest is the SHA-256 of its text, a paragraph's that of its leaves' digests, a section's that of its
paragraphs', the root that of the sections'. The parts cover every code point, so equal texts have equal trees and
equal roots mean equal texts. Walking down from two roots, only branches that differ are opened, and they end at the
leaves that were edited: differing_leaves() does that.

Serialised form (`fingerprint`): the root in hex, `/`, then the sections parted by `;`: the first 16 hex digits of
the section's digest, `:`, and its paragraphs parted by `,`, each the first 8 digits of its leaves' digests.
Likeness of two fingerprints: 2 * shared / all over their distinct leaf prefixes; 1 for equal fingerprints.

Defined cases: a null text is an empty one, and an empty text has no leaves; rows with equal doc_id are ordered by
text, descending; ids are whole numbers, and null ids come last in descending order; a single row is its own next
document; very long texts are fingerprinted whole; an empty table gives an empty result; columns other than those
selected here are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm._base import partitions, table, text_or_empty

NAME = "op1_fingerprints"
PIECE = 64
#: Ranges of the id for each shuffle partition, so that the ranges spread evenly.
RANGES = 4


def _paragraph(text: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(text, F.lit(rf"([^.!?\n]{{1,{PIECE}}}[.!?\n]*|[.!?\n]+)"), F.lit(1)), lambda x: F.sha2(x, 256))
    return F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("digest"), F.transform(leaves, lambda x: F.substring(x, 1, 8)).alias("leaves"))


def _section(text: Column) -> Column:
    paragraphs = F.transform(F.split(text, r"(?<=\n)(?!\n)"), _paragraph)
    return F.struct(
        F.sha2(F.array_join(F.transform(paragraphs, lambda p: p["digest"]), ""), 256).alias("digest"),
        F.transform(paragraphs, lambda p: p["leaves"]).alias("paragraphs"),
    )


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with `name`, the serialised tree of text, and `name`_leaves, its distinct leaf prefixes."""
    df = df.withColumn(f"{name}_tree", F.transform(F.split(text, r"(?<=\n\n)(?!\n)"), _section))
    sections = F.col(f"{name}_tree")
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ""), 256)
    body = F.transform(sections, lambda s: F.concat(F.substring(s["digest"], 1, 16), F.lit(":"), F.array_join(F.transform(s["paragraphs"], lambda p: F.array_join(p, "")), ",")))
    leaves = F.array_distinct(F.flatten(F.flatten(F.transform(sections, lambda s: s["paragraphs"]))))
    return df.withColumns({name: F.concat(root, F.lit("/"), F.array_join(body, ";")), f"{name}_leaves": leaves}).drop(f"{name}_tree")


def likeness(a: str, b: str) -> Column:
    """Of the fingerprints named a and b that with_fingerprint has made."""
    x, y = F.col(f"{a}_leaves"), F.col(f"{b}_leaves")
    shared = F.size(F.array_intersect(x, y))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(2.0) * shared / F.greatest(F.size(x) + F.size(y), F.lit(1)))


def differing_leaves(a: str, b: str) -> Column:
    """Places struct(section, paragraph, leaf), from 0, of the leaves of fingerprint a that fingerprint b lacks at the
    same place. Sections and paragraphs that are equal are not opened."""

    def sections(name: str) -> Column:
        return F.split(F.element_at(F.split(F.col(name), "/"), 2), ";")

    def paragraphs(section: Column) -> Column:
        return F.split(F.element_at(F.split(section, ":"), 2), ",")

    def leaves(paragraph: Column) -> Column:
        return F.regexp_extract_all(paragraph, F.lit("(.{8})"), F.lit(1))

    def in_paragraph(p: Column, other: Column, i: Column, j: Column) -> Column:
        places = F.transform(leaves(p), lambda leaf, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf"), leaf.alias("digest")))
        return F.when(p == other, F.slice(places, 1, 0)).otherwise(F.filter(places, lambda x: ~F.coalesce(F.get(leaves(other), x["leaf"]) == x["digest"], F.lit(False))))

    def in_section(s: Column, i: Column) -> Column:
        other = F.coalesce(F.get(sections(b), i), F.lit("-:"))
        found = F.flatten(F.transform(paragraphs(s), lambda p, j: in_paragraph(p, F.coalesce(F.get(paragraphs(other), j), F.lit("")), i, j)))
        return F.when(s == other, F.slice(found, 1, 0)).otherwise(found)

    return F.transform(F.flatten(F.transform(sections(a), in_section)), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph"), x["leaf"].alias("leaf")))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) with next_text, the text of the row that follows in descending doc_id; after the last row
    comes the first.

    Ids are cut at their quantiles into ranges, each a window; a mark at the end of each range carries the text that
    opens the next one. So texts are shuffled once, and no window holds more than its share of the rows."""
    ranges = ranges or RANGES * partitions(docs.sparkSession)
    quantiles = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", quantiles, F.lit(10 * ranges))).first()[0] or []))
    array, steps = F.array(*[F.lit(int(x)) for x in cuts]).cast("array<bigint>"), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    # Binary search: how many of the cuts are not above the id. Null ids belong to the lowest range.
    place = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(array, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at),
    )
    rows = docs.select("doc_id", text_or_empty().alias("text"), (place if cuts else F.lit(0)).alias("range"))
    highest = rows.groupBy("range").agg(F.max("doc_id").alias("head_id"))
    # As many rows as ranges, of three numbers.
    heads = rows.join(F.broadcast(highest.withColumnRenamed("range", "head_range")), (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    heads = heads.groupBy("range").agg(F.max("text").alias("text"))
    # The order of the ranges is found from their numbers alone; the texts follow by a join.
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = highest.select("range", F.coalesce(F.lead("range").over(down), F.first("range").over(whole)).alias("next_range"))
    marks = heads.withColumnRenamed("range", "next_range").join(F.broadcast(after), "next_range")
    marks = marks.select(F.lit(None).cast("bigint").alias("doc_id"), "text", "range", F.lit(1).alias("mark"))
    order = Window.partitionBy("range").orderBy("mark", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    both = rows.withColumn("mark", F.lit(0)).unionByName(marks)
    return both.withColumn("next_text", F.lead("text").over(order)).where("mark = 0").select("doc_id", "text", "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        docs = with_fingerprint(docs, F.col(text), name)
    return docs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


#: Sections and paragraphs are parted at a control code that is set after line ends.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx FROM d),
e AS (SELECT *, length(t) AS n, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM o),
v AS (SELECT DISTINCT x FROM (SELECT t AS x FROM e UNION ALL SELECT ed FROM e)),
s AS (SELECT x, list_transform(string_split(regexp_replace(x, '(\n\n+)', '\1' || chr(30), 'g'), chr(30)),
  lambda c: list_transform(string_split(regexp_replace(c, '(\n+)', '\1' || chr(30), 'g'), chr(30)),
  lambda p: list_transform(regexp_extract_all(p, '[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+'), lambda l: sha256(l)))) AS tree FROM v),
g AS (SELECT x, tree, list_transform(tree, lambda c: sha256(array_to_string(list_transform(c, lambda p: sha256(array_to_string(p, ''))), ''))) AS digests FROM s),
f AS (SELECT x, sha256(array_to_string(digests, '')) || '/' || array_to_string(list_transform(tree,
    lambda c, i: substr(digests[i], 1, 16) || ':' || array_to_string(list_transform(c, lambda p: array_to_string(list_transform(p, lambda l: substr(l, 1, 8)), '')), ',')), ';') AS fp,
  list_distinct(list_transform(flatten(flatten(tree)), lambda l: substr(l, 1, 8))) AS leaves FROM g)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.ed) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN a.fp = b.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, b.leaves)) / greatest(len(a.leaves) + len(b.leaves), 1) END AS near_edited,
  CASE WHEN a.fp = c.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, c.leaves)) / greatest(len(a.leaves) + len(c.leaves), 1) END AS near_next
FROM e JOIN f a ON a.x = e.t JOIN f b ON b.x = e.ed JOIN f c ON c.x = e.nx
"""
