"""Benchmark decontamination with a distributed positional inverted index, with DataFrame functions only.

Index: one posting (term, row, position) for every training token, written as a table in the shared folder, with a
closing posting a document that holds its number of words. index() without terms stores all of them, to be kept and
asked by any test set; decontaminate(), which asks once, stores the postings of its test set's terms only, as no other
can be part of a match. Each test phrase is looked up from its two rarest terms, counted in the index: the postings of
the rarest, moved back by its offset, give the places where the phrase could start; those of the second rarest, moved
by its own offset, are intersected with them; the places left are then intersected with the postings of all other
terms, and an exact match is one at which every offset was found. proximity() does the same for terms within a window.

Skew: a very common term is read only for phrases that have no rarer one; the joins are on (row, start), which
spreads a common phrase over its documents. A document's matches are joined into covered words by running sums.

Defined cases: null or wordless texts have no words and are not contaminated; very long texts are indexed whole; repeated rows, also with equal doc_id,
are indexed as rows of their own; an empty benchmark hits nothing; an item of fewer words than the window, but not
none, is one phrase; empty documents give an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm._base import LOWER, UPPER, broadcast_if_small, stored, table

NAME = "op2_decontamination"
WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word can be this term: it has a space. It closes a document in the index.
END = " end"


def words(text: str = "text") -> Column:
    """The words of a text, in order; none for null. Only A-Z change case."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items(item_id, text) -> (item_id, phrase): every window of the item, or its words if fewer."""
    listed = items.select("item_id", words().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("phrase")).distinct()


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term_id, row, doc_id, pos) of the terms (term, term_id) in docs(doc_id, text); term_id -1 closes a
    row, at the number of its words. Without terms, of every token: (term, row, doc_id, pos)."""
    listed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(words(), F.array(F.lit(END))).alias("w"))
    exploded = listed.select("doc_id", "row", F.posexplode("w").alias("pos", "term"))
    return exploded if terms is None else known(exploded, terms)


def known(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Of postings by term those of the terms (term, term_id), by their numbers."""
    vocabulary = terms.select("term", "term_id").unionByName(postings.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("long").alias("term_id")))
    return postings.join(broadcast_if_small(vocabulary), "term").select("term_id", "row", "doc_id", "pos")


def _plan(test: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """test(phrase_id, phrase) -> (phrase_id, n, off, term_id, rarity): rarity 1 is the phrase's rarest term; terms
    that the index lacks have null frequency, and their phrases are left out."""
    # Numbers and frequencies of the test set's terms are small next to its phrases, where a common term has many rows.
    frequency = stored(postings.where("term_id >= 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("freq")), "term-counts")
    listed = test.select("phrase_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("off", "term"))
    listed = listed.join(broadcast_if_small(terms), "term").join(broadcast_if_small(frequency), "term_id", "left")
    by = Window.partitionBy("phrase_id")
    listed = listed.withColumn("lacking", F.max(F.col("freq").isNull().cast("int")).over(by)).where("lacking = 0")
    return listed.withColumn("rarity", F.row_number().over(by.orderBy("freq", "term_id", "off"))).select("phrase_id", "n", "off", "term_id", "rarity")


def exact_matches(test: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Places (phrase_id, n, row, start) at which the phrases of test(phrase_id, phrase) occur."""
    plan = stored(_plan(test, postings, terms), "phrase-plan")
    first, second = (plan.where(F.col("rarity") == k).select("phrase_id", "n", "off", "term_id") for k in (1, 2))

    def starts(wanted: DataFrame) -> DataFrame:
        return postings.join(broadcast_if_small(wanted), "term_id").select("phrase_id", "n", "row", (F.col("pos") - F.col("off")).alias("start"))

    begun = starts(first).where("start >= 0")
    short = begun.where("n = 1")
    # Only rows that hold a place for the rarest term are read for the second one.
    both = stored(begun.where("n > 1").join(starts(second).select("phrase_id", "row", "start"), ["phrase_id", "row", "start"], "left_semi").unionByName(short), "phrase-starts")
    wanted = both.join(broadcast_if_small(plan.where("rarity > 2").select("phrase_id", "off", "term_id")), "phrase_id").select("phrase_id", "n", "row", "start", "term_id", (F.col("start") + F.col("off")).alias("pos"))
    rows = broadcast_if_small(both.select("row").distinct())
    near = postings.where("term_id >= 0").join(rows, "row", "left_semi").select("row", "pos", "term_id")
    full = wanted.join(near, ["row", "pos", "term_id"]).groupBy("phrase_id", "n", "row", "start").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == F.col("n") - 2)
    return full.select("phrase_id", "n", "row", "start").unionByName(both.where("n <= 2").select("phrase_id", "n", "row", "start"))


def proximity(test: DataFrame, postings: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """(phrase_id, row, pos): places of a phrase's rarest term around which all its distinct terms occur within so
    many words to either side."""
    plan = _plan(test, postings, terms)
    rare = plan.where("rarity = 1").select("phrase_id", "term_id")
    needed = plan.select("phrase_id", "term_id").distinct()
    count = needed.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("needed"))
    places = postings.join(rare, "term_id").select("phrase_id", "row", "pos", F.explode(F.sequence(F.floor((F.col("pos") - within) / (2 * within + 1)), F.floor((F.col("pos") + within) / (2 * within + 1)))).alias("cell"))
    others = postings.join(needed, "term_id").select("phrase_id", "row", F.col("pos").alias("at"), "term_id", F.floor(F.col("pos") / (2 * within + 1)).alias("cell"))
    met = places.join(others, ["phrase_id", "row", "cell"]).where(F.abs(F.col("at") - F.col("pos")) <= within)
    return met.groupBy("phrase_id", "row", "pos").agg(F.count_distinct("term_id").alias("met")).join(count, "phrase_id").where("met = needed").select("phrase_id", "row", "pos")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, postings: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> a row per document: row, doc_id, n_words, n_hit, n_items,
    item_ids (sorted strings, comma-joined) and contaminated. postings: a stored index(docs) of all tokens."""
    listed = phrases(items, window)
    # Distinct phrases and terms are numbered where they are, without one order of all; the tables hold the numbers.
    test = stored(listed.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    keyed = listed.join(test, "phrase").select("item_id", "phrase_id")
    terms = stored(test.select(F.explode("phrase").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    postings = stored(index(docs, terms) if postings is None else known(postings, terms), "postings")
    found = stored(exact_matches(test.select("phrase_id", "phrase"), postings, terms), "matches")
    order = Window.partitionBy("row").orderBy("start", "end")
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    spans = spans.withColumn("covered", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))).cast("long").alias("n_hit"))
    named = found.select("row", "phrase_id").distinct().join(keyed.select("phrase_id", F.col("item_id").cast("string").alias("item_id")), "phrase_id").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"))
    ended = postings.where("term_id = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = ended.join(hit.join(named, "row"), "row", "left").fillna({"n_hit": 0, "n_items": 0, "item_ids": ""})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
ph AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS p FROM bs),
lens AS (SELECT DISTINCT n FROM ph),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
dp AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM ds),
m AS (SELECT doc_id, dp.n, i, item_id FROM dp JOIN ph ON dp.p = ph.p AND dp.n = ph.n),
c AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY 1),
k AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
