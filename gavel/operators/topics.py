"""Keywords by TF-IDF, and texts' n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.text import counted, texts_of
from gavel.plans.tables import checkpointed

#: Words that no keyword holds.
STOP_WORDS = ("the", "and", "for", "that", "this", "with", "from", "are", "was", "were", "has", "have", "had", "not", "but", "you", "all", "can", "her", "his", "one", "our", "out", "she", "their", "them", "they", "will", "would", "there", "been", "which", "who", "what", "when")


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term: one- and two-word terms of at least three ASCII letters a word, stop words taken out first."""
    return docs.select(key, F.explode(_terms(F.coalesce(text, F.lit("")))).alias("term"))


def _terms(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), 0), lambda w: ~w.isin(*STOP_WORDS))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.array(words), lambda w: F.concat(w, pairs(w)))[0]


#: Into how many buckets terms fall by their hash, and which share of the documents proposes terms for the bound. Results do not depend on either.
BUCKETS, PROPOSERS = 1 << 20, 64


def _commonest(tf: DataFrame, n_docs: int, max_df: float, features: int) -> DataFrame:
    """term, df, total: the features terms of the greatest totals that are in no more than max_df of the documents, ties by term; exact.

    The features-th best total of any fit terms, here those that some documents propose, is a bound: no term below it is chosen, nor one whose bucket, all
    terms of its hash together, is below it. So only sums of buckets and of terms in large buckets are shuffled, not every rare pair of words.
    """

    def fit(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        return sums.filter(F.col("df") <= max_df * n_docs).orderBy(F.desc("total"), "term").limit(features)

    proposed = tf.filter(F.pmod(F.xxhash64("key"), F.lit(PROPOSERS)) == 0).groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(2 * features).select("term")
    bound = fit(tf.join(F.broadcast(proposed), "term")).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()  # at most 2 * features rows
    if bound.n < features:  # few terms: no bound
        return fit(tf)
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    large = tf.groupBy(bucket.alias("bucket")).agg(F.sum("tf").alias("total")).filter(F.col("total") >= bound.least).select("bucket")  # at most BUCKETS rows
    return fit(tf.withColumn("bucket", bucket).join(F.broadcast(large), "bucket"))


def keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 5, max_df: float = 0.8, features: int = 5000) -> DataFrame:
    """key, term, weight, rank: each document's best terms by TF-IDF with smooth idf and unit length.

    Terms in more than max_df of the documents are left out, then the vocabulary is cut to the commonest features terms, ties by term. A document's terms are
    counted in its row and written once; what is shuffled is the sums of _commonest, and the rows of the vocabulary's terms.
    """
    each = texts_of(docs, key, text).select(key, F.explode(counted(F.flatten(F.transform("texts", _terms)))).alias("t"))
    tf = checkpointed(each.select(F.col(key).alias("key"), F.col("t.value").alias("term"), F.col("t.n").alias("tf")))
    n_docs = docs.count()
    chosen = _commonest(tf, n_docs, max_df, features)
    vocabulary = checkpointed(chosen.select("term", F.row_number().over(Window.orderBy("term")).alias("no"), (F.ln((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")))  # at most features rows
    numbered = tf.join(F.broadcast(vocabulary.select("term", "no")), "term").select(F.col("key").alias(key), "no", "tf").repartition(key)  # numbers in place of terms are shuffled
    weighted = numbered.join(F.broadcast(vocabulary), "no").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    scored = weighted.select(key, "term", F.round(F.col("w") / length, 6).alias("weight"))
    best = Window.partitionBy(key).orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
