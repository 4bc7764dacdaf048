"""Token counts from an exact length histogram (operator 3).

Documents are encoded once and counted by their length in tokens. Suffix sums
over the distinct lengths then answer, for every context limit L that is a
length in the corpus: how many documents have at least L tokens, how many tokens
they hold, the total if each document is truncated to L, and which share of
documents is no longer than L (so quantiles are read off).

Defined results: null and empty texts have length 0; repeated rows count each
time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut

#: Lengths are summed in blocks of so many, then the blocks, so that no window spans the whole histogram.
BLOCK = 512


def length_histogram(df: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """length, docs: how many texts have each length."""
    return bpe.token_lengths(df, ranks, text).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each distinct length as context limit: docs, docs_ge, tokens_ge, total_tokens, truncated_tokens, share_le.

    The histogram, a row for each distinct length, is written down, as two sides of a join read it.
    """
    h = cut(histogram).withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("docs_after", F.coalesce(F.sum("block_docs").over(later), F.lit(0))).withColumn("tokens_after", F.coalesce(F.sum("block_tokens").over(later), F.lit(0)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("all_docs", F.sum("block_docs").over(every)).withColumn("total_tokens", F.sum("block_tokens").over(every)).drop("block_docs", "block_tokens")
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumn("docs_in", F.sum("docs").over(within)).withColumn("tokens_in", F.sum("tokens").over(within)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("docs_in") + F.col("docs_after"), F.col("tokens_in") + F.col("tokens_after")
    return out.select(
        "length",
        "docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        "total_tokens",
        (F.col("total_tokens") - tokens_ge + docs_ge * F.col("length")).alias("truncated_tokens"),
        F.round((F.col("all_docs") - docs_ge + F.col("docs")) / F.col("all_docs"), 9).alias("share_le"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed."""
    return limits.filter(F.col("share_le") >= q).agg(F.min("length").alias("length"))
