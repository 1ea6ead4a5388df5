"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; everything else follows from suffix sums over the
distinct lengths: totals, quantiles, and the tokens left when every document is cut at a context
limit (documents shorter than the limit keep all, each of the others keeps the limit).

Scale: a task folds its documents to (length, documents) before the shuffle, so what is shuffled is
bounded by the distinct lengths of a task, and no length, however common, grows a group. Suffix
sums are taken per stretch of lengths and then over the stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.bpe import encoded
from arrears.llm.common import stash

STRETCH = 1024


def encoded_lengths(docs: DataFrame, ranks_file: str, text: str = "text") -> DataFrame:
    """Histogram (length, n_docs) of the encoded lengths of all rows; null text counts as empty."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for _, _, at in encoded(batch.column(0), ranks_file):
                for length, n in zip(*np.unique(np.diff(at), return_counts=True)):
                    seen[int(length)] = seen.get(int(length), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())],
                                         ["length", "n"])

    return (docs.select(F.col(text)).mapInArrow(fold, "length long, n long")
            .groupBy("length").agg(F.sum("n").alias("n_docs")))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least, tokens_at_least, truncated_tokens and share_up_to.

    ``truncated_tokens`` is the corpus' total if every document is cut at ``length`` tokens,
    ``share_up_to`` the share of documents of at most that length. Empty input: no rows.
    """
    hist = histogram.withColumn("stretch", F.floor(F.col("length") / STRETCH)) \
        .withColumn("n_tokens", F.col("n_docs") * F.col("length"))
    later = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per 1024 lengths: bounded by the longest document
    above = (hist.groupBy("stretch").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
             .select("stretch", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_above"),
                     F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_above")))
    total = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    within = Window.partitionBy("stretch").orderBy(F.desc("length"))
    return (hist.withColumn("one", F.lit(1)).join(above, "stretch").join(total.withColumn("one", F.lit(1)), "one")
            .withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("docs_above"))
            .withColumn("tokens_at_least", F.sum("n_tokens").over(within) + F.col("tokens_above"))
            .select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
                    (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
                    .alias("truncated_tokens"),
                    ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs"))
                    .alias("share_up_to")))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Corpus totals for each context limit: limit, docs_cut, tokens_kept (one pass, a column each)."""
    length, n = F.col("length"), F.col("n_docs")
    cells = [F.struct(F.lit(x).cast("long").alias("limit"),
                      F.coalesce(F.sum(F.when(length > x, n)), F.lit(0)).alias("docs_cut"),
                      F.coalesce(F.sum(F.least(length, F.lit(x)) * n), F.lit(0)).alias("tokens_kept"))
             for x in limits]
    return sums.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed (one row)."""
    return sums.where(F.col("share_up_to") >= share).agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, ranks_file: str) -> DataFrame:
    """Length histogram of ``docs(text)`` with its suffix sums, one row per distinct length."""
    return with_suffix_sums(stash(encoded_lengths(docs, ranks_file)))
