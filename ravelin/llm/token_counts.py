"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their number of token ids; suffix sums over the
histogram then answer, for every context limit, how many documents and ids
there are in all, how many documents exceed the limit, and how many ids stay
if longer documents are cut at it: `at_limits` for any limits, `quantiles` for
any shares, both from the stored histogram without encoding again. Encoding gives one number for each
text, the histogram one row for each length, and both sums are distributed
running totals, so nothing grows in one place.

Defined cases: a null or empty text has length 0. Rows that share a doc_id
count each. An empty table has an empty histogram, no quantiles, and zeros at
every limit. Limits and shares are returned once each, in any order; a null
limit or one below 0 counts as 0, a share outside 0 to 1 as the nearer end. Only the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.running import running_totals
from ravelin.llm.tokens import Encoder


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens of every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, _ in Encoder.of(tokenizer).encode(batch.column("text"), ids_too=False):
                yield pa.RecordBatch.from_arrays([pa.array(counts)], ["n_tokens"])

    return docs.select("text").mapInArrow(work, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each length that occurs.

    n_tokens, n_docs; all_docs and all_tokens of the whole table; docs_within
    (as long or shorter), docs_beyond (longer), tokens_within, and
    truncated_tokens (the sum of min(length, n_tokens)); quantile, the share
    of documents within.
    """
    histogram = encoded_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    histogram = histogram.withColumn("sum_tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = running_totals(histogram, [], ["n_tokens"], ["n_docs", "sum_tokens"])
    all_docs, all_tokens = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("sum_tokens"), F.lit(0))).first()
    within = F.col("before_n_docs") + F.col("n_docs")
    beyond = F.lit(all_docs) - within
    return sums.select(
        "n_tokens",
        "n_docs",
        F.lit(all_docs).cast("long").alias("all_docs"),
        F.lit(all_tokens).cast("long").alias("all_tokens"),
        within.alias("docs_within"),
        beyond.alias("docs_beyond"),
        (F.col("before_sum_tokens") + F.col("sum_tokens")).alias("tokens_within"),
        (F.col("before_sum_tokens") + F.col("sum_tokens") + beyond * F.col("n_tokens")).alias("truncated_tokens"),
        (within / F.lit(all_docs)).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_within, docs_beyond, tokens_within and truncated_tokens for any context limits, of length_histogram's result.

    All limits are answered in one pass: each is a conditional sum, so that no row of the histogram meets a row for each limit.
    """
    asked = sorted({max(0, limit or 0) for limit in limits})
    docs, tokens = F.col("n_docs"), F.col("n_docs") * F.col("n_tokens")

    def total(what: Column, among: Column) -> Column:
        return F.coalesce(F.sum(F.when(among, what)), F.lit(0)).cast("long")

    def answer(limit: int) -> Column:
        within = F.col("n_tokens") <= limit
        beyond, kept = total(docs, ~within), total(tokens, within)
        return F.struct(
            F.lit(limit).cast("long").alias("limit"),
            total(docs, within).alias("docs_within"),
            beyond.alias("docs_beyond"),
            kept.alias("tokens_within"),
            (kept + beyond * limit).alias("truncated_tokens"),
        )

    return histogram.agg(F.array(*map(answer, asked)).alias("all")).select(F.inline("all"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least that share of the documents do not exceed, exactly, of length_histogram's result."""
    asked = sorted({min(1.0, max(0.0, float(share))) for share in shares})
    reached = [F.min(F.when(F.col("docs_within") >= F.ceil(F.lit(s) * F.col("all_docs")), F.col("n_tokens"))) for s in asked]
    answers = [F.struct(F.lit(s).alias("share"), least.alias("n_tokens")) for s, least in zip(asked, reached, strict=True)]
    return histogram.agg(F.array(*answers).alias("all")).select(F.inline("all")).where("n_tokens IS NOT NULL")
