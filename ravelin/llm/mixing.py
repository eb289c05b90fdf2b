"""Mixing sources to target weights.

The mix's size is `share` times that of all documents, in words. Each source
gets a part by its weight, up to `most` times its own size; what goes beyond
is shared out again by weight. So a target is the lesser of that limit and its
weight times one level, and the level follows from a running sum over the
sources in the order in which they reach their limits.

Documents get a hash-random key, are range-sorted within their source, and
distributed prefix sums of their sizes tell where the budget ends: all whole
epochs that fit, then documents in key order until the budget, the last one in
part. So a source takes exactly its target, rounded down to whole words, and
the same rows give the same mix on every run and any cluster.

Defined cases: a null text has size 0. A null source is a source, the last. A
row with size 0 takes 0 words. Rows that share a doc_id are rows of their own;
equal keys are ordered by doc_id and size. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.running import running_totals
from ravelin.llm.scratch import table, unused

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size and target. Works on one row for each source."""
    everything = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("long").alias("weight"), place.alias("place"))
    limit = F.col("source_size") * most
    reach = Window.orderBy(limit / F.col("weight"), "place")
    per = per.select(
        "*",
        limit.alias("limit"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("all"),
        F.coalesce(F.sum(limit).over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        F.row_number().over(reach).alias("turn"),
    )
    fits = F.col("weight") * (F.col("all") - F.col("full")) / F.col("open") <= F.col("limit")
    per = per.select("*", F.min(F.when(fits, F.struct("turn", "full", "open"))).over(everything).alias("level"))
    level = F.col("weight") * (F.col("all") - F.col("level.full")) / F.col("level.open")
    target = F.when(F.col("turn") < F.col("level.turn"), F.col("limit").cast("double")).otherwise(level)
    return per.select("source", "source_size", target.alias("target"))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.xxhash64("text"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and row_key for each row of docs.

    taken counts words, repeats included. copies is the number of whole
    copies of the row that stand for it: a part of at least half counts.
    row_key is a hash of its doc_id, source and text.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    sizes = table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), row_key().alias("row_key")), "sizes")
    targets = table(source_targets(sizes, weights, share, most), "targets")
    placed = running_totals(sizes, ["source"], ["key", F.col("doc_id").asc_nulls_last(), "size"], ["size"])
    both = placed.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    budget = F.floor("t.target")
    epochs = F.when(F.col("t.source_size") > 0, F.expr("floor(t.target) div t.source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("t.source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_size")))
    more = (part * 2 >= F.col("size")) & (F.col("before_size") < rest)
    return both.select(
        "doc_id",
        "size",
        "t.source_size",
        "t.target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        (epochs + more.cast("int")).cast("int").alias("copies"),
        "row_key",
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() says. Rows equal in doc_id, source and text share their copies out evenly."""
    key, total, alike, number = (unused(docs, c) for c in ("row_key", "total_copies", "rows_alike", "row_number"))
    copies = mix(docs, **options).groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(alike))
    keyed = docs.withColumn(key, row_key()).join(copies.where(F.col(total) > 0), key)
    placed = keyed.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    times = F.floor(F.col(total) / F.col(alike)) + (F.col(number) <= F.col(total) % F.col(alike)).cast("int")
    return placed.withColumn(total, times).where(F.col(total) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total)))).select(*docs.columns)
