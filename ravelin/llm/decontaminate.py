"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are words (lower-cased A-Z, split at white space), each a 64-bit hash.
A mask picks some of neighbouring word positions and ignores others, so that
its hash is the same whatever stands in the ignored ones. The hashes of all
masks at all positions of the benchmark and of the documents are joined; each
hit fixes an alignment of an item with a document, and the aligned words are
then compared one by one. An item overlaps a document if in some stretch of
WINDOW aligned words (all of a shorter item) at least LEAST of them agree.

The masks find every such stretch of 13 words: with two of them substituted
there are either 5 unchanged words in a row or the pattern 1111?1. Shorter
items have masks by their length (`masks_of`): up to four words must all agree and are
one seed, five to nine allow one other word, ten to twelve two. Documents
are looked through by the masks of those lengths only that the benchmark has.

Documents meet the distinct benchmark hashes first, in a semi-join that
discards all but hits. Its benchmark side is broadcast only if counted to be
at most `max_broadcast` hashes of 8 bytes; beyond that it is a shuffled join.
Everything after works on hits alone.

Defined cases: null and empty texts have no words and no overlap. Equal items are
compared once and each gets the rows. Rows that share doc_id and text are one
document; rows that share a doc_id only are compared each by its own text. A
null doc_id is returned as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.line_dedup import lower_ascii
from ravelin.llm.scratch import table, unused

#: Word positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 5, 6))
#: Those of items under 13 words: whole items of one to four words, and four of five words.
SHORT_MASKS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
ALL_MASKS = MASKS + SHORT_MASKS
#: Words in a stretch, and the share of them that must agree.
WINDOW, LEAST = 13, 0.8
BLANK = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """The words of text as an array of hashes."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BLANK, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(n_words: int) -> tuple[int, ...]:
    """Places in ALL_MASKS of the masks that find an item of n_words with every substitution allowed."""
    if n_words < 5:
        return (2 + n_words,) if n_words else ()
    if n_words < 10:
        return (6, 7, 8, 9) if n_words == 5 else (6, 8)
    return (0, 1, 2, 6, 8) if n_words < 12 else (0, 1, 2)


def seeds(rows: DataFrame, *keys: str, masks: dict[int, Column | None]) -> DataFrame:
    """keys, pos and h for masks (places in ALL_MASKS, each with the condition that rows must meet) at every position of rows' `words`."""
    def of_mask(number: int, only: Column | None) -> Column:
        mask = ALL_MASKS[number]
        span = mask[-1] + 1
        hashed = F.transform(
            F.sequence(F.lit(0), F.size("words") - span),
            lambda i: F.xxhash64(F.lit(number), *(F.get("words", i + o) for o in mask)),
        )
        fits = F.size("words") >= span
        return F.when(fits if only is None else fits & only, hashed).otherwise(F.array().cast("array<bigint>"))

    at_each = [of_mask(number, only) for number, only in sorted(masks.items(), key=lambda m: m[0])]
    nested = rows.select(*keys, F.posexplode(F.array(*at_each)).alias("mask", "hashes"))
    return nested.select(*keys, F.posexplode("hashes").alias("pos", "h"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, item_hash, first_word, matched and item_words of every alignment that overlaps, and the items."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words"))
    items = table(items.withColumn("item_hash", F.xxhash64("words")), "items")
    distinct = items.dropDuplicates(["item_hash"]).select("item_hash", "words")
    lengths = {r[0] for r in distinct.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect()}  # 14 at most
    uses = {m: [n for n in lengths if m in masks_of(n)] for m in sorted({m for n in lengths for m in masks_of(n)} or {0})}
    of_length = {m: F.least(F.size("words"), F.lit(WINDOW)).isin(ns) for m, ns in uses.items()}
    item_seeds = table(seeds(distinct, "item_hash", masks=of_length), "item_seeds")
    wanted = table(item_seeds.select("h").distinct(), "item_hashes")
    if wanted.count() <= max_broadcast:
        wanted = F.broadcast(wanted)

    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("words"))
    hits = table(seeds(worded, "doc_id", "text_hash", masks=dict.fromkeys(uses)).join(wanted, "h", "left_semi"), "hits")
    alignments = (
        hits.withColumnRenamed("pos", "doc_pos")
        .join(item_seeds.withColumnRenamed("pos", "item_pos"), "h")
        .select("doc_id", "text_hash", "item_hash", (F.col("doc_pos") - F.col("item_pos")).alias("first_word"))
    )
    # whole items of one to four words agree wherever they are hit: the first place stands for all
    place = F.when(F.size("words") >= 5, F.col("first_word"))
    alignments = alignments.join(distinct, "item_hash").groupBy("doc_id", "text_hash", "item_hash", place.alias("place")).agg(
        F.min("first_word").alias("first_word")
    ) if lengths & {1, 2, 3, 4} else alignments.distinct()
    # an item's words come once for a document, however many alignments; those are fewer than both's words together
    per_item = alignments.groupBy("doc_id", "text_hash", "item_hash").agg(F.collect_set("first_word").alias("places"))
    compared = per_item.join(distinct.withColumnRenamed("words", "item_words"), "item_hash")
    per_doc = table(
        compared.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_hash", "places", "item_words")).alias("found")),
        "alignments",
    ).alias("a")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.text_hash") == F.col("a.text_hash"))
    both = texts.join(per_doc.hint("shuffle_hash"), same).select("d.doc_id", "d.text_hash", word_hashes(F.col("d.text")).alias("words"), F.col("a.found").alias("found"))

    def dense(agree: Column, n: Column) -> Column:
        stretch = F.least(n, F.lit(WINDOW))
        return F.exists(
            F.sequence(F.lit(1), n - stretch + 1),
            lambda s: F.aggregate(F.slice(agree, s, stretch), F.lit(0), lambda a, x: a + x) >= F.ceil(stretch * F.lit(LEAST)),
        )

    def best(c: Column) -> Column:
        """matched and first_word (as its negative) of the best alignment that overlaps; null if none does."""
        n = F.size(c["item_words"])

        def judged(place: Column) -> Column:
            agree = F.transform(c["item_words"], lambda w, i: F.coalesce((F.get("words", place + i) == w).cast("int"), F.lit(0)))
            matched = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
            return F.get(F.transform(F.array(agree), lambda a: F.when(dense(a, n), F.struct(matched(a).alias("matched"), (-place).alias("back")))), 0)

        return F.struct(c["item_hash"].alias("item_hash"), n.alias("item_words"), F.array_max(F.transform(c["places"], judged)).alias("b"))

    each = both.select("doc_id", "text_hash", F.explode(F.transform("found", best)).alias("f")).where("f.b is not null")
    return each.select("doc_id", "text_hash", "f.item_hash", (-F.col("f.b.back")).alias("first_word"), F.col("f.b.matched").alias("matched"), "f.item_words"), items


def overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, first_word (of the item's place in the document, from 0; negative if cut off), matched and item_words of every overlap."""
    each, items = _overlaps(docs, benchmark, max_broadcast)
    best = each.groupBy("doc_id", "item_hash").agg(F.max(F.struct("matched", (-F.col("first_word")).alias("back"), "item_words")).alias("b"))
    return best.join(items.select("item_id", "item_hash"), "item_hash").select(
        "doc_id", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.matched").alias("matched"), F.col("b.item_words").alias("item_words")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, by_text: bool = False, max_broadcast: int = 1_000_000) -> DataFrame:
    """docs without those that overlap an item.

    by_text: only rows whose own text overlaps go. Otherwise all rows of such a
    row's doc_id go, and rows without a doc_id stay only if no such row overlaps.
    """
    leaked, its_text = unused(docs, "leaked"), unused(docs, "leaked_text")
    if not by_text:
        found = overlaps(docs, benchmark, max_broadcast).select(F.col("doc_id").alias(leaked)).distinct()
        return docs.join(table(found, "leaked"), F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")
    found = _overlaps(docs, benchmark, max_broadcast)[0].select(F.col("doc_id").alias(leaked), F.col("text_hash").alias(its_text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(leaked)) & (F.xxhash64("text") == F.col(its_text))
    return docs.join(table(found, "leaked"), same, "left_anti")
