"""Line dedup over hashes, in DataFrame operations only.

A line's key is the line without white space (space, tab to carriage return)
at its ends and with A-Z lower-cased. Keys of at least `min_chars` code points
that several documents hold lose all their lines except in the smallest
doc_id that holds them.

The method: every long enough line becomes a 128-bit hash with its document
and position. Hashes are range-partitioned and sorted by hash, document and
position, and the first document of each hash streams down the sorted rows.
A hash that holds more than one in `HOT_SHARE` of all lines would make one
range too long; there are at most `HOT_SHARE` such hashes, so their first
documents come from a pre-aggregated minimum and go to the lines by a
broadcast of at most that many rows. What comes back is no text but the
compressed keep bitmap of each document that loses a line. A bitmap has words
of 64 lines, a set bit for a line that stays; it is stored as runs, each a
number of words that are all ones and then one word that is not, and all words
after the last run are ones. So it grows with the words that lose a line, not
with the document. A document without a row keeps all its lines.

Defined cases: a null or empty text is one empty line. A null doc_id counts
as larger than any other. Rows that share a doc_id are one document. Columns
of the input other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.scratch import table

#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash is hot if it has more than a HOT_SHARE-th of all lines, and more than HOT_LEAST.
HOT_SHARE, HOT_LEAST = 4096, 1000


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and all else as it is (`lower` is that for pure ASCII, and faster)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """A row for each line with a long enough key: doc_id, text_hash, n_lines, pos, h1, h2."""
    lines = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        split_lines(F.col("text")).alias("lines"),
    ).select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "n_lines", "pos", F.trim("line", F.lit(BLANKS)).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_chars).withColumn("key", lower_ascii(F.col("key")))
    return keyed.select(
        "doc_id", "text_hash", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_hash, n_dropped and the compressed keep bitmap (runs) of each document that loses a line.

    text_hash tells rows of one doc_id with different texts apart.
    """
    lines = table(line_hashes(docs, min_chars), "lines")
    most = max(HOT_LEAST, lines.count() // HOT_SHARE)
    hot = (
        lines.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n") > most)
        .drop("n")
    )
    marked = lines.join(F.broadcast(table(hot.withColumn("hot", F.lit(True)), "hot_lines")), ["h1", "h2"], "left")
    of_hash = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    streamed = (
        marked.where(F.col("hot").isNull())
        .drop("first_doc", "hot")
        .repartitionByRange("h1", "h2")
        .withColumn("first_doc", F.first("doc_id").over(of_hash.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    later = F.col("doc_id").isNull() & F.col("first_doc").isNotNull() | (F.col("doc_id") > F.col("first_doc"))
    dropped = streamed.where(later).unionByName(marked.where("hot").drop("hot").where(later))
    words = (
        dropped.repartition("doc_id", "text_hash")
        .groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    )
    before = F.lag("word", 1, -1).over(Window.partitionBy("doc_id", "text_hash").orderBy("word"))
    run = F.struct("word", (F.col("word") - before - 1).alias("whole"), F.bitwise_not("bits").alias("keep"))
    per_doc = words.withColumn("run", run).groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list("run")).alias("runs")
    )
    bare = F.transform("runs", lambda r: F.struct(r["whole"].alias("whole"), r["keep"].alias("keep")))
    return per_doc.select("doc_id", "text_hash", "n_dropped", bare.alias("runs"))


def unpacked(runs: Column) -> Column:
    """A bitmap's words up to its last run's; all after them are ones."""
    ones = F.lit(-1).cast("long")
    return F.flatten(F.transform(runs, lambda r: F.concat(F.array_repeat(ones, r["whole"]), F.array(r["keep"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' doc_id, n_lines, n_dropped and kept text, after keep_bitmaps' result."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("t")
    maps = bitmaps.withColumn("keep", unpacked(F.col("runs"))).drop("runs").alias("b")
    same = F.col("t.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t.text_hash") == F.col("b.text_hash"))
    both = texts.join(maps, same, "left")
    lines = split_lines(F.col("t.text"))
    word = lambda i: F.coalesce(F.get("b.keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))
    stays = F.filter(lines, lambda _, i: word(i).bitwiseAND(bit(i)) != 0)
    return both.select(
        F.col("t.doc_id").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("b.keep").isNull(), F.coalesce("t.text", F.lit(""))).otherwise(F.array_join(stays, "\n")).alias("text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays of every row of docs."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
