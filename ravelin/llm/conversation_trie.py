"""The prefix trie of rebuilt conversations, by collapsing whole sequences first.

Conversations that share turns are rebuilt, equal ones collapse into one
weighted sequence with the list of those that end there, and only then are
prefixes made, one for each turn of a different sequence:

  places     the place of each turn, a running count over (conv_id, turn)
  prefixes   a prefix is named by its depth and sums of its turns' hashes (each
             with its place), which are running totals too, over the slices of
             the places: a conversation with most of all turns lies in many of
             them, and no task holds it
  sequences  conversations of equal last prefix are one, with weight and ends
  leaves     sequences that are no proper prefix of another, by an anti-join
  nodes      sums over the weighted prefixes that share a name

No level of the trie waits for another. A sequence owns the nodes of which it
is the least member; those are the end of its path, so what the nodes below any
node weigh once is known from where the sequences through it begin to own.

Texts are hashed where they are read and never shuffled. A turn's name is half
a SHA-256 of role and text, a prefix's name has 128 bits of sums.

Defined cases: null roles and texts are empty. Turns are ordered by turn, null
first, then by the hash of role and text; so the order of repeated rows does
not matter. Rows without conv_id belong to no conversation. An empty table has
no node, not even the root. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.running import running_totals
from ravelin.llm.scratch import drop, table

#: conversations up to GROUP - 1 after one that divides by it borrow its first turns, fewer than MOST of them.
GROUP, MOST = 5, 9
#: Of m rows fewer than HOT share a value with more than m / HOT others each, so a table of such values is broadcast.
HOT = 4096
#: A piece of a list of ends holds those of at most so many neighbouring conv_ids (rounded down to a power of two).
CHUNK = 1 << 12
SUMS = ("k1", "k2", "k3", "k4")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, name (of role and text) and n_bytes (of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.left(name, F.lit(32))).alias("name"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return rows.where("conv_id IS NOT NULL")


def borrows(conv_id: Column) -> Column:
    """How many first turns a conversation would take from another."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST


def by_slice(rows: DataFrame, info: DataFrame) -> DataFrame:
    """rows with info (one row for each conv_id), joined by slice too, so that a conversation's rows do not meet in one task."""
    pairs = rows.select("slice", "conv_id").distinct().join(info, "conv_id")
    return rows.join(pairs, ["slice", "conv_id"])


def rebuilt(rows: DataFrame) -> DataFrame:
    """slice, conv_id, depth, name and n_bytes of every turn of the rebuilt conversations, and of their empty starts (depth 0).

    rows: turns(). Conversation c begins with the first borrows(c) turns of
    c - c % GROUP, and goes on with its own after as many. Its own turns stay
    in the slices in which they were counted; the borrowed ones, fewer than
    MOST, are the slice before them.
    """
    placed = table(
        running_totals(rows.withColumn("one", F.lit(1)), ["conv_id"], ["turn", "name"], ["one"], keep_slice=True, nulls=False).drop("turn", "one"), "places"
    )
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    lenders = sizes.select(F.col("conv_id").alias("lender"), "size")
    takers = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lender"))
    takes = takers.join(lenders, "lender", "left").select(
        "conv_id", "lender", F.least(borrows(F.col("conv_id")), F.coalesce("size", F.lit(0))).alias("taken")
    )
    takes = table(takes.where(F.col("conv_id") != F.col("lender")), "takes")
    first = placed.where(F.col("before_one") < MOST - 1).select(F.col("conv_id").alias("lender"), "before_one", "name", "n_bytes")
    begun = takes.where("taken > 0").join(first, "lender").where("before_one < taken")
    own = placed.where((F.col("conv_id") % GROUP != 0) & (F.col("before_one") >= borrows(F.col("conv_id"))))
    depth = F.col("before_one") + 1
    return (
        placed.where(F.col("conv_id") % GROUP == 0).select("slice", "conv_id", depth.alias("depth"), "name", "n_bytes")
        .unionByName(placed.where("before_one = 0").select(F.lit(-1).alias("slice"), "conv_id", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("name"), F.lit(0).alias("n_bytes")))
        .unionByName(begun.select(F.lit(-1).alias("slice"), "conv_id", depth.alias("depth"), "name", "n_bytes"))
        .unionByName(by_slice(own, takes).select("slice", "conv_id", (depth - borrows(F.col("conv_id")) + F.col("taken")).alias("depth"), "name", "n_bytes"))
        .repartition("slice", "conv_id")
    )


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.left(F.sha2(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary"), 256), F.lit(32)))


def prefixes(sequence_rows: DataFrame) -> DataFrame:
    """slice, conv_id, depth, node, parent (of the empty one null), n_bytes and before_n_bytes of every prefix. sequence_rows: rebuilt()."""
    low = F.lit(0xFFFFFFFF)
    pieces = {}
    for i, seed in enumerate((1, 2)):
        h = F.xxhash64(F.lit(seed), F.col("depth"), F.col("name"))
        h = F.when(F.col("depth") > 0, h).otherwise(0)
        pieces |= {SUMS[2 * i]: F.shiftrightunsigned(h, 32), SUMS[2 * i + 1]: h.bitwiseAND(low)}
    summed = running_totals(sequence_rows.withColumns(pieces).drop("name"), ["conv_id"], ["depth"], [*SUMS, "n_bytes"], keep_slice=True, nulls=False, sliced=True)
    own = [F.col(f"before_{k}") + F.col(k) for k in SUMS]
    above = [F.col(f"before_{k}") for k in SUMS]
    return summed.select(
        F.col("slice").cast("int").alias("slice"), "conv_id", F.col("depth").cast("long").alias("depth"), _node(F.col("depth"), own).alias("node"),
        F.when(F.col("depth") > 0, _node(F.col("depth") - 1, above)).alias("parent"), F.col("n_bytes").cast("long").alias("n_bytes"),
        F.col("before_n_bytes").cast("long").alias("before_n_bytes"),
    )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and conv_id, as one row for each node; a list is hashed as its pieces come."""
    names = ["node", "depth", "total", "conv_id", "weight", "ends_sha256"]
    now, digest, weight = None, None, 0

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        done = []
        for *head, n, ids in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if now is not None and head[0] == now[0]:
                digest.update(b"," + ids.encode())
                weight += n
                continue
            if now is not None:
                done.append((*now, weight, digest.hexdigest()))
            now, digest, weight = head, hashlib.sha256(ids.encode()), n
        if done:
            yield told(done)
    if now is not None:
        yield told([(*now, weight, digest.hexdigest())])


def sequences(rows: DataFrame) -> DataFrame:
    """The different sequences: node, depth and total (bytes) of the whole one, its least conv_id, weight, and ends_sha256.

    rows: prefixes(). Each list is cut into pieces of neighbouring conv_ids, so
    that one of any length passes through memory piece by piece.
    """
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last"), F.sum("n_bytes").alias("total"))
    ends = last.select("last.node", "last.depth", "total", "conv_id", F.shiftright("conv_id", CHUNK.bit_length() - 1).alias("piece"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ends.groupBy("node", "piece").agg(
        F.max("depth").alias("depth"), F.max("total").alias("total"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), ids.alias("ids")
    ).drop("piece")
    kinds = "node binary, depth long, total long, conv_id long, weight long, ends_sha256 string"
    return pieces.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, kinds)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, and node and parent,
    the names of the node and its parent.
    """
    rows = table(turns(conversations), "turns")
    sequence_rows = rebuilt(rows)
    every = table(prefixes(sequence_rows), "prefixes")
    whole = table(sequences(every), "sequences")
    paths = by_slice(every, whole.select("conv_id", "weight", "total", F.col("depth").alias("length")))
    paths = table(paths, "weighted_prefixes")
    drop(rows, every)
    # leaves, and where each sequence begins to own nodes
    inner = paths.where("depth < length").select("node").distinct()
    leaves = whole.join(inner, "node", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owners = paths.groupBy("node").agg(F.min(F.struct("conv_id", "depth", "before_n_bytes")).alias("first"))
    owned = owners.groupBy("first.conv_id").agg(F.min(F.struct("first.depth", "first.before_n_bytes")).alias("owned"))
    info = whole.select("conv_id").join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
    known = by_slice(paths, table(info, "owned"))
    below = F.col("total") - F.col("before_n_bytes")
    once = F.when(F.col("owned").isNull(), 0).when(F.col("depth") >= F.col("owned.depth"), below).otherwise(F.col("total") - F.col("owned.before_n_bytes"))
    nodes = known.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("weight").alias("n_convs"),
        F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * below - once).cast("long").alias("saved_tokens"),
    )
    nodes = table(nodes, "nodes")
    drop(paths)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = table(
        nodes.join(children, "node", "left").join(whole.select("node", "ends_sha256"), "node", "left"), "trie"
    ).withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))})
    return _with_parents(nodes)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id; parents of very many children are broadcast, fewer than HOT."""
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    hot = F.col("siblings") * HOT > nodes.count()
    out = nodes.join(F.broadcast(above.where(hot).drop("siblings")), "parent", "left")
    rest = out.where("parent IS NOT NULL AND parent_conv_id IS NULL").drop("parent_conv_id").join(above.where(~hot).drop("siblings"), "parent")
    out = out.where("parent IS NULL OR parent_conv_id IS NOT NULL").unionByName(rest)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent")
    return out.select(*columns)
