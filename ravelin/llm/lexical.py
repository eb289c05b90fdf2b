"""Ranked lexical search: the best documents for each of many items, by a tree of documents and branch and bound.

A document is the vector of its terms that any item has, with how often each
occurs (tf). Terms are ordered by how many documents hold them, the most
frequent first, so documents that begin with the same frequent terms share a
path of an FP-tree. Of the documents below a node the tree keeps the greatest
tf of each term and the least m (from a document's length); a score grows with
tf and falls with m, so they bound every score below the node. Items go down
the tree depth first: a node whose bound is below an item's k-th best score so
far is not entered by that item, and equal bounds are, because of ties.

Passes over the documents:

  vectors   each whole text is read once: its number of terms, and its vector
  counts    N, L and every term's df, as sums
  search    each task makes trees of its own documents, block by block, and goes
            on with the k-th best scores that it has; k rows an item leave it

No document is shuffled. Items are taken in blocks of about ITEM_TERMS terms,
each with its own passes, so what is broadcast is bounded however many items
there are (by ITEM_TERMS and one item's terms).

Defined cases: a null text has no terms and is no document. Rows of one doc_id
are documents of their own. Rows of one item_id (null too) are one item with
the terms of all. Items without any term in the documents have no row. Among
equal scores a null doc_id comes last. Other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ravelin.llm.running import running_totals
from ravelin.llm.scratch import drop, table

#: Terms (of all its items) of a block of items.
ITEM_TERMS = 200_000
#: Vector entries of the documents of one tree; documents that are scored at once; items that go down a tree together.
ENTRIES, LEAF, TOGETHER = 1_000_000, 48, 256
#: Bytes of a text that are cut into terms at once.
AT_ONCE = 4_000_000
#: Every byte as it counts: letters in lower case, digits and what is beyond ASCII as they are, and blanks.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Beyond so many terms an item's sums may not be exact in doubles.
EXACT = 100_000


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in stretches."""
    text = text.translate(FOLDED)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + AT_ONCE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term of every different pair."""
    id_type = items.schema["item_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t for part in terms(x.as_py() or b"") for t in part}) for x in batch.column("text")]
            who = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([who, pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, f"item_id {id_type.simpleString()}, term binary").distinct()


def in_blocks(pairs: DataFrame) -> DataFrame:
    """pairs (item_id, term) with the number of their item's block."""
    sizes = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(sizes.withColumn("all", F.lit(0)), ["all"], ["item_id"], ["n"])
    blocks = placed.select(F.col("item_id").alias("of"), F.floor(F.col("before_n") / ITEM_TERMS).cast("long").alias("block"))
    return pairs.join(blocks, F.col("item_id").eqNullSafe(F.col("of"))).drop("of")


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the vocabulary's terms in the text (places) with how often, of every text that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by ITEM_TERMS and one item

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            ns, whats, tfs = [], [], []
            for text in batch.column("text"):
                n, found = 0, []
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    found += [x for x in map(place, part) if x is not None]
                what, tf = np.unique(np.array(found, np.uint32), return_counts=True)
                ns.append(n)
                whats.append(what.tobytes())
                tfs.append(tf.astype(np.uint32).tobytes())
            columns = [batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(whats, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "what", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, what binary, tf binary").where("n > 0")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many rows of found (vectors) hold each of the `size` terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("what").to_pylist()), np.uint32), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["what", "df"])

    sums = found.select("what").mapInArrow(work, "what long, df long").groupBy("what").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for what, df in sums.collect():  # a row for a term of the block
        out[what] = df
    return out


class Items:
    """The items of a block, and what their terms weigh; a term's number is its place in the order by document frequency."""

    def __init__(self, pairs: list[tuple], vocabulary: dict[bytes, int], df: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((np.arange(len(df)), -df))
        self.number = np.empty(len(df), np.int64)
        self.number[order] = np.arange(len(df))
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms
        of: dict = {}
        for item_id, term in pairs:
            if df[vocabulary[term]]:
                of.setdefault(item_id, []).append(int(self.number[vocabulary[term]]))
        self.ids = list(of)
        self.terms = [np.sort(np.array(x)) for x in of.values()]

    def m(self, n: np.ndarray) -> np.ndarray:
        return np.array([50 + 50 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)

    def parts(self, numbers: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What terms add to a score."""
        return self.weight[numbers] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Node:
    """Some documents in the tree's order, all below one path: the terms they hold with the greatest tf, the least m, and the nodes below."""

    __slots__ = ("below", "end", "m", "numbers", "start", "tf")

    def __init__(self, start: int, end: int):
        self.start, self.end, self.below = start, end, []


class Tree:
    """The FP-tree of a block of documents."""

    def __init__(self, ends: np.ndarray, numbers: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray):
        """ends: where in numbers and tf each document's vector ends; numbers rise within a document."""
        starts = np.concatenate(([0], ends[:-1]))
        paths = [numbers[a:b].astype(">u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = np.array(sorted(range(len(ends)), key=paths.__getitem__), np.int64)
        sizes = (ends - starts)[order]
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        moved = np.repeat(starts[order] - self.at[:-1], sizes) + np.arange(self.at[-1])
        self.numbers, self.tf, self.m, self.ids = numbers[moved], tf[moved], m[order], ids[order]
        self.root = Node(0, len(order))
        self._grow()

    def _groups(self, start: int, end: int) -> list[tuple[int, int]]:
        """Where the paths of documents in [start, end) part, as stretches; small neighbours stay together, equal paths are cut anywhere."""
        a, b = (self.numbers[self.at[i] : self.at[i + 1]] for i in (start, end - 1))
        short = min(len(a), len(b))
        apart = np.flatnonzero(a[:short] != b[:short])
        depth = int(apart[0]) if len(apart) else short
        at = self.at[start:end] + depth
        inside = at < self.at[start + 1 : end + 1]
        following = np.where(inside, self.numbers[np.minimum(at, len(self.numbers) - 1)] if len(self.numbers) else 0, -1)
        cuts = np.concatenate(([0], np.flatnonzero(following[1:] != following[:-1]) + 1, [end - start])) + start
        if len(cuts) == 2:
            cuts = np.append(np.arange(start, end, LEAF), end)
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if out and y - out[-1][0] <= LEAF:
                out[-1] = out[-1][0], y
            else:
                out.append((x, y))
        return out

    def _grow(self) -> None:
        made, at = [self.root], 0
        while at < len(made):
            node = made[at]
            at += 1
            if node.end - node.start > LEAF:
                node.below = [Node(*g) for g in self._groups(node.start, node.end)]
                made += node.below
        for node in reversed(made):
            if node.below:
                numbers, tf = (np.concatenate([getattr(x, f) for x in node.below]) for f in ("numbers", "tf"))
                node.m = min(x.m for x in node.below)
            else:
                numbers, tf = (x[self.at[node.start] : self.at[node.end]] for x in (self.numbers, self.tf))
                node.m = int(self.m[node.start : node.end].min())
            order = np.argsort(numbers, kind="stable")
            first = np.flatnonzero(np.diff(numbers[order], prepend=-1))
            node.numbers = numbers[order][first]
            node.tf = np.maximum.reduceat(tf[order], first) if len(first) else tf


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.least, self.rows, self.waiting, self.n = k, 1, None, [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((scores, ids))
        self.n += len(scores)
        if self.n >= self.k:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The scores and rows of ids (id, and whether there is none), best first."""
        if self.waiting:
            kept = [self.rows] if self.rows else []
            scores, ids = (np.concatenate(x) for x in zip(*kept, *self.waiting, strict=True))
            order = np.lexsort((ids[:, 0], ids[:, 1], -scores))[: self.k]
            self.rows, self.waiting, self.n = (scores[order], ids[order]), [], 0
            if len(order) == self.k:
                self.least = int(scores[order[-1]])
        return self.rows or (np.empty(0, np.int64), np.empty((0, 2), np.int64))


def search_tree(tree: Tree, items: Items, best: list[Best]) -> int:
    """Brings the tree's documents to best, the list of all items' best ones; returns how many (item, document) scores it took."""
    scored = 0
    for first in range(0, len(items.ids), TOGETHER):
        group = range(first, min(first + TOGETHER, len(items.ids)))
        held = np.unique(np.concatenate([items.terms[i] for i in group]))
        held = held[np.isin(held, tree.root.numbers, assume_unique=True)]
        exact = max(len(items.terms[i]) for i in group) <= EXACT
        asks = np.zeros((len(group), len(held) + 1), np.float64 if exact else np.int64)  # the last column is for terms that no item here has
        for row, i in enumerate(group):
            asks[row, np.searchsorted(held, np.intersect1d(items.terms[i], held, assume_unique=True))] = 1
        column = np.full(len(items.weight), -1, np.int64)
        column[held] = np.arange(len(held))
        least = np.array([best[i].least for i in group], np.int64)

        def sums(active: np.ndarray, numbers: np.ndarray, places: np.ndarray, parts: np.ndarray, wide: int) -> np.ndarray:
            """For active items by places: the sums of the parts of terms that the item has."""
            of = column[numbers]
            mine = of >= 0
            different, row = np.unique(of[mine], return_inverse=True)
            given = np.zeros((len(different), wide), asks.dtype)
            given[row, places[mine]] = parts[mine]
            return (asks[np.ix_(active, different)] @ given).astype(np.int64)

        stack = [(tree.root, np.arange(len(group)), None)]
        while stack:
            node, active, bound = stack.pop()
            if bound is not None:
                active = active[bound >= least[active]]
            if not len(active):
                continue
            if node.below:
                counts = [len(x.numbers) for x in node.below]
                numbers, tf = (np.concatenate([getattr(x, f) for x in node.below]) for f in ("numbers", "tf"))
                places = np.repeat(np.arange(len(counts)), counts)
                parts = items.parts(numbers, tf, np.array([x.m for x in node.below])[places])
                bounds = sums(active, numbers, places, parts, len(counts))
                for j in np.argsort(bounds.max(axis=0), kind="stable"):  # what promises most is entered first
                    stack.append((node.below[j], active, bounds[:, j]))
                continue
            at = slice(tree.at[node.start], tree.at[node.end])
            places = np.repeat(np.arange(node.end - node.start), np.diff(tree.at[node.start : node.end + 1]))
            parts = items.parts(tree.numbers[at], tree.tf[at], tree.m[node.start : node.end][places])
            scores = sums(active, tree.numbers[at], places, parts, node.end - node.start)
            scored += scores.size
            for row in np.flatnonzero((scores >= least[active][:, None]).any(axis=1)):
                good = np.flatnonzero(scores[row] >= least[active[row]])
                mine = best[group[active[row]]]
                mine.add(scores[row][good], tree.ids[node.start : node.end][good])
                least[active[row]] = mine.least
    return scored


def search(found: DataFrame, items: Items, k: int, id_type) -> DataFrame:
    """item_id, doc_id and score: the k best documents of each task for each item, of vectors found."""
    shared = found.sparkSession.sparkContext.broadcast(items)  # bounded by ITEM_TERMS and one item

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(k) for _ in items.ids]
        held: list[tuple] = []
        n_held = 0

        def flush() -> None:
            nonlocal held, n_held
            if held:
                sizes, numbers, tf, m, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                search_tree(Tree(np.cumsum(sizes), numbers, tf, m, ids), items, best)
                held, n_held = [], 0

        for batch in batches:
            whats = batch.column("what").to_pylist()
            sizes = np.array([len(x) // 4 for x in whats], np.int64)
            numbers = items.number[np.frombuffer(b"".join(whats), np.uint32)]
            tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), np.uint32).astype(np.int64)
            order = np.lexsort((numbers, np.repeat(np.arange(len(sizes)), sizes)))
            ids = batch.column("doc_id")
            ids = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            whole = (sizes, numbers[order], tf[order], items.m(batch.column("n").to_numpy()), ids)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):  # documents until the block is full, one at least
                begun = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, begun + ENTRIES - n_held, side="right")))
                held.append((sizes[at:to], *(x[begun : int(ends[to - 1])] for x in whole[1:3]), *(x[at:to] for x in whole[3:])))
                n_held += int(ends[to - 1]) - begun + to - at
                at = to
                if n_held >= ENTRIES:
                    flush()
        flush()
        for item_id, mine in zip(items.ids, best, strict=True):
            scores, ids = mine.settle()
            if len(scores):
                docs = pa.array(ids[:, 0], mask=ids[:, 1] > 0)
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(scores), to_arrow_type(id_type)), docs, pa.array(scores)], ["item_id", "doc_id", "score"])

    return found.mapInArrow(work, f"item_id {id_type.simpleString()}, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, with scores above 0.

    docs: doc_id, text. items: item_id, text.
    """
    id_type = items.schema["item_id"].dataType
    blocks = table(in_blocks(item_terms(items)), "item_terms")
    n_blocks = blocks.agg(F.max("block")).first()[0]
    out = docs.sparkSession.createDataFrame([], f"item_id {id_type.simpleString()}, doc_id long, score long")
    for block in range(0 if n_blocks is None else n_blocks + 1):
        pairs = [(r[0], bytes(r[1])) for r in blocks.where(F.col("block") == block).select("item_id", "term").collect()]  # bounded
        pairs.sort(key=lambda p: (p[0] is not None, p[0] if p[0] is not None else 0, p[1]))  # the same on every run
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
        found = table(vectors(docs, vocabulary), "vectors")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_docs:
            df = document_frequencies(found, len(vocabulary))
            out = out.unionByName(table(search(found, Items(pairs, vocabulary, df, n_docs, n_terms), k, id_type), "best"))
        drop(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
