"""An inverted index of symbols in layers: a term dictionary, postings, and bitmaps of trigrams.

  postings    term, id, kind, file, what the term weighs in the symbol, and the symbol's length; sorted by term
  dictionary  term and kind with their document frequency, as differences
  totals      kind with the number of symbols and of their words, as differences
  symbols     number (within a layer), id, kind, file, name; sorted by number
  grams       trigram and block with the numbers of the block's symbols that have it, packed; sorted by trigram

A query reads the postings of its terms alone: a term is a key, a prefix a
range of keys. Its scores are those of operators.search.bm25, which reads every
symbol. A substring is looked for in the intersection of its trigrams' bitmaps,
the rarest first, and only what is left is compared with the text.

A block is 65,536 numbers; its part in a trigram is a sorted list of 16-bit
numbers or, beyond 4,096 of them, 8 KiB of bits. So no group is larger than a
block, however frequent a trigram is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators import search
from ravelin.operators.lookup import contains_text
from ravelin.plans.layers import LAYER, Layers, Layout, columns
from ravelin.plans.tables import table

#: As a list of 16-bit numbers up to so many, else as bits.
LISTED = 4096
LAYOUTS = {
    "postings": Layout(columns("term string, id string, kind string, file string, weight double, length long"), ("term", "id")),
    "dictionary": Layout(columns("term string, kind string, df long"), ("term", "kind"), ("df",)),
    "totals": Layout(columns("kind string, n long, length long"), ("kind",), ("n", "length")),
    "symbols": Layout(columns("number long, id string, kind string, file string, name string"), ("number",)),
    "grams": Layout(columns("trigram string, block long, n int, bits binary, file string"), ("trigram", "block")),
}


def words(nodes: DataFrame) -> DataFrame:
    """postings of nodes."""
    of = {f: search.tokens(F.col(f)) for f in search.FIELDS}
    own = nodes.select("id", "kind", "file", *(c.alias(f"_{f}") for f, c in of.items()))
    every = F.concat(*(F.col(f"_{f}") for f in of))
    weight = lambda w: sum((F.size(F.filter(f"_{f}", lambda x: x == w)) * F.lit(v) for f, v in search.FIELDS.items()), F.lit(0.0))
    own = own.withColumn("length", F.size(every).cast("long"))
    return own.select("id", "kind", "file", "length", F.explode(F.transform(F.array_distinct(every), lambda w: F.struct(w.alias("term"), weight(w).alias("weight")))).alias("p")).select(
        "p.term", "id", "kind", "file", "p.weight", "length"
    )


def _pack(numbers: np.ndarray) -> bytes:
    numbers = np.sort(numbers).astype(np.uint16)
    if len(numbers) <= LISTED:
        return numbers.tobytes()
    bits = np.zeros(1 << 16, bool)
    bits[numbers] = True
    return np.packbits(bits).tobytes()


def _unpack(n: int, packed: bytes) -> np.ndarray:
    if n <= LISTED:
        return np.frombuffer(packed, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8))).astype(np.uint16)


def grams(symbols: DataFrame) -> DataFrame:
    """trigram, block, n and packed numbers of symbols (number, name)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x.values) for x in batch.column("low")]
            columns = [*batch.select(["trigram", "block"]).columns, pa.array([len(x) for x in lists], pa.int32()), pa.array([_pack(x) for x in lists], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["trigram", "block", "n", "bits"])

    name = F.lower("name")
    cut = F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(name, i, F.lit(3)))
    each = symbols.where(F.length("name") >= 3).select("number", F.explode(F.array_distinct(cut)).alias("trigram"))
    blocks = each.groupBy("trigram", F.shiftright("number", 16).alias("block")).agg(F.collect_list(F.col("number").bitwiseAND(0xFFFF).cast("int")).alias("low"))
    return blocks.mapInArrow(work, "trigram string, block long, n int, bits binary").withColumn("file", F.lit(None).cast("string"))


def _numbered(nodes: DataFrame) -> DataFrame:
    return nodes.sortWithinPartitions("file", "id").select(F.monotonically_increasing_id().alias("number"), "id", "kind", "file", "name")


def _dictionary(postings: DataFrame, sign: int = 1) -> DataFrame:
    return postings.groupBy("term", "kind").agg((sign * F.count(F.lit(1))).alias("df"))


def _totals(nodes: DataFrame, sign: int = 1) -> DataFrame:
    length = sum((F.size(search.tokens(F.col(f))) for f in search.FIELDS), F.lit(0))
    return nodes.groupBy("kind").agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.sum(length)).alias("length"))


def rows(added: DataFrame, removed: DataFrame | None = None) -> dict[str, DataFrame]:
    """What an update that adds nodes and removes others brings to the tables. postings and symbols are tables that go when it is there."""
    symbols, new = table(_numbered(added), "symbols"), table(words(added), "postings")
    dictionary, totals = _dictionary(new), _totals(added)
    if removed is not None:
        dictionary, totals = dictionary.unionByName(_dictionary(words(removed), -1)), totals.unionByName(_totals(removed, -1))
    return {"postings": new, "dictionary": dictionary, "totals": totals, "symbols": symbols, "grams": grams(symbols)}


def rows_later(layers: Layers, nodes: Callable[[], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The same for a first layer whose tables are written when they are read. nodes: returns a table."""
    return {
        "postings": lambda: words(nodes()), "dictionary": lambda: _dictionary(layers.first("postings")), "totals": lambda: _totals(nodes()),
        "symbols": lambda: _numbered(nodes()), "grams": lambda: grams(layers.first("symbols")),
    }


class SearchIndex:
    """Searches over the tables of LAYOUTS."""

    def __init__(self, layers: Layers):
        self.layers = layers

    @staticmethod
    def _is(term: str, prefix: bool) -> Column:
        # words hold letters and digits only, so no word that begins with term is beyond its range
        return F.col("term").between(term, term + "\U0010ffff") if prefix else F.col("term") == term

    def postings(self, terms: list[tuple[str, bool]], kind: str | None = None) -> DataFrame:
        """The postings of terms; prefixes (True) are ranges."""
        where = F.lit(False)
        for t in terms:
            where = where | self._is(*t)
        return self.layers.live("postings", where if kind is None else where & (F.col("kind") == kind))

    def document_frequency(self, term: str, kind: str | None = None) -> int:
        """Of how many symbols the dictionary says that they hold the word."""
        where = F.col("term") == term if kind is None else (F.col("term") == term) & (F.col("kind") == kind)
        return self.layers.live("dictionary", where).agg(F.sum("df")).first()[0] or 0

    def bm25(self, terms: list[tuple[str, bool]], kind: str | None = None, limit: int | None = None) -> DataFrame:
        """id, kind, file and score of the symbols that hold every term, the score as in operators.search.bm25."""
        empty = self.layers.spark.createDataFrame([], "id string, kind string, file string, score double")
        if not terms or any(not self.document_frequency(t, kind) for t, prefix in terms if not prefix):
            return empty
        totals = self.layers.live("totals", None if kind is None else F.col("kind") == kind).agg(F.sum("n"), F.sum("length")).first()
        n, average = totals[0] or 0, (totals[1] or 0) / (totals[0] or 1) or 1.0
        weights = [F.coalesce(F.sum(F.when(self._is(*t), F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, t in enumerate(terms)]
        held = self.postings(terms, kind).groupBy("id", "kind", "file").agg(F.first("length").alias("length"), *weights)
        df = held.agg(*(F.count_if(F.col(f"w{i}") > 0) for i in range(len(terms)))).first()
        score, every = F.lit(0.0), F.lit(True)
        for i in range(len(terms)):
            w = F.col(f"w{i}")
            score = score + search.rarity(n, df[i]) * search.saturation(w, F.col("length"), average)
            every = every & (w > 0)
        out = held.where(every).select("id", "kind", "file", score.alias("score"))
        return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)

    def candidates(self, text: str) -> DataFrame:
        """layer and number of the symbols whose names have all trigrams of the text (three characters or more)."""
        q = text.lower()
        wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for layer, block, parts in zip(*(batch.column(c).to_pylist() for c in (LAYER, "block", "parts")), strict=True):
                    parts.sort(key=lambda p: p["n"])
                    left = _unpack(**parts[0])
                    for p in parts[1:]:
                        left = np.intersect1d(left, _unpack(**p), assume_unique=True) if len(left) else left
                    numbers = left.astype(np.int64) + (block << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), layer, np.int32)), pa.array(numbers)], [LAYER, "number"])

        of = self.layers.every("grams").where(F.col("trigram").isin(*wanted))
        blocks = of.groupBy(LAYER, "block").agg(F.collect_list(F.struct("n", F.col("bits").alias("packed"))).alias("parts"))  # a part for each trigram of the text
        return blocks.where(F.size("parts") == len(wanted)).mapInArrow(work, f"{LAYER} int, number long")

    def substring(self, text: str) -> DataFrame:
        """id, kind, file and name of the symbols with the text (three characters or more) anywhere in the name."""
        symbols = self.layers.live("symbols", keep_layer=True)
        if len(text) < 3:
            return symbols.select("id", "kind", "file", "name").limit(0)
        found = symbols.join(self.candidates(text), [LAYER, "number"])
        return found.where(contains_text("name", text)).select("id", "kind", "file", "name")
