"""A graph kept in files: indexed from Swift sources, whole at first and then by what has changed.

All tables are layers (plans.layers), so an update writes only the rows of the
files that it parsed, is seen as a whole, and can break off without harm. The
same rows lie in several orders, each for one kind of question:

  files, nodes, edges               by file: what an update replaces
  nodes_by_id, names                by id and by name: one symbol
  edges_by_source, edges_by_target  a symbol's relations, either way
  degrees, counts                   relations of each symbol and totals, as differences
  postings and so on                words and parts of names (plans.search_index)

A question about one symbol reads the row groups that hold its key. Edges to
`name::X` stay as parsed; `graph()` leads them to symbols, so a changed file
never leaves edges to symbols that are gone. After MOST layers an update writes
all of them as one.

Defined cases: a folder without tables is an empty graph. A path that occurs
twice counts by its last row (greatest text). Files that are no more stay
unless `purge` is set. Null texts are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ravelin.operators.store import CALLABLE, changed_files, keep_last, missing_files, resolve_names, with_hash
from ravelin.plans import search_index
from ravelin.plans.layers import Layers, Layout, columns
from ravelin.plans.tables import drop, table
from ravelin.schema import EDGES, FILES, NODES
from ravelin.sources import index_dump, swift
from ravelin.streaming import watch

#: Layers before an update writes one of them all. Files of an update whose names are pushed to the scan.
MOST, PUSHED = 12, 200
#: Fixed value: what stands for the hash of a file that came from a compiler's index.
FROM_INDEX = "indexstore"
#: Rows of an update that one task sorts.
FEW = 50_000
LAYOUTS = {
    "files": Layout(StructType([*FILES.fields, StructField("file", StringType())]), ("path",)),
    "nodes": Layout(NODES, ("file", "id")),
    "edges": Layout(EDGES, ("file", "source")),
    "nodes_by_id": Layout(NODES, ("id",)),
    "names": Layout(columns("name string, id string, kind string, file string"), ("name", "id")),
    "edges_by_source": Layout(EDGES, ("source", "target")),
    "edges_by_target": Layout(EDGES, ("target", "source")),
    "degrees": Layout(columns("id string, fan_in long, fan_out long"), ("id",), ("fan_in", "fan_out")),
    "counts": Layout(columns("what string, n long"), ("what",), ("n",)),
} | search_index.LAYOUTS


def _degrees(edges: DataFrame, sign: int) -> DataFrame:
    one, none = F.lit(sign).cast("long"), F.lit(0).cast("long")
    return edges.select(F.col("source").alias("id"), none.alias("fan_in"), one.alias("fan_out")).unionByName(
        edges.select(F.col("target").alias("id"), one.alias("fan_in"), none.alias("fan_out"))
    )


def _counts(tables: dict[str, DataFrame], sign: int) -> DataFrame:
    parts = [rows.agg((sign * F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("what"), "n") for name, rows in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


class StoredGraph:
    """Files, nodes, edges and what finds them, in a folder that the driver and all executors share. One update runs at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.layers = Layers(spark, folder, LAYOUTS)
        self.search = search_index.SearchIndex(self.layers)

    @property
    def files(self) -> DataFrame:
        return self.layers.live("files").drop("file")

    @property
    def nodes(self) -> DataFrame:
        return self.layers.live("nodes")

    @property
    def edges(self) -> DataFrame:
        """Edges as parsed, those to `name::X` not led to symbols yet."""
        return self.layers.live("edges")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """nodes, and edges led to the symbols that they name."""
        return self.nodes, resolve_names(self.edges, self.nodes)

    # one symbol

    def node(self, symbol: str) -> DataFrame:
        """The node of an id, from the row groups of nodes_by_id that may hold it."""
        return self.layers.live("nodes_by_id", F.col("id") == symbol)

    def outgoing(self, symbol: str, *kinds: str) -> DataFrame:
        """Edges from a symbol, as parsed."""
        where = F.col("source") == symbol
        return self.layers.live("edges_by_source", where & F.col("kind").isin(*kinds) if kinds else where)

    def incoming(self, symbol: str, *kinds: str) -> DataFrame:
        """Edges to a symbol, and those of other symbols to its name (if it can be called)."""
        own = self.node(symbol).where(F.col("kind").isin(*CALLABLE)).select("name").first()
        where = F.col("target").isin(symbol, f"name::{own.name}") if own else F.col("target") == symbol
        where = where & ((F.col("target") == symbol) | (F.col("source") != symbol))
        found = self.layers.live("edges_by_target", where & F.col("kind").isin(*kinds) if kinds else where)
        return found.withColumn("target", F.lit(symbol)).distinct()

    def callees(self, symbol: str) -> DataFrame:
        """Calls from a symbol, those to a name led to each symbol of that name."""
        calls = self.outgoing(symbol, "calls")
        names = [r[0] for r in calls.where(F.col("target").startswith("name::")).select(F.expr("substring(target, 7)")).distinct().limit(PUSHED + 1).collect()]
        if not names:  # all calls lead to symbols
            return resolve_names(calls, self.spark.createDataFrame([], LAYOUTS["names"].schema))
        own = F.col("kind").isin(*CALLABLE)
        return resolve_names(calls, self.layers.live("names", own & F.col("name").isin(*names) if len(names) <= PUSHED else own))

    def degrees(self, symbol: str | None = None) -> DataFrame:
        """id, fan_in and fan_out of symbols with relations, or of one."""
        return self.layers.live("degrees", None if symbol is None else F.col("id") == symbol)

    def counts(self) -> DataFrame:
        """One row: the numbers of files, nodes and edges, from what updates have added and taken."""
        n = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
        return self.layers.live("counts").agg(n("files"), n("nodes"), n("edges"))

    # updates

    def _of_files(self, name: str, gone: DataFrame) -> DataFrame:
        """The rows of a table that belong to files in gone; few names are pushed to the scan."""
        few = [r[0] for r in gone.limit(PUSHED + 1).collect()]
        rows = self.layers.live(name, F.col("file").isin(*few) if 0 < len(few) <= PUSHED else None)
        return rows.join(gone, "file", "left_semi")

    def apply(self, files: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame, whole: bool = False) -> None:
        """Puts files, nodes and edges in place of all rows of the files in gone (column file). whole: in place of everything.

        files has the columns of schema.FILES. An edge belongs to its file.
        """
        files = files.withColumn("file", F.col("path"))
        whole = whole or not self.layers.committed()
        removed = None if whole else {name: table(self._of_files(name, gone), "removed") for name in ("files", "nodes", "edges")}
        degrees, counts = _degrees(edges, 1), _counts({"files": files, "nodes": nodes, "edges": edges}, 1)
        if removed:
            degrees, counts = degrees.unionByName(_degrees(removed["edges"], -1)), counts.unionByName(_counts(removed, -1))
        rows = {"files": files, "nodes": nodes, "edges": edges, "nodes_by_id": nodes, "names": nodes, "edges_by_source": edges, "edges_by_target": edges, "degrees": degrees, "counts": counts}
        few = sum(t.count() for t in (files, nodes, edges, *(removed or {}).values())) <= FEW
        found = search_index.rows(nodes, removed["nodes"] if removed else None)
        self.layers.add(rows | found, gone, whole, few)
        drop(found["symbols"], found["postings"], *(removed or {}).values())
        if len(self.layers.committed()) > MOST:
            found = search_index.rows(self.nodes)
            self.layers.compact(found)
            drop(found["symbols"], found["postings"])

    def put_later(self, files: Callable[[], DataFrame], nodes: Callable[[], DataFrame], edges: Callable[[], DataFrame]) -> None:
        """Puts the tables that the functions return in place of everything. What is stored of them is written table by table, when first asked for.

        The functions must return the same for as long as a table is not written. Until then only this object can answer.
        """
        of_files = lambda: files().withColumn("file", F.col("path"))
        rows = {"files": of_files, "degrees": lambda: _degrees(edges(), 1), "counts": lambda: _counts({"files": files(), "nodes": nodes(), "edges": edges()}, 1)}
        rows |= dict.fromkeys(("nodes", "nodes_by_id", "names"), nodes) | dict.fromkeys(("edges", "edges_by_source", "edges_by_target"), edges)
        self.layers.add_later(rows | search_index.rows_later(self.layers, nodes))

    def index(self, sources: DataFrame, force: bool = False, purge: bool = False) -> dict[str, int]:
        """Brings the tables up to date with sources (path, text) and returns how many files were seen and indexed, nodes and edges written.

        force: all is parsed and written anew and nothing of before stays. purge: stored files that sources lacks go.
        """
        last = keep_last(sources.select("path", "text", F.coalesce("text", F.lit("")).alias("load_seq")), "path").select("path", F.coalesce("text", F.lit("")).alias("text"))
        current = table(with_hash(last, "text"), "sources")
        few = [] if force or purge else [r[0] for r in current.select("path").limit(PUSHED + 1).collect()]
        stored = self.layers.live("files", F.col("path").isin(*few) if 0 < len(few) <= PUSHED else None).drop("file")
        stored = stored.limit(0) if force else stored
        changed = changed_files(current.select("path", "hash"), stored)
        gone = changed.select(F.col("path").alias("file"))
        if purge and not force:
            gone = gone.unionByName(missing_files(current, stored).select(F.col("path").alias("file")))
        gone = table(gone, "changed_files")
        seen = current.count()
        if gone.isEmpty() and not force:
            drop(current, gone)
            return {"files_scanned": seen, "files_indexed": 0, "nodes_added": 0, "edges_added": 0}
        fresh = table(current.join(gone, current.path == gone.file, "left_semi"), "changed_sources")
        nodes, edges = (table(rows, "parsed") for rows in swift.graph(fresh))
        counts = nodes.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
        files = fresh.join(counts, fresh.path == counts.file, "left").select(
            "path", F.lit("swift").alias("language"), "hash", F.current_timestamp().alias("last_indexed"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count")
        )
        self.apply(files, nodes, edges, gone, force)
        done = {"files_scanned": seen, "files_indexed": fresh.count(), "nodes_added": nodes.count(), "edges_added": edges.count()}
        drop(current, gone, fresh, nodes, edges)
        return done

    def index_store(self, occurrences: DataFrame, sources: DataFrame | None = None) -> dict[str, int | str]:
        """Puts a compiler's index (rows as in sources.index_dump) in place of what is stored of its files; other files of sources are parsed.

        Files from the index have no hash of their own, so the next index() of sources parses those that it is given.
        """
        null = lambda f: F.lit([] if f.name == "attributes" else None).cast(f.dataType)
        full = lambda rows, schema, more: rows.select(*(more.get(f.name, F.col(f.name) if f.name in rows.columns else null(f)).alias(f.name) for f in schema))
        named = {"qualified_name": F.col("name"), "attributes": F.array().cast("array<string>")}
        nodes = table(keep_last(full(index_dump.definitions(occurrences), NODES, named).withColumn("load_seq", F.lit(0)), "id").drop("load_seq"), "parsed")
        edges = table(full(index_dump.relations(occurrences), EDGES, {"is_implicit": F.lit(False)}).distinct(), "parsed")
        counts = nodes.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
        files = table(counts.select("path", F.lit("swift").alias("language"), F.lit(FROM_INDEX).alias("hash"), F.current_timestamp().alias("last_indexed"), "symbol_count"), "files")
        covered = nodes.select("file").unionByName(edges.select("file")).distinct()
        self.apply(files, nodes, edges, covered)
        done = {"files_indexed": files.count(), "nodes_added": nodes.count(), "edges_added": edges.count(), "strategy": "index-store"}
        rest = None if sources is None else sources.join(covered.withColumnRenamed("file", "path"), "path", "left_anti")
        if rest is not None and not rest.isEmpty():
            parsed = self.index(rest)
            done = {k: v + parsed[k] for k, v in done.items() if k != "strategy"} | {"strategy": "hybrid"}
        return done

    def watch(self, stream: DataFrame, checkpoint: str, **how: object) -> object:
        """Starts a watch (streaming.watch) that indexes what a stream of (path, text, load_seq) changes."""
        return watch.start(stream, None, lambda rows, number: self.index(rows), checkpoint, **how)
