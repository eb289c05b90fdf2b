"""Point lookups, filters and navigation over nodes, edges and files.

Limits are optional; with one, rows come in a total order that ends in the
row's key, so the same ones survive on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.schema import ACCESS_LEVELS, EDGE_KINDS, SUB_KINDS, SYMBOL_KINDS

EDGE_KEY = ("source", "target", "kind", "line")


def _limited(rows: DataFrame, order: tuple, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def contains_text(column: str, text: str) -> Column:
    """Whether the column has the text in it, whatever the case; % and _ stand for themselves."""
    return F.lower(column).contains(text.lower())


def node_lookup(nodes: DataFrame, symbol: str) -> DataFrame:
    return nodes.where(F.col("id") == symbol)


def node_name_like(nodes: DataFrame, text: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    found = nodes.where(contains_text("name", text))
    return _limited(found if kind is None else found.where(F.col("kind") == kind), ("id",), limit)


def nodes_all(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    return _limited(nodes, ("id",), limit)


def nodes_path_prefix(nodes: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    return _limited(nodes.where(F.lower("file").startswith(prefix.lower())), ("id",), limit)


def nodes_in_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file).orderBy("line", "id")


def files_list(files: DataFrame, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    found = files if prefix is None else files.where(F.lower("path").startswith(prefix.lower()))
    return _limited(found, ("path",), limit)


def edges_by(edges: DataFrame, side: str, symbol: str, kinds: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Edges with the symbol as `side` (source or target), of any kind or some."""
    found = edges.where(F.col(side) == symbol)
    return _limited(found.where(F.col("kind").isin(*kinds)) if kinds else found, EDGE_KEY, limit)


def callers(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "target", symbol, ("calls",), limit)


def callees(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "source", symbol, ("calls",), limit)


def references(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "target", symbol, (), limit)


def all_outgoing(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "source", symbol, (), limit)


def subtypes(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "target", symbol, ("conformsTo", "inheritsFrom"), limit)


def supertypes(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "source", symbol, ("conformsTo", "inheritsFrom"), limit)


def extensions(edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    return edges_by(edges, "target", symbol, ("extendsType",), limit)


def conformances(edges: DataFrame, symbol: str, direction: str = "conforms", limit: int | None = None) -> DataFrame:
    return edges_by(edges, "target" if direction == "conformedBy" else "source", symbol, ("conformsTo",), limit)


def _known(column: str, values: tuple[str, ...], other: str | None) -> Column:
    return F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.lit(other))


def decoded_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with unknown enumerated values replaced by their defaults, null attributes emptied, and a location struct."""
    place = F.struct("file", "line", F.col("col").alias("column"), "end_line", "end_col")
    return nodes.withColumns({
        "kind": _known("kind", SYMBOL_KINDS, "function"),
        "sub_kind": _known("sub_kind", SUB_KINDS, None),
        "access_level": _known("access_level", ACCESS_LEVELS, "Internal"),
        "attributes": F.coalesce("attributes", F.array().cast("array<string>")),
        "location": place,
    })


def decoded_edges(edges: DataFrame) -> DataFrame:
    """edges with unknown kinds as references, and a location struct where they have a file."""
    place = F.struct("file", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("column"))
    return edges.withColumns({"kind": _known("kind", EDGE_KINDS, "references"), "location": F.when(F.col("file").isNotNull(), place)})


def hierarchy(nodes: DataFrame, edges: DataFrame, symbol: str, direction: str = "subtypes", limit: int | None = None) -> DataFrame:
    """The nodes one step up or down; edges to unknown symbols are dropped."""
    end, found = ("target", supertypes(edges, symbol, limit)) if direction == "supertypes" else ("source", subtypes(edges, symbol, limit))
    return nodes.join(found.select(F.col(end).alias("id")).distinct(), "id", "left_semi")


def node_detailed(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """The node with what it conforms to (sorted) and how often it is extended."""
    about = edges.where((F.col("source") == symbol) & (F.col("kind") == "conformsTo") | (F.col("target") == symbol) & (F.col("kind") == "extendsType"))
    conforms = F.when(F.col("kind") == "conformsTo", F.col("target"))
    about = about.agg(F.array_sort(F.collect_set(conforms)).alias("conforms_to"), F.count_if(F.col("kind") == "extendsType").alias("extension_count"))
    return node_lookup(nodes, symbol).join(about.withColumn("id", F.lit(symbol)), "id")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, nodes and edges."""
    counts = nodes.agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("nodes"), F.lit(0).cast("long").alias("edges"))
    more = edges.agg(F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("nodes"), F.count(F.lit(1)).alias("edges"))
    return counts.unionByName(more).agg(*(F.sum(c).alias(c) for c in ("files", "nodes", "edges")))


def files_of(nodes: DataFrame) -> DataFrame:
    """A files table: each file with the number of its symbols."""
    return nodes.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
