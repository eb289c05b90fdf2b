"""Queries on a stored graph: the projected one in layers, as first indexed and after updates.

A graph is stored once for each session and folder of tables, in the shared
folder. A table of it is written when a query first reads it, so a query costs
the tables that it asks for, and later ones find them there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import search as S
from ravelin.plans import projection
from ravelin.plans.stored import StoredGraph
from ravelin.plans.tables import DENSE, new_dir, table
from ravelin.queries import EDGE, NODE, ORDER, PART, SUPPLIER, bm25_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple[str, str, bool], StoredGraph] = {}

#: Fixed values of the updates: files that are parsed again, and one that goes.
CHANGED, GONE = "Sources/ASIA/%/Suppliers.swift", "Sources/Orders/1-URGENT.swift"
#: The graph after the updates, as SQL after projection.SQL: symbols of the changed files have other names and no calls.
UPDATED = f""", nodes2 AS (SELECT id, CASE WHEN file LIKE '{CHANGED}' THEN name || 'Renewed' ELSE name END AS name, 'App.' || name AS qualified_name, kind, file, signature
        FROM nodes WHERE file <> '{GONE}'),
    edges2 AS (SELECT e.* FROM edges e JOIN nodes n ON n.id = e.source WHERE n.file <> '{GONE}' AND NOT (n.file LIKE '{CHANGED}' AND e.kind <> 'conformsTo')) """


def _files(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("file").alias("path")).agg(
        F.lit("swift").alias("language"), F.sha2(F.min("id"), 256).alias("hash"), F.lit(None).cast("timestamp").alias("last_indexed"), F.count(F.lit(1)).cast("int").alias("symbol_count")
    )


def graph(spark: SparkSession, sf_dir: str, updated: bool = False) -> StoredGraph:
    """The projected graph, stored; updated: some files were parsed again since, and one is gone."""
    key = spark.sparkContext.applicationId, sf_dir, updated
    if key in _STORED and _STORED[key].layers.committed():
        return _STORED[key]

    @cache
    def all_nodes() -> DataFrame:
        return table(projection.nodes(spark, sf_dir), "nodes", DENSE)

    @cache
    def all_edges() -> DataFrame:
        own, of = projection.edges(spark, sf_dir), projection.nodes(spark, sf_dir).select(F.col("id").alias("source"), "file")
        same = {"col": F.lit(None).cast("int"), "is_implicit": F.lit(False)}  # of all of them, so these are not shuffled
        return table(own.drop("file", *same).join(of, "source").withColumns(same).select(own.columns), "edges", DENSE)

    stored = StoredGraph(spark, new_dir(spark, "stored"))
    stored.put_later(lambda: _files(all_nodes()), all_nodes, all_edges)
    if updated:
        nodes, edges = all_nodes(), all_edges()
        new = nodes.where(F.col("file").like(CHANGED)).withColumn("name", F.concat("name", F.lit("Renewed")))
        stored.apply(_files(new), new, edges.where(F.col("file").like(CHANGED) & (F.col("kind") == "conformsTo")), new.select("file").distinct())
        none = nodes.limit(0)
        stored.apply(_files(none), none, edges.limit(0), spark.createDataFrame([(GONE,)], "file string"))
    _STORED[key] = stored
    return stored


def stored(name: str, sql: str, updated: bool = False):
    """Registers a function of the stored graph under name, with SQL over nodes and edges (updated: nodes2 and edges2)."""

    def add(query: Callable[[StoredGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: query(graph(spark, sf_dir, updated))
        ORACLES[name] = projection.SQL + (UPDATED if updated else "") + sql
        return query

    return add


stored("stored_node_lookup", f"SELECT id, name, kind, file, line FROM nodes WHERE id = '{PART}'")(lambda g: g.node(PART).select(*NODE))
stored("stored_callers", f"SELECT source, target, kind, line FROM edges WHERE target = '{PART}' AND kind = 'calls'")(lambda g: g.incoming(PART, "calls").select(*EDGE))
stored("stored_callees", f"SELECT source, target, kind, line FROM edges WHERE source = '{ORDER}' AND kind = 'calls'")(lambda g: g.callees(ORDER).select(*EDGE))
stored("stored_outgoing", f"SELECT source, target, kind, line FROM edges WHERE source = '{SUPPLIER}'")(lambda g: g.outgoing(SUPPLIER).select(*EDGE))
stored("stored_stats", "SELECT (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(lambda g: g.counts())
stored("stored_bm25", bm25_sql("widget", False) + "SELECT id, round(score, 6) AS score FROM ranked")(
    lambda g: g.search.bm25([("widget", False)]).select("id", F.round("score", 6).alias("score"))
)
stored("stored_prefix", bm25_sql("supplier1", True) + "SELECT id, round(score, 6) AS score FROM ranked")(
    lambda g: g.search.bm25(S.query_terms("supplier1")).select("id", F.round("score", 6).alias("score"))
)
stored("stored_trigram", "SELECT id, name FROM nodes WHERE contains(lower(name), 'coord')")(lambda g: g.search.substring("COORD").select("id", "name"))

# after updates
_WORDS = """, words AS (
        SELECT id, unnest(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term, 10.0 AS w FROM nodes2
        UNION ALL SELECT id, unnest(list_filter(string_split_regex(lower(qualified_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), 5.0 FROM nodes2
        UNION ALL SELECT id, unnest(list_filter(string_split_regex(lower(signature), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), 1.0 FROM nodes2) """
stored("dml_fts_sync", _WORDS + "SELECT term, count(DISTINCT id) AS df, CAST(sum(w) AS DOUBLE) AS weight FROM words GROUP BY term", updated=True)(
    lambda g: g.layers.live("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("weight"))
)
stored("fts_dictionary", _WORDS + "SELECT term, count(DISTINCT id) AS df FROM words GROUP BY term", updated=True)(
    lambda g: g.layers.live("dictionary").groupBy("term").agg(F.sum("df").alias("df"))
)
stored("fts_after_updates", bm25_sql("supplier", True).replace("FROM nodes ", "FROM nodes2 ") + "SELECT id, round(score, 6) AS score FROM ranked", updated=True)(
    lambda g: g.search.bm25([("supplier", True)]).select("id", F.round("score", 6).alias("score"))
)
stored("trigram_after_updates", "SELECT id, name FROM nodes2 WHERE contains(lower(name), 'renewed')", updated=True)(lambda g: g.search.substring("renewed").select("id", "name"))
stored("degrees_after_updates", """SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out
    FROM (SELECT target AS id, 1 AS i, 0 AS o FROM edges2 UNION ALL SELECT source, 0, 1 FROM edges2) GROUP BY id""", updated=True)(lambda g: g.degrees())  # fmt: skip
stored("stats_after_updates", "SELECT (SELECT count(DISTINCT file) FROM nodes2) AS files, (SELECT count(*) FROM nodes2) AS nodes, (SELECT count(*) FROM edges2) AS edges", updated=True)(
    lambda g: g.counts()
)
stored("incoming_after_updates", f"SELECT source, target, kind, line FROM edges2 WHERE target = '{PART}'", updated=True)(lambda g: g.incoming(PART).select(*EDGE))
