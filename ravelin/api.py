"""The tools of a code-graph service as methods: named like its tools, with their parameters and defaults, returning DataFrames."""

from __future__ import annotations

import json
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators import analytics, lookup, rules, search, sinks, traverse
from ravelin.plans.stored import FROM_INDEX, StoredGraph
from ravelin.plans.tables import table
from ravelin.sources import project, swift


class CodeGraph:
    """Nodes and edges, held in memory of the cluster once asked for, and what can be asked of them. Names stand for symbols everywhere."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, stored: StoredGraph | None = None, root: str | None = None):
        """stored: where nodes and edges come from, for reindex(). root: the project's folder, for what git and the project's files say."""
        self._nodes, self._edges, self.sources, self.stored, self.root = nodes, edges, sources, stored, root

    @classmethod
    def of(cls, stored: StoredGraph, sources: DataFrame | None = None, root: str | None = None) -> CodeGraph:
        return cls(*stored.graph(), sources, stored, root)

    def reindex(self, force: bool = False) -> dict[str, int]:
        """Brings the stored graph up to date with the sources and goes on with it; ValueError without either."""
        if self.stored is None or self.sources is None:
            raise ValueError("no stored graph or no sources")
        self.close()
        done = self.stored.index(self.sources, force)
        for name in ("nodes", "edges"):
            self.__dict__.pop(name, None)
        self._nodes, self._edges = self.stored.graph()
        return done

    @cached_property
    def nodes(self) -> DataFrame:
        return self._nodes.persist()

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges.persist()

    def close(self) -> None:
        for rows in (self._nodes, self._edges):
            rows.unpersist()

    def resolve(self, symbol: str) -> str:
        """The id of a symbol given by id or name; ValueError if there is none."""
        if "::" in symbol or ":" in symbol and not lookup.node_lookup(self.nodes, symbol).isEmpty():
            return symbol
        found = search.resolve_symbol(self.nodes, symbol).first()
        if found is None:
            raise ValueError(f"no symbol {symbol}")
        return found.id

    def status(self) -> DataFrame:
        """One row: files, nodes and edges; with a project's folder its name and type, whether there is an index store, and how symbols were found."""
        counts = lookup.stats(self.nodes, self.edges)
        if self.root is None:
            return counts
        store = project.index_store(Path(self.root))
        said = {"project_name": Path(self.root).resolve().name, "project_type": project.project_type(Path(self.root)), "index_store_available": store is not None}
        from_index = self.stored is not None and not self.stored.files.where(F.col("hash") == FROM_INDEX).isEmpty()
        return counts.select(*(F.lit(v).alias(k) for k, v in said.items()), F.lit("index-store" if from_index else "tree").alias("mode"), "*")

    def search(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return search.search(self.nodes, query, kind, limit)

    def node(self, symbol: str, include_relations: bool = False, include_code: bool = False) -> DataFrame:
        """The node, with what it conforms to and its container's name, with its lines."""
        own = self.resolve(symbol)
        out = lookup.node_detailed(self.nodes, self.edges, own) if include_relations else lookup.node_lookup(self.nodes, own)
        if include_relations:
            names = self.nodes.select(F.col("id").alias("container_usr"), F.col("name").alias("container"))
            out = out.join(names, "container_usr", "left")
        if include_code and self.sources is not None:
            at = out.select("file", "line", "end_line").first()
            code = swift.snippet(self.sources, at.file, at.line, at.end_line).first() if at else None
            out = out.withColumn("code", F.lit(code.snippet if code else None).cast("string"))
        return out

    def callers(self, symbol: str, limit: int = 30, transitive: bool = False) -> DataFrame:
        own = self.resolve(symbol)
        return traverse.transitive_callers(self.edges, own, limit=limit) if transitive else lookup.callers(self.edges, own, limit)

    def callees(self, symbol: str, limit: int = 30) -> DataFrame:
        return lookup.callees(self.edges, self.resolve(symbol), limit)

    def references(self, symbol: str, limit: int = 50) -> DataFrame:
        return lookup.references(self.edges, self.resolve(symbol), limit)

    def hierarchy(self, symbol: str, direction: str = "subtypes", depth: int = 3) -> DataFrame:
        return lookup.hierarchy(self.nodes, self.edges, self.resolve(symbol), direction, depth * 50)

    def files(self, path: str | None = None, limit: int = 100) -> DataFrame:
        return lookup.files_list(lookup.files_of(self.nodes), path, limit)

    def extensions(self, symbol: str, limit: int = 50) -> DataFrame:
        return lookup.extensions(self.edges, self.resolve(symbol), limit)

    def conformances(self, symbol: str, direction: str = "conforms", limit: int = 50) -> DataFrame:
        return lookup.conformances(self.edges, self.resolve(symbol), direction, limit)

    def context(self, task: str, max_nodes: int = 25, include_tests: bool = False) -> DataFrame:
        words = self.nodes.sparkSession.range(1).select(search.keywords(F.lit(task)).alias("w")).first().w
        return analytics.context(self.nodes, self.edges, search.seeds(self.nodes, words), max_nodes, include_tests)

    def context_report(self, task: str, max_nodes: int = 25, include_tests: bool = False) -> dict[str, DataFrame]:
        """context() as nodes, with the keywords of the task, the files of the nodes in their order, and the pattern that their names suggest."""
        nodes = table(self.context(task, max_nodes, include_tests), "context")
        best = nodes.groupBy("file").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("symbols")).orderBy(F.desc("score"), "file")
        keywords = self.nodes.sparkSession.range(1).select(F.explode(search.keywords(F.lit(task))).alias("keyword"))
        return {"nodes": nodes, "files": best, "keywords": keywords, "architecture": analytics.context_pattern(nodes)}

    def impact(self, symbol: str, depth: int = 3) -> DataFrame:
        seed = self.nodes.sparkSession.createDataFrame([(self.resolve(symbol),)], "seed string")
        return analytics.impact(self.nodes, self.edges, seed, depth)

    def diff_impact(self, changed: list[str] | None = None, ref: str = "unstaged") -> DataFrame:
        """changed: files; without them those that git calls changed at ref (unstaged, staged, or a range) in the project's folder."""
        if changed is None:
            if self.root is None:
                raise ValueError("no changed files and no project folder")
            changed = project.changed(Path(self.root), ref)
        return analytics.diff_impact(self.nodes, self.edges, self.nodes.sparkSession.createDataFrame([(f,) for f in changed], "file string"))

    def complexity(self, path: str | None = None, limit: int = 30, sort_by: str = "score") -> DataFrame:
        return analytics.complexity(self.nodes, self.edges, path, sort_by, limit)

    def dead_code(self, path: str | None = None, include_tests: bool = False, limit: int = 50) -> DataFrame:
        return analytics.dead_code(self.nodes, self.edges, include_tests, path).orderBy("id").limit(limit)

    def cycles(self, max_cycles: int = 20, longest: int = 3, path: str | None = None) -> DataFrame:
        """All cycles of files up to that length and, of any length, one for each group of files that depend on each other."""
        of = self.nodes.select("id", "file")
        joined = self.edges.join(of.withColumnsRenamed({"id": "source", "file": "a"}), "source").drop("file").join(of.withColumnsRenamed({"id": "target", "file": "b"}), "target")
        joined = joined if path is None else joined.where(F.col("a").startswith(path) & F.col("b").startswith(path))
        found = traverse.simple_cycles(joined.select("a", "b"), longest).unionByName(traverse.cycle_witnesses(joined.select("a", "b"))).distinct()
        return found.orderBy("edge_count", "path").limit(max_cycles)

    def coupling(self, depth: int = 2, source_root: str = "") -> DataFrame:
        return analytics.coupling(self.nodes, self.edges, depth, source_root).orderBy(F.desc("distance"), "module")

    def architecture(self, expected: str | None = None) -> DataFrame:
        out = analytics.architecture(self.nodes)
        return out if expected is None else out.withColumn("as_expected", F.col("detected") & (F.col("pattern") == expected))

    def layers(self) -> DataFrame:
        """The statistics of architecture()'s layers."""
        return analytics.architecture_layers(self.nodes).orderBy("place")

    def imports(self, path: str | None = None, limit: int = 50) -> DataFrame:
        """Modules with the files that import them; with a path the files under it with what they import."""
        if path is None:
            return analytics.imports_by_module(self.nodes)
        return analytics.imports_by_file(self.nodes.where(F.col("file").contains(path)), limit)

    def boundaries(self, config: str) -> DataFrame:
        """config: JSON with layers (name, pattern) and rules (from, to, allowed); ValueError if it is none."""
        read = json.loads(config)
        layers = [(x["name"], x["pattern"]) for x in read["layers"]]
        return analytics.boundaries(self.nodes, self.edges, layers, [(r["from"], r["to"], r["allowed"]) for r in read["rules"]])

    def concurrency(self, symbol: str) -> DataFrame:
        own = self.resolve(symbol)
        return analytics.concurrency(self.nodes, self.edges).where(F.col("id") == own)

    def audit(self, categories: str | None = None, min_severity: str = "low", path_filter: str | None = None, max_issues: int = 100, fix_suggestions: bool = True) -> DataFrame:
        return rules.audit(self.sources, categories, min_severity, path_filter, max_issues, fix_suggestions)

    def audit_json(self, **how: object) -> DataFrame:
        """audit() as one JSON object a row."""
        return sinks.as_json(self.audit(**how))
