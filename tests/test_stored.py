"""A stored graph: full and incremental index, force, purge, and the watch."""

import pytest
from pyspark.sql import functions as F

from ravelin.operators import search
from ravelin.plans.stored import StoredGraph
from ravelin.sources import swift

FILES = {
    "Sources/Models.swift": "import Foundation\n\nstruct User {\n    let id: Int\n    let name: String\n}\n",
    "Sources/Services.swift": "protocol UserService {\n    func fetch(id: Int) -> User\n}\n\nclass NetworkUserService: UserService {\n    func fetch(id: Int) -> User {\n        return makeUser(id)\n    }\n}\n",
    "Sources/Factory.swift": "func makeUser(_ id: Int) -> User {\n    return User(id: id)\n}\n",
}


@pytest.fixture
def sources(spark, tmp_path):
    def write(files):
        for path, text in files.items():
            at = tmp_path / "code" / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
        return swift.read(spark, str(tmp_path / "code"))

    return write


def state(graph):
    """All rows without times."""
    nodes, edges = graph.graph()
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(graph.files.drop("last_indexed")), rows(nodes), rows(edges)


def calls(graph):
    nodes, edges = graph.graph()
    names = {n.id: n.name for n in nodes.collect()}
    return {(names.get(e.source), names.get(e.target)) for e in edges.where("kind = 'calls'").collect()}


def test_index_then_what_changed(spark, sources, tmp_path):
    graph = StoredGraph(spark, str(tmp_path / "graph"))
    assert graph.nodes.count() == graph.edges.count() == graph.files.count() == 0
    first = graph.index(sources(FILES))
    assert first["files_scanned"] == first["files_indexed"] == 3 and first["nodes_added"] == graph.nodes.count() and first["edges_added"] == graph.edges.count() > 0
    assert ("fetch", "makeUser") in calls(graph)
    assert {r.name for r in search.search(graph.nodes, "Service").collect()} >= {"UserService", "NetworkUserService"}
    assert {r.path.split("/")[-1]: r.symbol_count for r in graph.files.collect()} == {r.file.split("/")[-1]: r["count"] for r in graph.nodes.groupBy("file").count().collect()}
    before, parts = state(graph), sorted((tmp_path / "graph").rglob("*.parquet"))
    assert graph.index(sources({})) == {"files_scanned": 3, "files_indexed": 0, "nodes_added": 0, "edges_added": 0}
    assert state(graph) == before and sorted((tmp_path / "graph").rglob("*.parquet")) == parts  # nothing was written
    renamed = {"Sources/Factory.swift": FILES["Sources/Factory.swift"].replace("makeUser", "buildUser"), "Sources/New.swift": "enum Mode { case on }\n"}
    assert graph.index(sources(renamed))["files_indexed"] == 2
    assert ("fetch", "makeUser") not in calls(graph) and {"buildUser", "Mode"} <= {n.name for n in graph.nodes.collect()}
    whole = StoredGraph(spark, str(tmp_path / "whole"))
    whole.index(sources({}))
    assert state(graph) == state(whole)  # as if indexed at once
    assert graph.index(sources({}), force=True)["files_indexed"] == 4 and state(graph) == state(whole)


def test_files_that_are_no_more(spark, sources, tmp_path):
    graph = StoredGraph(spark, str(tmp_path / "graph"))
    every = sources(FILES)
    graph.index(every)
    rest = every.where(~F.col("path").endswith("Factory.swift"))
    graph.index(rest)
    assert graph.files.count() == 3
    graph.index(rest, purge=True)
    assert graph.files.count() == 2 and graph.nodes.where("name = 'makeUser'").isEmpty() and ("fetch", "makeUser") not in calls(graph)


def test_odd_sources(spark, tmp_path):
    graph = StoredGraph(spark, str(tmp_path / "graph"))
    empty = spark.createDataFrame([], "path string, text string")
    assert graph.index(empty)["files_indexed"] == 0 and graph.index(empty, force=True)["files_indexed"] == 0
    rows = [("a.swift", None), ("b.swift", "struct A {}"), ("b.swift", "struct B {}"), ("c.swift", "")]
    assert graph.index(spark.createDataFrame(rows, "path string, text string"))["files_indexed"] == 3
    assert [n.name for n in graph.nodes.collect()] == ["B"] and {(f.path, f.symbol_count) for f in graph.files.collect()} == {("a.swift", 0), ("b.swift", 1), ("c.swift", 0)}


def test_watch_indexes_what_changes(spark, tmp_path):
    """Rows whose text was seen do not reach the index, after a restart from the checkpoint either."""
    graph, indexed = StoredGraph(spark, str(tmp_path / "graph")), []
    own = graph.index
    graph.index = lambda rows: indexed.append(sorted((r.path, r.text) for r in rows.collect())) or own(rows)
    landing, schema = tmp_path / "landing", "path string, text string, load_seq long"
    batches = (
        [("a.swift", "struct A {}", 1), ("b.swift", "struct B {}", 1), ("b.swift", None, 0)],
        [("a.swift", "struct C {}", 2), ("b.swift", "struct B {}", 2), ("note.md", "x", 2), (".build/c.swift", "x", 2)],
        [("a.swift", "struct C {}", 3), ("b.swift", "struct B {}", 3)],
    )
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(landing))
        query = graph.watch(spark.readStream.schema(schema).parquet(str(landing)), str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination(90)
        assert query.exception() is None
    assert indexed == [[("a.swift", "struct A {}"), ("b.swift", "struct B {}")], [("a.swift", "struct C {}")]]
    assert {n.name for n in graph.nodes.collect()} == {"B", "C"} and graph.layers.committed() == [1, 2]


def test_index_store_and_the_rest_parsed(spark, sources, tmp_path):
    from ravelin.api import CodeGraph

    graph = StoredGraph(spark, str(tmp_path / "graph"))
    code = spark.createDataFrame([("A.swift", "class Old {}"), ("B.swift", "class B {\n    func g() { f() }\n}")], "path string, text string")
    graph.index(code)
    rows = [
        ("s:A", "A", 7, 0, 2, "A.swift", 1, 1, [("s:P", 8, 1 << 10)]), ("s:f", "f", 16, 0, 2, "A.swift", 3, 5, [("s:A", 7, 1 << 9)]), ("s:f", "f", 16, 0, 2, "A.swift", 3, 5, [("s:A", 7, 1 << 9)]),
    ]
    dump = spark.createDataFrame(rows, "usr string, name string, kind int, properties long, roles long, file string, line int, col int, relations array<struct<usr:string,kind:int,roles:long>>")
    done = graph.index_store(dump, code)
    assert done == {"files_indexed": 1, "nodes_added": 2, "edges_added": 2, "strategy": "hybrid"}  # B.swift was stored already
    assert sorted(n.name for n in graph.nodes.collect()) == ["A", "B", "f", "g"]
    whole = StoredGraph(spark, str(tmp_path / "whole"))
    assert whole.index_store(dump, code)["strategy"] == "hybrid" and state(whole)[1:] == state(graph)[1:]
    assert ("g", "f") in calls(graph)
    (tmp_path / "Package.swift").write_text("")
    api = CodeGraph.of(graph, code, str(tmp_path))
    assert api.status().first().asDict() == {"project_name": tmp_path.name, "project_type": "spm", "index_store_available": False, "mode": "index-store", "files": 2, "nodes": 4, "edges": api.edges.count()}
    own = api.node("s:f", include_relations=True, include_code=True).first()
    assert (own.name, own.conforms_to, own.code) == ("f", [], "")
    g = next(n.id for n in graph.nodes.collect() if n.name == "g")
    own = api.node(g, include_relations=True, include_code=True).first()
    assert (own.container, own.code) == ("B", "    func g() { f() }")
    assert api.reindex()["files_indexed"] == 1  # A.swift, whose hash the index does not know
    assert {n.name for n in api.nodes.collect()} == {"Old", "B", "g"} and api.status().first().mode == "tree"
    assert api.imports("B").isEmpty()
    report = api.context_report("call g")
    assert [r.keyword for r in report["keywords"].collect()] == ["call"] and set(report) == {"nodes", "files", "keywords", "architecture"}
    api.close()


def test_resolving_by_three_ways(spark, sources, tmp_path):
    nodes, _ = swift.graph(sources(FILES))
    own = nodes.where("name = 'User'").first().id
    assert [r.id for r in search.resolve_symbol_conc(nodes, own).collect()] == [own]
    assert search.resolve_symbol_conc(nodes, "makeUser").first().name == "makeUser"
    assert search.resolve_symbol_conc(nodes, "etworkUser").first().name == "NetworkUserService"
    assert search.resolve_symbol_conc(nodes, "nothing").isEmpty()


def word_index(graph):
    """All that counts in the search index."""
    rows = lambda df: sorted(map(str, df.collect()))
    return [rows(graph.layers.live(t)) for t in ("postings", "dictionary", "totals", "names", "degrees", "counts")]


def many(seed, n=12):
    return {f"Sources/F{i}.swift": f"struct Thing{i + seed} {{\n    let part{seed}: Int\n    func run{i}() {{\n        run{(i + seed) % n}()\n        help()\n    }}\n}}\n" for i in range(n)}


def test_updates_equal_a_rebuild(spark, sources, tmp_path, monkeypatch):
    """Postings, dictionary, totals, degrees and counts after updates, and after layers became one."""
    graph, whole = (StoredGraph(spark, str(tmp_path / name)) for name in ("graph", "whole"))
    graph.index(sources(many(1, 5)))
    graph.index(sources({"Sources/F3.swift": "enum Mode { case on }\n", "Sources/F4.swift": "// nothing\n", "Sources/New.swift": "func help() {}\n"}))
    assert graph.layers.committed() == [1, 2]
    whole.index(sources({}))
    assert word_index(graph) == word_index(whole) and state(graph) == state(whole)
    monkeypatch.setattr("ravelin.plans.stored.MOST", 2)
    gone = graph.nodes.where("name = 'help'").select("file").distinct()
    graph.apply(graph.files.limit(0), graph.nodes.limit(0), graph.edges.limit(0), gone)
    assert graph.layers.committed() == [4]  # the third layer made it one
    rest = graph.files.select("path").collect()
    whole.index(sources({}).join(spark.createDataFrame(rest, "path string"), "path", "left_semi"), force=True)
    assert word_index(graph) == word_index(whole) and graph.search.document_frequency("help") == 0
    assert sorted((r.id, r.name) for r in graph.search.substring("THING1").collect()) == sorted((r.id, r.name) for r in whole.search.substring("THING1").collect())


def test_an_update_that_breaks_off_is_not_seen(spark, sources, tmp_path):
    graph = StoredGraph(spark, str(tmp_path / "graph"))
    graph.index(sources(many(1, 3)))
    before = state(graph), word_index(graph)
    nodes = graph.nodes.where("name = 'run1'").withColumn("name", F.lit("broken"))
    rows = {"nodes": nodes, "nodes_by_id": nodes, "names": nodes}
    kept = graph.layers._path
    graph.layers._path = lambda *parts: (_ for _ in ()).throw(OSError("lost")) if parts[0] == "log" and len(parts) == 2 else kept(*parts)
    with pytest.raises(OSError, match="lost"):
        graph.layers.add(rows, nodes.select("file"))
    graph.layers._path = kept
    assert (state(graph), word_index(graph)) == before
    graph.index(sources({"Sources/F1.swift": "struct Other {}\n"}))  # takes the place of what was left
    assert "broken" not in {n.name for n in graph.nodes.collect()} and "Other" in {n.name for n in graph.nodes.collect()}


def test_stored_search_equals_the_scan(spark, sources, tmp_path):
    graph = StoredGraph(spark, str(tmp_path / "graph"))
    graph.index(sources(FILES | many(2, 6)))
    graph.index(sources({"Sources/F5.swift": "final class RunnerService: UserService {\n    func run5() { makeUser(1) }\n}\n"}))
    rows = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
    for query, kind in (("run", None), ("run5", None), ("thing7 part", "class"), ("user*", "class"), ('"service"', None), ("fetch id", "method"), ("nothing", None)):
        terms = search.query_terms(query)
        own = graph.nodes if kind is None else graph.nodes.where(F.col("kind") == kind)
        assert rows(graph.search.bm25(terms, kind)) == rows(search.bm25(own, terms)), (query, kind)
    assert rows(graph.search.bm25([("run", True)], limit=3)) == rows(search.bm25(graph.nodes, [("run", True)], 3)) and graph.search.bm25([]).isEmpty()
    for text in ("Serv", "run1", "THING", "thing1", "zzz", "ru", "user"):
        assert {r.id for r in graph.search.substring(text).collect()} == {r.id for r in search.trigram(graph.nodes, text).collect()}, text


def test_bitmaps():
    import numpy as np

    from ravelin.plans.search_index import LISTED, _pack, _unpack

    for n in (1, LISTED, LISTED + 1, 1 << 16):
        numbers = np.random.default_rng(n).choice(1 << 16, n, replace=False)
        packed = _pack(numbers)
        assert len(packed) == (2 * n if n <= LISTED else 8192) and np.array_equal(_unpack(n, packed), np.sort(numbers))


def test_one_symbol(spark, sources, tmp_path):
    graph = StoredGraph(spark, str(tmp_path / "graph"))
    graph.index(sources(FILES | many(2, 6)))
    graph.index(sources({"Sources/F5.swift": "func help() {\n    run1()\n}\n"}))
    nodes, edges = graph.graph()
    key = lambda df: sorted((e.source, e.target, e.kind, e.line) for e in df.collect())
    for name in ("help", "run1", "User"):
        own = nodes.where(F.col("name") == name).first().id
        assert [r.name for r in graph.node(own).collect()] == [name]
        assert key(graph.incoming(own, "calls")) == key(edges.where((F.col("target") == own) & (F.col("kind") == "calls")))
        assert key(graph.callees(own)) == key(edges.where((F.col("source") == own) & (F.col("kind") == "calls")))
        assert key(graph.outgoing(own)) == key(graph.edges.where(F.col("source") == own))
    assert graph.counts().first().asDict() == {"files": graph.files.count(), "nodes": graph.nodes.count(), "edges": graph.edges.count()}


def test_a_key_reads_what_may_hold_it(spark, tmp_path):
    """The condition reaches the scan, and of the files of a table sorted by id all but one are left out by their bounds."""
    import pyarrow.parquet as pq

    graph = StoredGraph(spark, str(tmp_path / "graph"))
    rows = [(f"n{i:05}", "struct A {}") for i in range(10)]
    graph.index(spark.createDataFrame(rows, "path string, text string"))
    plan = graph.node("x")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,x)]" in plan
    plan = graph.search.postings([("view", True)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term,view)" in plan and "LessThanOrEqual(term,view" in plan
    nodes = spark.range(20_000).select(F.concat(F.lit("id"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("f").alias("file"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        graph.layers.add({"nodes_by_id": nodes.select(*(F.col(f.name) if f.name in ("id", "file") else F.lit("0" if f.dataType.simpleString() == "string" else None).cast(f.dataType).alias(f.name) for f in graph.layers.layouts["nodes"].schema))})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "graph" / "nodes_by_id" / "layer=2").glob("*.parquet"))
    holds = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups = [meta.row_group(g).column(meta.schema.to_arrow_schema().get_field_index("id")).statistics for g in range(meta.num_row_groups)]
        holds += any(s.min <= "id012345" <= s.max for s in groups)
    assert len(files) > 1 and holds == 1 and graph.node("id012345").count() == 1
