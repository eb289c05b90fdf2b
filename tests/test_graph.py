"""The hand-built graph of three files, random graphs, and the service's tools over them."""

import json
import random

import pytest

from ravelin.api import CodeGraph
from ravelin.functions.paths import glob_regex, module_of_path, should_include, truncated_signature
from ravelin.operators import analytics, lookup, search, store, traverse
from ravelin.schema import EDGES, NODES

from pyspark.sql import functions as F

SYMBOLS = [
    ("usr:User", "User", "App.User", "struct", "Sources/Models/User.swift"),
    ("usr:UserService", "UserService", "App.UserService", "protocol", "Sources/Services/UserService.swift"),
    ("usr:NetworkUserService", "NetworkUserService", "App.NetworkUserService", "class", "Sources/Services/UserService.swift"),
    ("usr:UserVM", "UserListViewModel", "App.UserListViewModel", "class", "Sources/ViewModels/UserVM.swift"),
    ("usr:fetchUser", "fetchUser", "App.UserService.fetchUser", "method", "Sources/Services/UserService.swift"),
    ("usr:loadUsers", "loadUsers", "App.UserListViewModel.loadUsers", "method", "Sources/ViewModels/UserVM.swift"),
]
LINKS = [("usr:loadUsers", "usr:fetchUser", "calls"), ("usr:NetworkUserService", "usr:UserService", "conformsTo"), ("usr:UserVM", "usr:User", "references")]


def node(i, name, qualified, kind, file):
    return (i, name, qualified, kind, None, file, 1, 1, 10, 1, None, [], "Internal", None, None, 10, 1, None)


@pytest.fixture(scope="module")
def app(spark):
    nodes = spark.createDataFrame([node(*s) for s in SYMBOLS], NODES)
    edges = spark.createDataFrame([(a, b, k, None, None, None, False) for a, b, k in LINKS], EDGES)
    return CodeGraph(nodes, edges)


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.collect())


def test_tools(app):
    assert "usr:User" in ids(app.search("User"))
    assert ids(app.search("User", kind="protocol")) == ["usr:UserService"]
    assert len(ids(app.search("*"))) == len(ids(app.search(""))) == 6
    assert ids(app.node("usr:User")) == ["usr:User"]
    with pytest.raises(ValueError):
        app.resolve("NothingLikeThis")
    assert ids(app.callers("usr:fetchUser"), "source") == ["usr:loadUsers"]
    assert ids(app.callers("fetchUser", transitive=True), "source") == ["usr:loadUsers"]
    assert ids(app.callees("usr:loadUsers"), "target") == ["usr:fetchUser"]
    assert app.callers("usr:loadUsers").count() == 0
    assert app.references("usr:User").count() >= 1
    assert ids(app.hierarchy("usr:UserService")) == ["usr:NetworkUserService"]
    assert ids(app.hierarchy("usr:NetworkUserService", "supertypes")) == ["usr:UserService"]
    assert app.files().count() == 3 and app.files("Sources/Services").count() == 1
    with pytest.raises(json.JSONDecodeError):
        app.boundaries("not json")
    s = app.status().first()
    assert (s.files, s.nodes, s.edges) == (3, 6, 3)
    assert app.impact("fetchUser").first().direct == 1
    assert "usr:loadUsers" in ids(app.context("load users quickly: loadUsers"))
    assert app.complexity(limit=3).count() == 3
    assert {r.module for r in app.coupling().collect()} == {"Sources/Models", "Sources/Services", "Sources/ViewModels"}


def random_graph(spark, n, links):
    nodes = spark.createDataFrame([node(f"usr:node_{i}", f"Node_{i}", f"Mod.Node_{i}", "function", f"Sources/file_{i}.swift") for i in range(n)], NODES)
    edges = spark.createDataFrame([(f"usr:node_{a}", f"usr:node_{b}", "calls", f"Sources/file_{a}.swift", k + 1, None, False) for k, (a, b) in enumerate(links)], EDGES)
    return CodeGraph(nodes, edges)


def test_known_graphs(spark):
    ring = random_graph(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert [len(r.path) for r in ring.cycles().collect()] == [3]
    long = random_graph(spark, 8, [(i, (i + 1) % 6) for i in range(6)] + [(6, 0), (3, 7)])
    assert [[p[-7] for p in r.path] for r in long.cycles().collect()] == [list("012345")]
    chain = random_graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    assert chain.cycles().count() == 0
    shallow, deep = (chain.impact("usr:node_3", d).first().transitive for d in (2, 3))
    assert (shallow, deep) == (2, 3)
    assert chain.impact("usr:node_0").first().transitive == 0
    assert ids(random_graph(spark, 3, [(0, 1)]).dead_code()) == ["usr:node_0", "usr:node_2"]
    star = random_graph(spark, 4, [(0, 1), (0, 2), (0, 3)])
    assert star.complexity().where("id = 'usr:node_0'").first().fan_out == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 14
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(25)]
    g = random_graph(spark, n, links)
    level = {0: 0}
    for d in range(1, 4):
        for a, b in links:
            if level.get(b) == d - 1 and a not in level:
                level[a] = d
    seeds = spark.createDataFrame([("usr:node_0",)], "seed string")
    got = {r.id: r.level for r in traverse.reached(g.edges, seeds, 3).collect()}
    assert got == {f"usr:node_{k}": v for k, v in level.items()}
    reach = {(a, b) for a, b in links if a != b}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    pairs = spark.createDataFrame(links, "a int, b int")
    assert sorted(r.node for r in traverse.on_cycles(pairs).collect()) == sorted(a for a, b in reach if a == b)
    of = {a: min(b for b in range(n) if (a, b) in reach and (b, a) in reach) for a in range(n) if (a, a) in reach}
    assert {r.node: r.component for r in traverse.strong_components(pairs).collect()} == of
    witnesses = [r.path for r in traverse.cycle_witnesses(pairs).collect()]
    assert sorted(w[0] for w in witnesses) == sorted(set(of.values())) and all((a, b) in links for w in witnesses for a, b in zip(w, [*w[1:], w[0]]))
    simple = {tuple(r.path) for r in traverse.simple_cycles(pairs, 3).collect()}
    s = {(a, b) for a, b in links if a != b}
    want = {(a, b) for a, b in s if a < b and (b, a) in s} | {(a, b, c) for a, b in s for c in range(n) if a < b and a < c and b != c and (b, c) in s and (c, a) in s}
    assert simple == want


def test_store_is_idempotent(spark, app):
    loads = app.nodes.withColumn("load_seq", F.lit(0)).unionByName(app.nodes.withColumn("load_seq", F.lit(1)))
    assert store.keep_last(loads, "id").count() == 6
    both = app.edges.withColumn("load_seq", F.lit(0)).unionByName(app.edges.withColumn("load_seq", F.lit(1)))
    assert store.keep_first_edges(both).count() == 3


def test_keywords(spark):
    got = spark.range(1).select(search.keywords(F.lit("add search functionality to schedule screen")).alias("k")).first().k
    assert got == ["search", "schedule"]


def test_paths(spark):
    rows = spark.createDataFrame([("Sources/A/B/f.swift",), ("f.swift",), ("Pods/x.swift",)], "p string")
    assert [r[0] for r in rows.select(module_of_path(F.col("p"), 2)).collect()] == ["Sources/A", "", "Pods"]
    assert [r[0] for r in rows.select(should_include(F.col("p"), ["**/*.swift"], ["Pods/**"])).collect()] == [True, True, False]
    assert glob_regex("**/{A,B}/*.s?") == "^(?:.*/)?(?:A|B)/.*\\.s.$"
    long = spark.range(1).select(truncated_signature(F.lit("  " + "x" * 300 + "\nrest"))).first()[0]
    assert long == "x" * 200 + "..."


def test_isolation(spark):
    rows = spark.createDataFrame([(["@MainActor"], None), (["@DataActor"], None), (["nonisolated"], None), ([], "actor Store {"), (None, None)], "attributes array<string>, signature string")
    assert [r[0] for r in rows.select(analytics.isolation_of()).collect()] == ["MainActor", "DataActor", "nonisolated", "actor", "unknown"]


def test_decoding(app):
    odd = app.nodes.limit(1).withColumn("kind", F.lit("weird")).withColumn("access_level", F.lit("odd")).withColumn("attributes", F.lit(None).cast("array<string>"))
    r = lookup.decoded_nodes(odd).first()
    assert (r.kind, r.access_level, r.attributes) == ("function", "Internal", [])


def test_watch(spark, tmp_path):
    from ravelin.operators.store import with_hash
    from ravelin.streaming.watch import start

    folder, seen = tmp_path / "in", []
    schema = "path string, text string, load_seq int"
    spark.createDataFrame([("A.swift", "a", 0), ("A.swift", "b", 1), ("B.swift", "same", 0), (".build/C.swift", "x", 0), ("x/.build/D.swift", "x", 0), ("note.txt", "x", 0)], schema).write.json(str(folder))
    stored = with_hash(spark.createDataFrame([("B.swift", "same")], "path string, text string"), "text").select("path", "hash")
    query = start(spark.readStream.schema(schema).json(str(folder)), lambda: stored, lambda rows, n: seen.extend((r.path, r.text) for r in rows.collect()), str(tmp_path / "state"), once=True)
    query.awaitTermination(60)
    assert sorted(seen) == [("A.swift", "b")]
