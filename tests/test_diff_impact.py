"""The impact of changed files: against a search by hand, and without a row for each pair of symbol and seed."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import analytics, traverse


def graph(spark, files, links):
    nodes = spark.createDataFrame([(f"n{k}", f) for k, f in enumerate(files)], "id string, file string")
    return nodes, spark.createDataFrame([(f"n{a - 1}" if a else None, f"n{b - 1}", k) for a, b, k in links], "source string, target string, kind string")


def by_hand(files, links, changed, depth):
    """affected files and direct impact; links count from 1."""
    seeds, hit = {k for k, f in enumerate(files) if f in changed}, set()
    for s in seeds:
        near = {s}
        for _ in range(depth):
            near |= {a - 1 for a, b, _ in links if a and b - 1 in near}
        hit |= near - {s}
    direct = {(a, b) for a, b, _ in links if a and b - 1 in seeds and a != b}
    return {files[k] for k in hit}, len(direct), len({a for a, b, k in links if a and b - 1 in seeds and k in analytics.REACHED_BY}), len(seeds)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sent", [traverse.SENT, 0])
def test_random_graphs(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(traverse, "SENT", sent)
    rng = random.Random(seed)
    files = [rng.choice(["A.swift", "B.swift", "C.swift", "D.swift", "App/Tests/ETests.swift"]) for _ in range(16)]
    links = [(rng.randrange(1, 17), rng.randrange(1, 17), rng.choice(["calls", "conformsTo", "references", None])) for _ in range(rng.randrange(8, 26))] + [(0, 1, "calls"), (1, 1, "calls")]
    nodes, edges = graph(spark, files, links)
    changed = spark.createDataFrame([("A.swift",), ("B.swift",), ("A.swift",), ("gone.swift",)], "file string")
    hit, direct, by, symbols = by_hand(files, links, {"A.swift", "B.swift"}, 3)
    assert sorted(r.file for r in analytics.affected_files(nodes, edges, changed).collect()) == sorted(hit)
    r = analytics.diff_impact(nodes, edges, changed).first()
    assert (r.symbols, r.total_direct_impact, r.total_transitive_impact, r.files + r.tests, r.tests) == (symbols, direct, by, len(hit), sum("Tests" in f for f in hit))


def test_a_file_that_only_its_own_symbols_reach(spark):
    changed = spark.createDataFrame([("A",)], "file string")
    for links, hit in (([(1, 1, "calls")], set()), ([(1, 2, "calls")], {"A"}), ([(1, 3, "calls"), (3, 2, "calls")], {"A", "B"}), ([(1, 3, "calls"), (3, 1, "calls")], {"B"})):
        nodes, edges = graph(spark, ["A", "A", "B"], links)
        assert {r.file for r in analytics.affected_files(nodes, edges, changed).collect()} == hit
    assert analytics.diff_impact(nodes, edges, spark.createDataFrame([("none",)], "file string")).first().asDict() == {
        "symbols": 0, "total_direct_impact": 0, "total_transitive_impact": 0, "files": 0, "tests": 0, "risk": "none"
    }


def test_rows_grow_with_symbols_not_with_pairs(spark, monkeypatch):
    """60 seeds, a hub that calls them all and 60 callers of it: 3,660 pairs of symbol and seed, 61 symbols."""
    nodes = spark.range(121).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") < 60, "A").otherwise("B").alias("file"))
    far = spark.range(60, 120).select(F.concat(F.lit("n"), "id").alias("source"), F.lit("n120").alias("target"))
    edges = spark.range(60).select(F.lit("n120").alias("source"), F.concat(F.lit("n"), "id").alias("target")).unionByName(far).withColumn("kind", F.lit("calls"))
    rows, own = {}, traverse.table

    def counted(df, name, *more):
        out = own(df, name, *more)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(traverse, "table", counted)
    r = analytics.diff_impact(nodes, edges, spark.createDataFrame([("A",)], "file string")).first()
    assert (r.symbols, r.total_direct_impact, r.total_transitive_impact, r.files) == (60, 60, 1, 1)
    assert rows["level"] == 61
