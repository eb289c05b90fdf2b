"""A stored graph whose tables are written when they are first read: the same answers, and no tables that nobody asked for."""

import os

import pytest
from pyspark.sql import functions as F

from ravelin import stored_queries
from ravelin.plans import stored, tables
from ravelin.sources import swift

TEXTS = [
    ("A.swift", "protocol Service {\n    func fetch() -> User\n}\n\nclass Network: Service {\n    func fetch() -> User {\n        return makeUser()\n    }\n}\n"),
    ("B.swift", "func makeUser() -> User {\n    return User(id: 1)\n}\n"), ("C.swift", "struct User {\n    let id: Int\n}\n"),
]


@pytest.fixture
def parsed(spark):
    return tuple(tables.table(rows, "parsed") for rows in swift.graph(spark.createDataFrame(TEXTS, "path string, text string")))


def there(folder):
    return {name for name in os.listdir(folder) if name != "log"}


def temporary(spark):
    return [name for name in os.listdir(f"{tables.shared_dir(spark).removeprefix('file://')}/ravelin") if name.startswith(("symbols-", "postings-"))]


def rows(df):
    return sorted(map(str, df.drop("number", "block", "bits", "last_indexed").collect()))


def test_a_question_writes_the_tables_that_it_reads(spark, tmp_path, parsed):
    nodes, edges = parsed
    files, before = stored_queries._files(nodes), temporary(spark)
    whole, later = (stored.StoredGraph(spark, str(tmp_path / name)) for name in ("whole", "later"))
    whole.apply(files, nodes, edges, nodes.select("file").limit(0), whole=True)
    assert temporary(spark) == before  # what the search index was made from is gone
    later.put_later(lambda: files, lambda: nodes, lambda: edges)
    assert there(later.layers.folder) == {"gone"}
    caller = nodes.where("name = 'fetch' AND file = 'A.swift'").orderBy(F.desc("line")).first().id
    direct = "edges_by_source"
    assert rows(later.outgoing(caller)) == rows(whole.outgoing(caller)) != [] and there(later.layers.folder) == {"gone", direct}
    assert rows(later.callees("none")) == [] and there(later.layers.folder) == {"gone", direct}
    assert rows(later.callees(caller)) == rows(whole.callees(caller)) != [] and there(later.layers.folder) == {"gone", direct, "names"}
    assert rows(later.search.substring("user")) == rows(whole.search.substring("user")) != []
    assert there(later.layers.folder) == {"gone", direct, "names", "symbols", "grams"}
    new = nodes.where("file = 'B.swift'").withColumn("name", F.concat("name", F.lit("Renewed")))
    for graph in (whole, later):  # while most tables of the first layer are not written
        graph.apply(stored_queries._files(new), new, edges.where("file = 'B.swift'").limit(0), new.select("file").distinct())
    for name in stored.LAYOUTS:
        assert rows(later.layers.live(name)) == rows(whole.layers.live(name)), name
    assert there(later.layers.folder) == there(whole.layers.folder) == {"gone", *stored.LAYOUTS}
    assert rows(later.search.substring("renewed")) == rows(whole.search.substring("renewed")) != []
    assert rows(later.search.bm25([("user", True)])) == rows(whole.search.bm25([("user", True)]))
    later.layers.compact()
    assert rows(later.nodes) == rows(whole.nodes) and later.layers.committed() == [3]


def test_a_registered_query_writes_its_tables_only(spark):
    stored_queries.QUERIES["stored_callees"](spark, "/root/testdata/sf0.001").collect()
    graph = stored_queries.graph(spark, "/root/testdata/sf0.001")
    assert there(graph.layers.folder.removeprefix("file://")) == {"gone", "edges_by_source"}
