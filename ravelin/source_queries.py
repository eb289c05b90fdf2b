"""Queries on Swift-like files written from the supplier table: scanner, calls, state, all rules, and the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import analytics as A
from ravelin.operators import rules as R
from ravelin.plans import swift_files
from ravelin.plans.stored import StoredGraph
from ravelin.plans.tables import new_dir, table
from ravelin.sources import swift, syntax

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_INDEXED: dict[tuple[str, str], StoredGraph] = {}


def over_files(name: str, sql: str):
    """Registers a function of the source files under name, with SQL over swift_files."""

    def add(query: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: query(swift_files.sources(spark, sf_dir))
        ORACLES[name] = swift_files.SQL + sql
        return query

    return add


def rows(*lines: str) -> str:
    """SQL: for each file the rows of values that hold for it; each line is `values` or `values WHEN test`."""
    each = []
    for line in lines:
        values, _, test = line.partition(" WHEN ")
        each.append(f"SELECT file, k, {values} FROM swift_files" + (f" WHERE {test}" if test else ""))
    return " UNION ALL ".join(each)


# what the scanner sees: neither comments (nested) nor the text of strings of several lines
_DECLARED = rows(
    "'Foundation' AS name, 'import' AS kind, 1 AS line, 1 AS end_line", "'Supplier' || k, 'class', 5, 30", "'total', 'property', 6, 6", "'delegate', 'property', 7, 7",
    "'note', 'property', 8, 8", "'load', 'method', 11, 18", "'d', 'property', 17, 17", "'show', 'method', 19, 29", "'total', 'property', 28, 28",
    "'Supplier' || k, 'extension', 31, 37", "'poll', 'method', 32, 36", "'f', 'property', 35, 35",
)
over_files("px_declarations", f"SELECT file, name, kind, line, end_line FROM ({_DECLARED})")(lambda s: swift.declarations(s).select("file", "name", "kind", "line", "end_line"))
over_files("px_attributes", "SELECT file, 'Supplier' || k AS name, CASE WHEN balance > 5000 THEN '@MainActor' ELSE '' END AS attributes FROM swift_files UNION ALL SELECT file, 'total', CASE WHEN k % 3 = 0 THEN '@Published' ELSE '' END FROM swift_files")(
    lambda s: swift.declarations(s).where("kind = 'class' OR name = 'total' AND line = 6").select("file", "name", F.array_join("attributes", ",").alias("attributes"))
)
over_files("px_contains", """SELECT 'ts::' || file || '::Supplier' || k || '::4' AS source, 'ts::' || file || '::' || name || '::' || pos AS target
    FROM swift_files, (VALUES ('total', 5), ('delegate', 6), ('note', 7), ('load', 10), ('show', 18)) v(name, pos)
    UNION ALL SELECT 'ts::' || file || '::load::10', 'ts::' || file || '::d::16' FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::show::18', 'ts::' || file || '::total::27' FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::Supplier' || k || '::30', 'ts::' || file || '::poll::31' FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::poll::31', 'ts::' || file || '::f::34' FROM swift_files""")(
    lambda s: swift.graph(s)[1].where("kind = 'contains'").select("source", "target")
)
over_files("px_conformance", "SELECT 'ts::' || file || '::Supplier' || k || '::4' AS source, 'synthetic::NSObject' AS target FROM swift_files")(
    lambda s: swift.graph(s)[1].where("kind = 'conformsTo'").select("source", "target")
)
over_files("px_extension", "SELECT 'ts::' || file || '::Supplier' || k || '::30' AS source, 'synthetic::Supplier' || k AS target FROM swift_files")(
    lambda s: swift.graph(s)[1].where("kind = 'extendsType'").select("source", "target")
)
_CALLED = rows(
    "'count' AS name, 9 AS line, '__top_level__::0' AS caller", "'reserveCapacity', 12, 'load::10' WHEN k % 4 = 0", "'step', 12, 'load::10' WHEN k % 4 <> 0", "'append', 14, 'load::10'", "'decode', 17, 'load::10'",
    "'ForEach', 21, 'show::18'", "'row', 21, 'show::18'", "'Image', 22, 'show::18'", "'accessibilityLabel', 23, 'show::18' WHEN k % 2 = 1", "'plain', 23, 'show::18' WHEN k % 2 = 0",
    "'load', 26, 'show::18'", "'local', 28, 'show::18'", "'scheduledTimer', 33, 'poll::31'", "'refresh', 33, 'poll::31'", "'row', 34, 'poll::31'", "'custom', 35, 'poll::31'",
)
over_files("px_calls", f"SELECT file, line, name FROM ({_CALLED})")(lambda s: swift.calls(s))
over_files("join_caller_interval", f"SELECT 'ts::' || file || '::' || caller AS source, 'name::' || name AS target, line FROM ({_CALLED})")(
    lambda s: swift.graph(s)[1].where("kind = 'calls'").select("source", "target", "line")
)
over_files("scan_tree_sitter", "SELECT file, 34 AS code_lines, 11 AS braces FROM swift_files")(
    lambda s: syntax.pieces(s).where("i > 0").groupBy("file").agg(
        F.countDistinct(F.when(F.col("piece").rlike(r"\S"), F.col("line"))).cast("int").alias("code_lines"), F.count_if(F.col("piece") == "{").cast("int").alias("braces")
    )
)

# what functions do with the properties of their types
over_files("mutable_state", """SELECT 'ts::' || file || '::load::10' AS source, 'ts::' || file || '::total::5' AS target, 'mutates' AS kind, 15 AS line FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::show::18', 'ts::' || file || '::note::7', 'references', 23 FROM swift_files""")(
    lambda s: swift.graph(s)[1].where("kind IN ('mutates', 'references')").select("source", "target", "kind", "line")
)
over_files("concurrency_warnings", """SELECT 'ts::' || file || '::load::10' AS id, 'no isolation is stated; mutable state outside any actor: total'
        || CASE WHEN k % 3 = 0 THEN '; published properties outside the main actor' ELSE '' END AS warnings FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::show::18', 'no isolation is stated; mutable state outside any actor: note' FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::Supplier' || k || '::4', CASE WHEN balance > 5000 THEN '' ELSE 'no isolation is stated' END FROM swift_files
    UNION ALL SELECT 'ts::' || file || '::Supplier' || k || '::30', 'no isolation is stated' FROM swift_files""")(
    lambda s: A.concurrency(*swift.graph(s)).where(F.col("id").rlike("::(load|show|Supplier[0-9]+)::[0-9]+$")).select("id", F.array_join("warnings", "; ").alias("warnings"))
)

#: What each rule finds in the files, by line.
FOUND = {
    "MEM-001": "25 WHEN k % 7 <> 0", "MEM-002": "7 WHEN k % 2 <> 0", "PERF-004": "13 WHEN k % 4 <> 0", "COD-002": "17 WHEN k % 5 = 0", "SUI-005": "21 WHEN k % 3 <> 1",
    "A11Y-001": "22 WHEN k % 2 = 0", "ARCH-005": "5 WHEN k % 3 = 0", "NRG-001": "33 WHEN k % 5 = 1", "NRG-002": "33 WHEN true", "MEM-003": "33 WHEN true", "MOD-005": "34 WHEN k % 4 = 1",
    "A11Y-002": "35 WHEN k % 2 <> 0",
}
_FOUND = rows(*(f"'{rule}' AS rule, {found.replace(' WHEN', ' AS line WHEN', 1)}" for rule, found in FOUND.items()))
over_files("audit_swift", f"SELECT file, rule, line FROM ({_FOUND})")(lambda s: R.findings(s).select("file", "rule", "line"))
for _rule, _found in FOUND.items():
    over_files("rule_" + _rule.lower().replace("-", "_"), "SELECT file, line FROM (" + rows(_found.replace(" WHEN", " AS line WHEN", 1)) + ")")(
        lambda s, _rule=_rule: R.findings(s, [r for r in R.RULES if r.id == _rule]).select("file", "line")
    )
_SEVERITY = " ".join(f"WHEN '{r.id}' THEN '{r.severity}'" for r in R.RULES if r.id in FOUND)
over_files("audit_swift_severities", f"SELECT CASE rule {_SEVERITY} END AS severity, count(*) AS n, count(DISTINCT file) AS files FROM ({_FOUND}) GROUP BY 1")(
    lambda s: R.audit(s).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))
)

# the stored index


def indexed(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """The files indexed into a new folder."""
    stored = StoredGraph(spark, new_dir(spark, "index"))
    stored.index(swift_files.sources(spark, sf_dir))
    return stored


def full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = indexed(spark, sf_dir)
    _INDEXED[spark.sparkContext.applicationId, sf_dir] = stored
    return stored.counts()


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers whose key divides by 100 have another function now; what is stored is brought up to date."""
    stored = _INDEXED.pop((spark.sparkContext.applicationId, sf_dir), None) or indexed(spark, sf_dir)  # each update has an index of its own
    changed = F.col("path").rlike(r"Supplier(0|[0-9]*00)\.swift$")
    more = F.concat(F.regexp_replace("text", r"\}$", ""), F.lit("    func more() { load() }\n}"))
    now = swift_files.sources(spark, sf_dir).withColumn("text", F.when(changed, more).otherwise(F.col("text")))
    done = stored.index(table(now, "sources"))
    return stored.counts().withColumn("files_indexed", F.lit(done["files_indexed"]))


QUERIES |= {"full_index": full_index, "incremental_index": incremental_index}
# a file has 12 symbols, 9 containments, a conformance, an extension, 2 uses of state and 14 different calls
_PER_FILE = "CAST(count(*) AS BIGINT) AS files, CAST(12 * count(*) AS BIGINT) AS nodes, CAST(27 * count(*) AS BIGINT) AS edges"
ORACLES["full_index"] = swift_files.SQL + f"SELECT {_PER_FILE} FROM swift_files"
ORACLES["incremental_index"] = swift_files.SQL + """SELECT CAST(count(*) AS BIGINT) AS files, CAST(12 * count(*) + count(*) FILTER (k % 100 = 0) AS BIGINT) AS nodes,
    CAST(27 * count(*) + 2 * count(*) FILTER (k % 100 = 0) AS BIGINT) AS edges, CAST(count(*) FILTER (k % 100 = 0) AS INTEGER) AS files_indexed FROM swift_files"""  # fmt: skip
