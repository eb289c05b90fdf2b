"""The registered queries over the projected graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import analytics as A
from ravelin.operators import lookup as L
from ravelin.operators import rules as R
from ravelin.operators import search as S
from ravelin.operators import sinks as K
from ravelin.operators import store as M
from ravelin.operators import traverse as V
from ravelin.plans import projection
from ravelin.plans.tables import table
from ravelin.sources import index_dump as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Symbols that the point queries ask for. They exist at every scale.
PART, SUPPLIER, ORDER = "part::1", "supp::1", "ord::1"
LAYERS = [("Parts", "Sources/Parts/**"), ("Suppliers", "Sources/*/*/Suppliers.swift"), ("Customers", "Sources/*/*/Customers.swift"), ("Orders", "Sources/Orders/*")]
RULES = [("Parts", "Suppliers", False), ("Orders", "Parts", True), ("Customers", "Orders", False)]


def graph(name: str, sql: str):
    """Registers a function of nodes and edges under name, with SQL over the same two."""

    def add(query: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: query(projection.nodes(spark, sf_dir), projection.edges(spark, sf_dir))
        ORACLES[name] = projection.SQL + sql
        return query

    return add


EDGE = ("source", "target", "kind", "line")
NODE = ("id", "name", "kind", "file", "line")

graph("agg_stats", "SELECT (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(
    lambda n, e: L.stats(n, e)
)
graph("node_lookup", f"SELECT id, name, kind, file, line FROM nodes WHERE id = '{PART}'")(lambda n, e: L.node_lookup(n, PART).select(*NODE))
graph("node_name_like", "SELECT id, name, kind, file, line FROM nodes WHERE name ILIKE '%router%'")(lambda n, e: L.node_name_like(n, "router").select(*NODE))
graph("node_name_pattern", "SELECT id, name, kind, file, line FROM nodes WHERE name ILIKE '%presenter%' AND kind = 'class'")(
    lambda n, e: L.node_name_like(n, "presenter", "class").select(*NODE)
)
graph("nodes_all", "SELECT id, name, kind, file, line FROM nodes ORDER BY id LIMIT 100")(lambda n, e: L.nodes_all(n, 100).select(*NODE))
graph("nodes_path_prefix", "SELECT id, name, kind, file, line FROM nodes WHERE lower(file) LIKE 'sources/parts/%'")(
    lambda n, e: L.nodes_path_prefix(n, "sources/parts/").select(*NODE)
)
graph("nodes_in_file", "SELECT id, name, kind, file, line FROM nodes WHERE file = 'Sources/Orders/1-URGENT.swift'")(
    lambda n, e: L.nodes_in_file(n, "Sources/Orders/1-URGENT.swift").select(*NODE)
)
graph("files_list", "SELECT file AS path, CAST(count(*) AS INTEGER) AS symbol_count FROM nodes WHERE lower(file) LIKE 'sources/%' GROUP BY file")(
    lambda n, e: L.files_list(L.files_of(n), "Sources/")
)
graph("edges_by", f"SELECT source, target, kind, line FROM edges WHERE source = '{SUPPLIER}' ORDER BY source, target, kind, line LIMIT 50")(
    lambda n, e: L.edges_by(e, "source", SUPPLIER, (), 50).select(*EDGE)
)
for _name, _side, _id, _kinds, _call in (
    ("callers", "target", PART, "'calls'", L.callers),
    ("callees", "source", ORDER, "'calls'", L.callees),
    ("references", "target", PART, None, L.references),
    ("all_incoming", "target", SUPPLIER, None, L.references),
    ("all_outgoing", "source", SUPPLIER, None, L.all_outgoing),
    ("subtypes", "target", PART, "'conformsTo', 'inheritsFrom'", L.subtypes),
    ("supertypes", "source", SUPPLIER, "'conformsTo', 'inheritsFrom'", L.supertypes),
    ("extensions", "target", SUPPLIER, "'extendsType'", L.extensions),
    ("conformances", "source", SUPPLIER, "'conformsTo'", L.conformances),
):
    graph(_name, f"SELECT source, target, kind, line FROM edges WHERE {_side} = '{_id}'" + (f" AND kind IN ({_kinds})" if _kinds else ""))(
        lambda n, e, _id=_id, _call=_call: _call(e, _id).select(*EDGE)
    )
graph("row_decode_node", "SELECT id, kind, access_level, len(attributes) AS attribute_count, file || ':' || line AS location FROM nodes")(
    lambda n, e: L.decoded_nodes(n).select(
        "id", "kind", "access_level", F.size("attributes").cast("long").alias("attribute_count"), F.concat("location.file", F.lit(":"), "location.line").alias("location")
    )
)
graph("row_decode_edge", "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS with_location FROM edges GROUP BY kind")(
    lambda n, e: L.decoded_edges(e).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("location").alias("with_location"))
)
graph("hierarchy", f"SELECT DISTINCT n.id, n.name, n.kind, n.file, n.line FROM nodes n JOIN edges e ON e.source = n.id WHERE e.target = '{PART}' AND e.kind IN ('conformsTo', 'inheritsFrom')")(
    lambda n, e: L.hierarchy(n, e, PART).select(*NODE)
)
graph("node_detailed", f"""
SELECT id, name, (SELECT coalesce(array_to_string(list_sort(list(DISTINCT target)), ','), '') FROM edges WHERE source = '{SUPPLIER}' AND kind = 'conformsTo') AS conforms_to,
       (SELECT count(*) FROM edges WHERE target = '{SUPPLIER}' AND kind = 'extendsType') AS extension_count FROM nodes WHERE id = '{SUPPLIER}'""")(
    lambda n, e: L.node_detailed(n, e, SUPPLIER).select("id", "name", F.array_join("conforms_to", ",").alias("conforms_to"), "extension_count")
)

DEGREES = """, fi AS (SELECT target AS id, count(*) AS fan_in FROM edges GROUP BY target), fo AS (SELECT source AS id, count(*) AS fan_out FROM edges GROUP BY source),
deg AS (SELECT n.id, n.name, n.kind, n.file, n.access_level, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
        CAST(coalesce(fan_in, 0) * 1.5 + coalesce(fan_out, 0) AS DOUBLE) AS score
        FROM nodes n LEFT JOIN fi USING (id) LEFT JOIN fo USING (id)) """
graph("complexity", DEGREES + "SELECT id, name, kind, file, fan_in, fan_out, score FROM deg")(lambda n, e: A.complexity(n, e))
graph("topk_complexity", DEGREES + "SELECT id, fan_in, fan_out, score FROM deg ORDER BY score DESC, id LIMIT 30")(
    lambda n, e: A.complexity(n, e, limit=30).select("id", "fan_in", "fan_out", "score")
)
graph("agg_count_incoming", "SELECT target AS id, count(*) AS n FROM edges GROUP BY target")(lambda n, e: e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n")))
graph("agg_count_outgoing", "SELECT source AS id, count(*) AS n FROM edges GROUP BY source")(lambda n, e: e.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")))
graph("join_degree_lookup", DEGREES + "SELECT id, fan_in, fan_out FROM deg WHERE kind = 'class'")(
    lambda n, e: A.degrees(n.where("kind = 'class'"), e).select("id", "fan_in", "fan_out")
)
graph("agg_file_stats", DEGREES + """SELECT file, count(*) AS symbols, round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out,
    greatest(max(score), CAST(0 AS DOUBLE)) AS max_score FROM deg GROUP BY file""")(
    lambda n, e: A.file_stats(A.complexity(n, e)).select("file", "symbols", F.round("avg_fan_in", 6).alias("avg_fan_in"), F.round("avg_fan_out", 6).alias("avg_fan_out"), "max_score")
)
DEAD = DEGREES + """, dead AS (SELECT id, name, kind, file FROM deg WHERE fan_in = 0 AND kind NOT IN ('protocol', 'extension', 'import', 'associatedType', 'module')
    AND access_level NOT IN ('Public', 'Open') AND name NOT IN ('body', 'main') AND NOT starts_with(name, 'application(') AND NOT starts_with(name, 'scene(')
    AND NOT (contains(file, '/Tests/') OR contains(file, 'Tests.swift')) AND NOT (kind IN ('class', 'struct', 'enum') AND fan_out > 0)) """  # fmt: skip
graph("dead_code", DEAD + "SELECT id, name, kind, file FROM dead")(lambda n, e: A.dead_code(n, e).select("id", "name", "kind", "file"))
graph("antijoin_dead", "SELECT id FROM nodes WHERE id NOT IN (SELECT target FROM edges)")(lambda n, e: n.join(e.select(F.col("target").alias("id")), "id", "left_anti").select("id"))
graph("agg_dead_pct", DEAD + "SELECT (SELECT count(*) FROM nodes) AS total, (SELECT count(*) FROM dead) AS dead, round((SELECT count(*) FROM dead) * 100.0 / (SELECT count(*) FROM nodes), 6)::DOUBLE AS dead_percentage")(
    lambda n, e: A.dead_percentage(n, A.dead_code(n, e)).withColumn("dead_percentage", F.round("dead_percentage", 6))
)

CROSS = """, crossing AS (SELECT DISTINCT s.file AS source_file, t.file AS target_file FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE s.file <> t.file) """


def file_pairs(n: DataFrame, e: DataFrame) -> DataFrame:
    """Distinct pairs of different files that an edge leads across."""
    of = n.select("id", "file")
    joined = e.select("source", "target").join(of.withColumnsRenamed({"id": "source", "file": "source_file"}), "source")
    joined = joined.join(of.withColumnsRenamed({"id": "target", "file": "target_file"}), "target")
    return joined.where("source_file <> target_file").select("source_file", "target_file").distinct()


graph("join_cross_file", CROSS + "SELECT source_file, target_file FROM crossing")(file_pairs)
graph("set_distinct_files", "SELECT DISTINCT file FROM nodes")(lambda n, e: n.select("file").distinct())
graph("join_affected_files", f"SELECT DISTINCT n.file FROM nodes n JOIN edges e ON (e.source = n.id OR e.target = n.id) WHERE e.source IN ('{SUPPLIER}', '{PART}') OR e.target IN ('{SUPPLIER}', '{PART}')")(
    lambda n, e: n.join(
        (own := e.where(F.col("source").isin(SUPPLIER, PART) | F.col("target").isin(SUPPLIER, PART)))
        .select(F.col("source").alias("id")).unionByName(own.select(F.col("target").alias("id"))).distinct(), "id", "left_semi",
    ).select("file").distinct()
)
pairs = lambda n, e: file_pairs(n, e).select(F.col("source_file").alias("a"), F.col("target_file").alias("b"))
graph("cycles", CROSS + """SELECT a.source_file || ' > ' || a.target_file AS cycle, 2 AS edge_count FROM crossing a JOIN crossing b
    ON a.source_file = b.target_file AND a.target_file = b.source_file WHERE a.source_file < a.target_file
    UNION ALL SELECT a.source_file || ' > ' || a.target_file || ' > ' || b.target_file, 3 FROM crossing a JOIN crossing b ON a.target_file = b.source_file
    JOIN crossing c ON b.target_file = c.source_file AND c.target_file = a.source_file
    WHERE a.source_file < a.target_file AND a.source_file < b.target_file AND a.target_file <> b.target_file""")(
    lambda n, e: V.simple_cycles(pairs(n, e), 3).select(F.array_join("path", " > ").alias("cycle"), "edge_count")
)
ORACLES["files_on_cycles"] = "WITH RECURSIVE " + projection.SQL.strip().removeprefix("WITH") + CROSS + """, reach(a, b) AS (
    SELECT source_file, target_file FROM crossing UNION SELECT r.a, c.target_file FROM reach r JOIN crossing c ON r.b = c.source_file)
    SELECT a AS node FROM reach WHERE a = b"""  # fmt: skip
ORACLES["strong_components"] = ORACLES["files_on_cycles"].replace("SELECT a AS node FROM reach WHERE a = b", "SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
QUERIES["strong_components"] = lambda spark, sf_dir: V.strong_components(pairs(projection.nodes(spark, sf_dir), projection.edges(spark, sf_dir)))
QUERIES["files_on_cycles"] = lambda spark, sf_dir: V.on_cycles(pairs(projection.nodes(spark, sf_dir), projection.edges(spark, sf_dir)))

MODULE = "array_to_string(string_split(file, '/')[1:least(2, len(string_split(file, '/')) - 1)], '/')"
MODULES = f""", of_module AS (SELECT id, kind, file, {MODULE} AS module FROM nodes),
mods AS (SELECT module, count(DISTINCT file) AS files, count(*) AS symbols, count(*) FILTER (kind IN ('class', 'struct', 'enum', 'protocol')) AS types,
         count(*) FILTER (kind = 'protocol') AS abstracts FROM of_module GROUP BY module),
dep AS (SELECT DISTINCT s.module AS a, t.module AS b FROM edges e JOIN of_module s ON e.source = s.id JOIN of_module t ON e.target = t.id WHERE s.module <> t.module),
cpl AS (SELECT m.*, coalesce(x.ca, 0) AS ca, coalesce(y.ce, 0) AS ce FROM mods m LEFT JOIN (SELECT b AS module, count(*) AS ca FROM dep GROUP BY b) x USING (module)
        LEFT JOIN (SELECT a AS module, count(*) AS ce FROM dep GROUP BY a) y USING (module)),
val AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce / (ca + ce)::DOUBLE ELSE 0::DOUBLE END AS i, CASE WHEN types > 0 THEN abstracts / types::DOUBLE ELSE 0::DOUBLE END AS ab FROM cpl) """
graph("module_of_path", MODULES + "SELECT id, module FROM of_module")(lambda n, e: n.select("id", A.module_of_path(F.col("file")).alias("module")))
graph("agg_module", MODULES + "SELECT * FROM mods")(lambda n, e: A.modules(n))
graph("join_coupling", MODULES + "SELECT a, b FROM dep")(lambda n, e: A.module_pairs(n, e))
graph("coupling", MODULES + "SELECT module, files, symbols, types, abstracts, ca, ce, round(i, 6) AS instability, round(ab, 6) AS abstractness, round(abs(ab + i - 1), 6) AS distance FROM val")(
    lambda n, e: A.coupling(n, e).withColumns({c: F.round(c, 6) for c in ("instability", "abstractness", "distance")})
)
graph("agg_ca_ce", MODULES + "SELECT module, ca, ce FROM cpl")(lambda n, e: A.coupling(n, e).select("module", "ca", "ce"))
graph("agg_imports_module", """, own AS (SELECT DISTINCT name AS module, file FROM nodes WHERE kind = 'import')
SELECT module, count(*) AS file_count, array_to_string(list_sort(list(file))[1:10], '|') AS files FROM own GROUP BY module""")(
    lambda n, e: A.imports_by_module(n).withColumn("files", F.array_join("files", "|"))
)
graph("agg_imports_file", """, own AS (SELECT DISTINCT name AS module, file FROM nodes WHERE kind = 'import')
SELECT file, count(*) AS module_count, array_to_string(list_sort(list(module)), '|') AS modules FROM own GROUP BY file ORDER BY module_count DESC, file LIMIT 50""")(
    lambda n, e: A.imports_by_file(n, 50).withColumn("modules", F.array_join("modules", "|"))
)
graph("imports", "SELECT count(*) AS imports, count(DISTINCT name) AS modules, count(DISTINCT file) AS files FROM nodes WHERE kind = 'import'")(
    lambda n, e: n.where("kind = 'import'").agg(F.count(F.lit(1)).alias("imports"), F.countDistinct("name").alias("modules"), F.countDistinct("file").alias("files"))
)
SIGNALS = """, low AS (SELECT lower(name) AS x FROM nodes), sig AS (SELECT
    count(*) FILTER (contains(x, 'viewmodel') OR suffix(x, 'vm')) AS viewmodels, count(*) FILTER (contains(x, 'coordinator')) AS coordinators,
    count(*) FILTER (contains(x, 'router') AND NOT contains(x, 'nsurlrouter')) AS routers, count(*) FILTER (contains(x, 'presenter')) AS presenters,
    count(*) FILTER (contains(x, 'interactor')) AS interactors, count(*) FILTER (contains(x, 'wireframe') OR contains(x, 'assembly')) AS wireframes,
    count(*) FILTER (contains(x, 'reducer') OR contains(x, 'composable')) AS reducers, count(*) FILTER (contains(x, 'store') AND NOT contains(x, 'restore')) AS stores,
    count(*) FILTER (suffix(x, 'view') OR suffix(x, 'screen')) AS views, count(*) FILTER (contains(x, 'controller')) AS controllers FROM low) """
graph("agg_arch_signals", SIGNALS + "SELECT * FROM sig")(lambda n, e: A.architecture_signals(n))
_shown = {
    "viewmodels": "contains(x, 'viewmodel') OR suffix(x, 'vm')", "coordinators": "contains(x, 'coordinator')", "presenters": "contains(x, 'presenter')",
    "interactors": "contains(x, 'interactor')", "reducers": "contains(x, 'reducer') OR contains(x, 'composable')", "views": "suffix(x, 'view') OR suffix(x, 'screen')", "controllers": "contains(x, 'controller')",
}
graph("agg_arch_examples", ", low AS (SELECT id, file, lower(name) AS x FROM nodes), shown AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, file, id FROM low WHERE {t}" for s, t in _shown.items()) + """),
    numbered AS (SELECT signal, file, row_number() OVER (PARTITION BY signal ORDER BY file, id) AS nth FROM shown) SELECT signal, nth, file FROM numbered WHERE nth <= 5""")(lambda n, e: A.architecture_examples(n))  # fmt: skip
_w = lambda c: f"(CASE WHEN {c} > 0 THEN ln({c}) + 1 ELSE 0 END)"
_score = lambda cs: f"({' + '.join(map(_w, cs))}) * ({' + '.join(f'CAST({c} > 0 AS INTEGER)' for c in cs)}) / {len(cs)}.0"
graph("architecture", SIGNALS + ", sc AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pattern, CAST({_score(cs)} AS DOUBLE) AS score FROM sig" for p, cs in A.PATTERNS.items()) + """)
SELECT pattern, round(score, 6) AS score, round(least(score / 30, 1), 6) AS confidence, row_number() OVER (ORDER BY score DESC, pattern) = 1 AND score > 0 AS detected FROM sc""")(
    lambda n, e: A.architecture(n).withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 6)})
)
graph("architecture_violations", SIGNALS + """SELECT 'MVVM' AS pattern, 'viewmodels' AS missing FROM sig WHERE views > 0 AND viewmodels = 0
    UNION ALL SELECT 'VIPER', 'interactors' FROM sig WHERE presenters > 0 AND interactors = 0""")(lambda n, e: A.architecture_violations(n))  # fmt: skip
LAYER = """, lay AS (SELECT id, file, CASE WHEN file LIKE 'Sources/Parts/%' THEN 'Parts' WHEN regexp_matches(file, '^Sources/.*/.*/Suppliers\\.swift$') THEN 'Suppliers'
    WHEN regexp_matches(file, '^Sources/.*/.*/Customers\\.swift$') THEN 'Customers' WHEN file LIKE 'Sources/Orders/%' THEN 'Orders' END AS layer FROM nodes) """
graph("boundaries", LAYER + """SELECT e.source, e.target, e.kind, s.layer AS source_layer, t.layer AS target_layer FROM edges e JOIN lay s ON e.source = s.id JOIN lay t ON e.target = t.id
    WHERE s.file <> t.file AND ((s.layer = 'Parts' AND t.layer = 'Suppliers') OR (s.layer = 'Customers' AND t.layer = 'Orders'))""")(
    lambda n, e: A.boundaries(n, e, LAYERS, RULES).select("source", "target", "kind", "source_layer", "target_layer")
)
graph("agg_layers_found", LAYER + "SELECT layer, count(DISTINCT file) AS files FROM lay WHERE layer IS NOT NULL GROUP BY layer")(lambda n, e: A.layers_found(n, LAYERS))
graph("first_layer_wins", LAYER + "SELECT DISTINCT file, layer FROM lay")(lambda n, e: n.select("file").distinct().withColumn("layer", A.layer_of(F.col("file"), LAYERS)))

RECURSIVE = "WITH RECURSIVE " + projection.SQL.strip().removeprefix("WITH")
REACH = ", r(id, lv) AS (SELECT '{0}', 0 UNION SELECT e.source, lv + 1 FROM r JOIN edges e ON e.target = r.id WHERE lv < 3), best AS (SELECT id, min(lv) AS lv FROM r GROUP BY id) "


def recursive(name: str, sql: str):
    def add(query):
        graph(name, "")(query)
        ORACLES[name] = RECURSIVE + sql

    return add


one = lambda e, symbol: e.sparkSession.createDataFrame([(symbol,)], "seed string")
recursive("impact_levels", REACH.format(PART) + "SELECT id, lv AS level FROM best")(lambda n, e: V.reached(e, one(e, PART), 3).select("id", "level"))
recursive("impact", REACH.format(PART) + f"""SELECT '{PART}' AS seed, count(*) FILTER (lv = 1) AS direct, count(*) AS transitive,
    count(DISTINCT CASE WHEN NOT (contains(n.file, '/Tests/') OR contains(n.file, 'Tests.swift')) THEN n.file END) AS files,
    count(DISTINCT CASE WHEN contains(n.file, '/Tests/') OR contains(n.file, 'Tests.swift') THEN n.file END) AS tests,
    CASE WHEN count(*) <= 5 THEN 'low' WHEN count(*) <= 20 THEN 'medium' WHEN count(*) <= 50 THEN 'high' ELSE 'critical' END AS risk
    FROM best LEFT JOIN nodes n USING (id) WHERE lv > 0""")(lambda n, e: A.impact(n, e, one(e, PART), 3))  # fmt: skip
recursive("transitive_callers", f""", r(id, lv) AS (SELECT '{PART}', 0 UNION SELECT e.source, lv + 1 FROM r JOIN edges e ON e.target = r.id AND e.kind = 'calls' WHERE lv < 3),
    best AS (SELECT id, min(lv) AS lv FROM r GROUP BY id) SELECT lv + 1 AS level, source, target, line FROM edges JOIN best ON target = best.id AND kind = 'calls' WHERE lv < 3""")(
    lambda n, e: V.transitive_callers(e, PART, 3)
)
graph("agg_impact_breakdown", f"SELECT kind, count(*) AS n, array_to_string(list_sort(list(source)), ',') AS sources FROM edges WHERE target = '{PART}' GROUP BY kind")(
    lambda n, e: A.impact_breakdown(e, PART).withColumn("sources", F.array_join("sources", ","))
)
CHANGED = "Sources/Parts/Brand#11/Parts.swift"
DIFF = f""", seeds AS (SELECT id FROM nodes WHERE file = '{CHANGED}'), r(seed, id, lv) AS (SELECT id, id, 0 FROM seeds UNION SELECT r.seed, e.source, lv + 1 FROM r JOIN edges e ON e.target = r.id WHERE lv < 3),
    hit AS (SELECT DISTINCT n.file, contains(n.file, '/Tests/') OR contains(n.file, 'Tests.swift') AS is_test FROM (SELECT DISTINCT id FROM r WHERE id <> seed) x JOIN nodes n USING (id)),
    d AS (SELECT DISTINCT target, source, kind FROM edges WHERE target IN (SELECT id FROM seeds)) """
changed = lambda e: e.sparkSession.createDataFrame([(CHANGED,)], "file string")
recursive("diff_impact", DIFF + """SELECT (SELECT count(*) FROM seeds) AS symbols, (SELECT count(DISTINCT (target, source)) FROM d WHERE source <> target) AS total_direct_impact,
    t AS total_transitive_impact, (SELECT count(*) FROM hit WHERE NOT is_test) AS files, (SELECT count(*) FROM hit WHERE is_test) AS tests,
    CASE WHEN (SELECT count(*) FROM seeds) = 0 THEN 'none' WHEN t <= 10 THEN 'low' WHEN t <= 50 THEN 'medium' WHEN t <= 150 THEN 'high' ELSE 'critical' END AS risk
    FROM (SELECT count(DISTINCT source) AS t FROM d WHERE kind IN ('calls', 'conformsTo', 'inheritsFrom'))""")(lambda n, e: A.diff_impact(n, e, changed(e)))  # fmt: skip
recursive("set_union_affected", DIFF + "SELECT file, is_test FROM hit")(lambda n, e: A.affected_files(n, e, changed(e)))
graph("semijoin_changed", f"SELECT id, name, kind, file, line FROM nodes WHERE file = '{CHANGED}'")(
    lambda n, e: n.join(e.sparkSession.createDataFrame([(CHANGED,)], "file string"), "file", "left_semi").select(*NODE)
)
graph("isolation_of", """SELECT id, CASE WHEN list_contains(attributes, '@MainActor') THEN 'MainActor' WHEN list_contains(attributes, 'nonisolated') THEN 'nonisolated'
    WHEN contains(signature, 'actor ') THEN 'actor' ELSE 'unknown' END AS isolation FROM nodes""")(lambda n, e: n.select("id", A.isolation_of().alias("isolation")))  # fmt: skip
graph("concurrency", """, iso AS (SELECT id, CASE WHEN list_contains(attributes, '@MainActor') THEN 'MainActor' WHEN list_contains(attributes, 'nonisolated') THEN 'nonisolated'
    WHEN contains(signature, 'actor ') THEN 'actor' ELSE 'unknown' END AS i FROM nodes), c AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls'),
    p AS (SELECT c.source AS id, count(*) AS callees, count(*) FILTER (s.i <> t.i AND t.i <> 'unknown' AND t.i <> 'nonisolated') AS crossing,
        array_to_string(list_sort(list(DISTINCT t.i)), ',') AS others FROM c JOIN iso s ON c.source = s.id JOIN iso t ON c.target = t.id GROUP BY c.source),
    sent AS (SELECT DISTINCT source AS id FROM edges WHERE kind = 'conformsTo' AND contains(target, 'Sendable'))
    SELECT iso.id, iso.i AS isolation, coalesce(callees, 0) AS callees, coalesce(crossing, 0) AS cross_actor_calls, coalesce(others, '') AS callee_isolations, sent.id IS NOT NULL AS sendable,
        array_to_string(list_filter([CASE WHEN iso.i = 'unknown' THEN 'no isolation is stated' END,
            CASE WHEN sent.id IS NULL AND crossing > 0 THEN crossing || ' call(s) into other isolations but not Sendable' END], lambda x: x IS NOT NULL), '; ') AS warnings
    FROM iso LEFT JOIN p ON iso.id = p.id LEFT JOIN sent ON iso.id = sent.id""")(
    lambda n, e: A.concurrency(n, e).drop("mutable_state").withColumn("callee_isolations", F.array_join("callee_isolations", ",")).withColumn("warnings", F.array_join("warnings", "; "))
)

TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_tf = lambda term, prefix: " + ".join(
    f"{w} * len(list_filter({TOK.format(c)}, lambda x: " + (f"starts_with(x, '{term}')" if prefix else f"x = '{term}'") + "))"
    for c, w in (("name", "10.0"), ("'App.' || name", "5.0"), ("signature", "1.0"))
)
_len = " + ".join(f"len({TOK.format(c)})" for c in ("name", "'App.' || name", "signature"))


def bm25_sql(term: str, prefix: bool, where: str = "true") -> str:
    return f""", tfs AS (SELECT id, CAST({_tf(term, prefix)} AS DOUBLE) AS w, CAST({_len} AS DOUBLE) AS len FROM nodes WHERE {where}),
    st AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (w > 0) AS df FROM tfs),
    ranked AS (SELECT id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * len / al)) AS score FROM tfs, st WHERE w > 0) """


graph("fts_bm25", bm25_sql("widget", False) + "SELECT id, round(score, 6) AS score FROM ranked")(lambda n, e: S.bm25(n, [("widget", False)]).select("id", F.round("score", 6).alias("score")))
graph("fts_prefix", bm25_sql("supplier1", True) + "SELECT id, round(score, 6) AS score FROM ranked")(
    lambda n, e: S.bm25(n, S.query_terms("supplier1")).select("id", F.round("score", 6).alias("score"))
)
graph("fts_trigram", "SELECT id, name FROM nodes WHERE contains(lower(name), 'coord')")(lambda n, e: S.trigram(n, "COORD").select("id", "name"))
graph("trigram_index", "SELECT id, name FROM nodes WHERE contains(lower(name), 'coord')")(lambda n, e: S.indexed_substring(n, S.trigram_postings(n), "coord").select("id", "name"))
graph("search_chain", "SELECT id, name FROM nodes WHERE contains(lower(name), 'ordinator')")(lambda n, e: S.search(n, "ordinator").select("id", "name"))
graph("resolve_symbol", bm25_sql("supplier7", True) + "SELECT id FROM ranked ORDER BY score DESC, id LIMIT 1")(lambda n, e: S.resolve_symbol(n, "supplier7").select("id"))
graph("resolve_symbol_conc", "SELECT id FROM nodes WHERE contains(lower(name), 'ordinator') ORDER BY id LIMIT 1")(lambda n, e: S.resolve_symbol_conc(n, "ordinator").select("id"))
recursive("context_score", bm25_sql("supplier1coordinator", False) + """, seeds AS (SELECT id FROM ranked ORDER BY score DESC, id LIMIT 10),
    und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
    h(id, hop) AS (SELECT id, 0 FROM seeds UNION SELECT b, hop + 1 FROM h JOIN und ON a = id WHERE hop < 2), near AS (SELECT id, min(hop) AS hop FROM h GROUP BY id),
    fi AS (SELECT target AS id, count(*) AS c FROM edges GROUP BY target), fo AS (SELECT source AS id, count(*) AS c FROM edges GROUP BY source),
    scored AS (SELECT n.id, CAST(2 * coalesce(fi.c, 0) + coalesce(fo.c, 0) + CASE WHEN hop = 0 THEN 50 ELSE 0 END
        + CASE WHEN contains(lower(name), 'view') OR contains(lower(name), 'router') OR contains(lower(name), 'builder') OR contains(lower(name), 'controller') THEN 10 ELSE 0 END AS DOUBLE) AS score
        FROM nodes n JOIN near USING (id) LEFT JOIN fi USING (id) LEFT JOIN fo USING (id) WHERE NOT contains(file, '/Tests/'))
    SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 25""")(
    lambda n, e: A.context(n, e, S.seeds(n, ["Supplier1Coordinator"])).select("id", "score")
)


graph("agg_bool_any", """, f AS (SELECT bool_or(contains(name, 'ViewModel')) AS vm, bool_or(contains(name, 'View') AND NOT contains(name, 'ViewModel')) AS view,
        bool_or(contains(name, 'Router')) AS router, bool_or(contains(name, 'Coordinator')) AS coordinator, bool_or(contains(name, 'Interactor')) AS interactor,
        bool_or(contains(name, 'Presenter')) AS presenter, bool_or(contains(name, 'Store') OR contains(name, 'Reducer')) AS store, bool_or(kind = 'protocol') AS protocol FROM nodes)
    SELECT CASE WHEN interactor AND presenter AND router THEN 'VIPER' WHEN store THEN 'TCA/Redux' WHEN vm AND coordinator THEN 'MVVM+Coordinator' WHEN vm AND router THEN 'MVVM+Router'
        WHEN vm AND view THEN 'MVVM' WHEN view AND protocol THEN 'Protocol-oriented' END AS architecture FROM f""")(lambda n, e: A.context_pattern(n))  # fmt: skip
graph("set_union_bidir", f"SELECT source AS id, 1 AS hop FROM edges WHERE target = '{SUPPLIER}' UNION SELECT target, 1 FROM edges WHERE source = '{SUPPLIER}' UNION SELECT '{SUPPLIER}', 0")(
    lambda n, e: V.k_hops(e, e.sparkSession.createDataFrame([(SUPPLIER,)], "id string"), 1)
)
graph("limit_edges", """, und AS (
        SELECT target AS near, source AS far, row_number() OVER (PARTITION BY target ORDER BY source, kind, line NULLS FIRST) AS k FROM edges
        UNION ALL SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target, kind, line NULLS FIRST) FROM edges)
    SELECT DISTINCT far AS id, 1 AS hop FROM und WHERE k <= 10 AND near = 'supp::2' AND far <> 'supp::2' UNION ALL SELECT 'supp::2', 0""")(
    lambda n, e: V.k_hops(e, e.sparkSession.createDataFrame([("supp::2",)], "id string"), 1, per_node=10)
)
graph("set_union_seeds", bm25_sql("widget", False) + "SELECT id FROM (SELECT id FROM ranked ORDER BY score DESC, id LIMIT 10)")(lambda n, e: S.seeds(n, ["widget", "Widget"]))


def _documents(query):
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES["keyword_extract"] = _documents(
    lambda d: d.select("doc_id", F.array_join(S.keywords(F.coalesce("text", F.lit(""))), " ").alias("keywords"))
)
ORACLES["keyword_extract"] = (
    r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda w: strlen(w) >= 3 AND lower(w) NOT IN ("
    + ", ".join(f"'{w}'" for w in S.STOP_WORDS)
    + ")), ' ') AS keywords FROM documents"
)


# Stored tables, their merges and the joins that complete them.

@graph("dml_upsert_node", """, loads AS (SELECT id, name, 0 AS seq FROM nodes UNION ALL SELECT id, name || 'New', 1 FROM nodes WHERE access_level = 'Public')
    SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, name) AS n FROM loads) WHERE n = 1""")
def dml_upsert_node(n, e):
    first = n.select("id", "name", F.lit(0).alias("load_seq"))
    again = n.where("access_level = 'Public'").select("id", F.concat("name", F.lit("New")).alias("name"), F.lit(1).alias("load_seq"))
    return M.keep_last(first.unionByName(again), "id").select("id", "name")


@graph("dml_insert_edge", """, loads AS (SELECT source, target, kind, line, 0 AS seq FROM edges UNION ALL SELECT source, target, kind, line, 1 FROM edges WHERE kind <> 'calls')
    SELECT source, target, kind, line, seq AS load FROM (
        SELECT *, row_number() OVER (PARTITION BY source, target, kind, coalesce(line, -1) ORDER BY seq) AS n FROM loads) WHERE n = 1""")
def dml_insert_edge(n, e):
    loads = e.withColumn("load_seq", F.lit(0)).unionByName(e.where("kind <> 'calls'").withColumn("load_seq", F.lit(1)))
    return M.keep_first_edges(loads).select(*EDGE, F.col("load_seq").alias("load"))


@graph("dml_delete_by_file", f"SELECT id, name FROM nodes WHERE file <> '{CHANGED}' UNION ALL SELECT id, name || '2' FROM nodes WHERE file = '{CHANGED}'")
def dml_delete_by_file(n, e):
    new = n.where(F.col("file") == CHANGED).withColumn("name", F.concat("name", F.lit("2")))
    return M.replace_by_file(n, new, new.select("file")).select("id", "name")


@graph("antijoin_hybrid", """, idx AS (SELECT id, file FROM nodes WHERE kind = 'class')
    SELECT id, file FROM idx UNION ALL SELECT id, file FROM nodes WHERE file NOT IN (SELECT file FROM idx)""")
def antijoin_hybrid(n, e):
    return M.merge_sources(n.where("kind = 'class'").select("id", "file"), n.select("id", "file"))


@graph("join_name_resolution", """, own AS (SELECT DISTINCT e.source, n.name FROM edges e JOIN nodes n ON e.target = n.id WHERE e.kind = 'extendsType')
    SELECT DISTINCT o.source, n.id AS target FROM own o JOIN nodes n ON n.name = o.name
    WHERE n.kind IN ('function', 'method', 'property', 'class', 'struct', 'enum', 'protocol', 'enumCase') AND n.id <> o.source""")
def join_name_resolution(n, e):
    called = e.where("kind = 'extendsType'").join(n.select(F.col("id").alias("target"), "name"), "target")
    return M.resolve_names(called.withColumn("target", F.concat(F.lit("name::"), "name")).drop("name"), n).select("source", "target").distinct()


@graph("join_range_enrich", """, decl AS (SELECT file, name, line + (line % 7) - 3 AS line, 'let ' || name || (line % 7) AS signature FROM nodes WHERE kind IN ('property', 'struct')),
    near AS (SELECT n.id, d.signature, row_number() OVER (PARTITION BY n.id ORDER BY abs(n.line - d.line), d.line, d.signature) AS k
             FROM nodes n JOIN decl d ON n.file = d.file AND n.name = d.name AND abs(n.line - d.line) <= 2)
    SELECT n.id, coalesce(x.signature, n.signature) AS signature FROM nodes n LEFT JOIN near x ON n.id = x.id AND x.k = 1""")
def join_range_enrich(n, e):
    shift = F.col("line") % 7
    found = n.where("kind IN ('property', 'struct')").select("file", "name", (F.col("line") + shift - 3).alias("line"), F.concat(F.lit("let "), "name", shift.cast("string")).alias("signature"))
    found = found.withColumns({c: F.lit(None).cast("string") for c in ("access_level", "doc_comment")})
    return M.enrich(n, found).select("id", "signature")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")


def antijoin_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to index again if those with an id divisible by three were stored as they are, and others not or with other content."""
    now = M.with_hash(_files(spark, sf_dir), "text")
    stored = now.where("doc_id % 3 = 0").unionByName(now.where("doc_id % 3 = 1").withColumn("hash", F.sha2(F.lit("old").cast("binary"), 256)))
    return M.changed_files(now.select("path", "hash"), stored)


QUERIES["antijoin_incremental"] = antijoin_incremental
ORACLES["antijoin_incremental"] = "SELECT 'documents/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0"


# A compiler index derived from line items: parts are symbols, suppliers what they relate to, quantities their roles.


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    usr = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    other = F.struct(usr("supp::", "l_suppkey").alias("usr"), (F.col("l_linenumber") + 4).alias("kind"), F.expr("cast(l_quantity as bigint) * 512").alias("roles"))
    return items.select(
        usr("part::", "l_partkey").alias("usr"), usr("p", "l_partkey").alias("name"), (F.col("l_partkey") % 30).cast("int").alias("kind"),
        F.expr("(l_orderkey % 8) * 131072").alias("properties"), (F.col("l_orderkey") % 4).alias("roles"), F.lit("Sources/Index.swift").alias("file"),
        F.col("l_orderkey").cast("int").alias("line"), F.col("l_linenumber").alias("col"), F.array(other).alias("relations"),
    )


QUERIES["scan_is_record"] = lambda spark, sf_dir: X.definitions(occurrences(spark, sf_dir)).select("id", "kind", "access_level", "line", "col")
_kinds = " ".join(f"WHEN {k} THEN '{v}'" for k, v in X.KINDS.items())
_levels = " ".join(f"WHEN {bits} THEN '{level}'" for level, bits in X.ACCESS.items())
ORACLES["scan_is_record"] = f"""SELECT 'part::' || l_partkey AS id, CASE l_partkey % 30 {_kinds} ELSE 'function' END AS kind,
    CASE (l_orderkey % 8) * 131072 {_levels} ELSE 'Internal' END AS access_level, CAST(l_orderkey AS INTEGER) AS line, l_linenumber AS col
    FROM lineitem WHERE (l_orderkey % 4) & 2 <> 0"""
QUERIES["is_relations"] = lambda spark, sf_dir: X.relations(occurrences(spark, sf_dir)).select("source", "target", "kind", "line", "col")
ORACLES["is_relations"] = """WITH o AS (SELECT 'part::' || l_partkey AS usr, 'supp::' || l_suppkey AS other, l_linenumber + 4 AS k, CAST(l_quantity AS BIGINT) AS q,
        CAST(l_orderkey AS INTEGER) AS line, l_linenumber AS col FROM lineitem)
    SELECT other AS source, usr AS target, 'calls' AS kind, line, col FROM o WHERE q & 16 <> 0
    UNION ALL SELECT usr, other, CASE WHEN k = 8 THEN 'conformsTo' ELSE 'inheritsFrom' END, line, col FROM o WHERE q & 2 <> 0
    UNION ALL SELECT usr, other, 'overrides', line, col FROM o WHERE q & 4 <> 0
    UNION ALL SELECT usr, other, 'contains', line, col FROM o WHERE q & 1 <> 0
    UNION ALL SELECT other, usr, 'extendsType', line, col FROM o WHERE q & 32 <> 0"""


# Rules over lines: documents and pages as source files.


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.concat_ws("\n", "url", "html").alias("text"))
    return _files(spark, sf_dir).select("path", "text").unionByName(pages)


LINES = r"""WITH src AS (SELECT 'documents/' || doc_id AS file, text FROM documents UNION ALL SELECT 'pages/' || page_id, concat_ws(chr(10), url, html) FROM pages),
cut AS (SELECT file, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM src),
lines AS (SELECT file, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS INTEGER) AS line FROM cut) """
_comment = r"NOT regexp_matches(text, '^\s*(//|/\*|\*)')"
_any = lambda words, low=False: "(" + " OR ".join(f"contains({'lower(text)' if low else 'text'}, '{w.lower() if low else w}')" for w in words) + ")"
_slash = r"NOT regexp_matches(text, '^\s*//')"
LINE_SQL = {
    "SEC-001": " UNION ALL ".join(f"SELECT file, line FROM lines WHERE {_comment} AND regexp_matches(text, '{p}')" for p in R.SECRETS),
    "SEC-002": f"SELECT file, line FROM lines WHERE {_slash} AND {_any(('UserDefaults', '@AppStorage'))} AND {_any(R.SENSITIVE, True)}",
    "SEC-003": f"SELECT file, line FROM lines WHERE {_slash} AND {_any(R.LOGS)} AND {_any(R.LOGGED, True)}",
    "SEC-004": f"SELECT file, line FROM lines WHERE {_slash} AND contains(text, 'http://') AND NOT contains(text, 'http://localhost') AND NOT contains(text, 'http://127.0.0.1')",
    "PERF-003": "SELECT file, line FROM lines WHERE contains(text, '[any ') AND contains(text, ']') OR contains(text, 'Array<any ') OR contains(text, 'Set<any ') OR contains(text, 'Dictionary<') AND contains(text, 'any ')",
}
SEVERITY = {"SEC-001": "critical", "SEC-002": "high", "SEC-003": "medium", "SEC-004": "high", "PERF-003": "medium"}
CATEGORY = {r: "security" if r.startswith("SEC") else "swift-performance" for r in LINE_SQL}
_chosen = lambda *ids: [r for r in R.RULES if r.id in ids]
for _rule, _sql in LINE_SQL.items():
    _key = _rule.lower().replace("-", "_")
    QUERIES[_key] = lambda spark, sf_dir, _rule=_rule: R.findings(sources(spark, sf_dir), _chosen(_rule)).select("file", "line", "rule")
    ORACLES[_key] = LINES + f"SELECT file, line, '{_rule}' AS rule FROM ({_sql})"
ALL_LINES = LINES + ", found AS (" + " UNION ALL ".join(f"SELECT file, line, '{r}' AS rule, '{SEVERITY[r]}' AS severity, '{CATEGORY[r]}' AS category FROM ({q})" for r, q in LINE_SQL.items()) + ") "
QUERIES["agg_by_severity"] = lambda spark, sf_dir: R.by_severity(R.findings(sources(spark, sf_dir), _chosen(*LINE_SQL)))
ORACLES["agg_by_severity"] = ALL_LINES + "SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in R.SEVERITIES) + ", count(*) AS total FROM found"
QUERIES["audit_run"] = lambda spark, sf_dir: R.audit(sources(spark, sf_dir), min_severity="high", rules=_chosen(*LINE_SQL)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))
ORACLES["audit_run"] = ALL_LINES + "SELECT rule, severity, count(*) AS n, count(DISTINCT file) AS files FROM found WHERE severity IN ('high', 'critical') GROUP BY rule, severity"
QUERIES["topk_per_category"] = lambda spark, sf_dir: R.capped(R.findings(sources(spark, sf_dir), _chosen("SEC-002", "SEC-003", "SEC-004", "PERF-003")), 40).select("file", "line", "rule")
ORACLES["topk_per_category"] = ALL_LINES + """, f AS (SELECT * FROM found WHERE rule <> 'SEC-001'),
    ranked AS (SELECT *, list_position(['low', 'medium', 'high', 'critical'], severity) AS s,
               row_number() OVER (PARTITION BY category ORDER BY list_position(['low', 'medium', 'high', 'critical'], severity) DESC, file, line, rule) AS n FROM f)
    SELECT file, line, rule FROM ranked WHERE (SELECT count(*) FROM f) <= 40 OR n <= greatest(1, 40 // greatest(1, (SELECT count(DISTINCT category) FROM f)))
    ORDER BY s DESC, category, file, line, rule LIMIT CASE WHEN (SELECT count(*) FROM f) <= 40 THEN 1000000 ELSE 40 END"""
QUERIES["sink_text"] = lambda spark, sf_dir: K.text_lines(R.findings(sources(spark, sf_dir), _chosen("SEC-004")))
ORACLES["sink_text"] = LINES + f"SELECT '[HIGH] SEC-004 ' || list_last(string_split(file, '/')) || ':' || line || ' an address without TLS' || chr(10) || '    Fix: Use https' AS line FROM ({LINE_SQL['SEC-004']})"
QUERIES["sink_sarif_results"] = lambda spark, sf_dir: K.sarif_results(R.findings(sources(spark, sf_dir), _chosen("SEC-004")))
ORACLES["sink_sarif_results"] = LINES + f"""SELECT CAST(json_object('ruleId', 'SEC-004', 'level', '{K.LEVELS["high"]}', 'message', json_object('text', 'an address without TLS'),
    'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file), 'region', json_object('startLine', line)))),
    'fixes', json_array(json_object('description', json_object('text', 'Use https')))) AS VARCHAR) AS json FROM ({LINE_SQL['SEC-004']})"""
QUERIES["sink_sarif"] = lambda spark, sf_dir: K.sarif_rules(R.findings(sources(spark, sf_dir), _chosen("SEC-001", "SEC-004"))).select("rule", "severity")
ORACLES["sink_sarif"] = ALL_LINES + "SELECT DISTINCT rule, severity FROM found WHERE rule IN ('SEC-001', 'SEC-004')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most depended-on symbols with their blast radius within two steps and its risk."""
    n, e = projection.nodes(spark, sf_dir), projection.edges(spark, sf_dir)
    top = table(A.complexity(n, e, limit=10), "top")  # read three times
    return top.join(A.impact(n, e, top.select(F.col("id").alias("seed")), 2).withColumnRenamed("seed", "id"), "id").orderBy(F.desc("score"), "id")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = RECURSIVE + DEGREES + """, top AS (SELECT id, name, kind, file, fan_in, fan_out, score FROM deg ORDER BY score DESC, id LIMIT 10),
    r(seed, id, lv) AS (SELECT id, id, 0 FROM top UNION SELECT r.seed, e.source, lv + 1 FROM r JOIN edges e ON e.target = r.id WHERE lv < 2),
    best AS (SELECT seed, id, min(lv) AS lv FROM r GROUP BY seed, id),
    agg AS (SELECT seed, count(*) FILTER (lv = 1) AS direct, count(*) FILTER (lv > 0) AS transitive,
        count(DISTINCT CASE WHEN lv > 0 AND NOT (contains(n.file, '/Tests/') OR contains(n.file, 'Tests.swift')) THEN n.file END) AS files,
        count(DISTINCT CASE WHEN lv > 0 AND (contains(n.file, '/Tests/') OR contains(n.file, 'Tests.swift')) THEN n.file END) AS tests
        FROM best LEFT JOIN nodes n USING (id) GROUP BY seed)
    SELECT top.*, direct, transitive, files, tests,
        CASE WHEN transitive <= 5 THEN 'low' WHEN transitive <= 20 THEN 'medium' WHEN transitive <= 50 THEN 'high' ELSE 'critical' END AS risk
    FROM top JOIN agg ON top.id = agg.seed"""  # fmt: skip

graph("architecture_layers", """, n AS (SELECT lower(name) AS n, file, id FROM nodes),
    shown AS (SELECT 0 AS place, 'Views' AS layer, file, id FROM n WHERE n LIKE '%view' OR n LIKE '%screen' UNION ALL SELECT 1, 'ViewModels', file, id FROM n WHERE contains(n, 'viewmodel') OR n LIKE '%vm'
        UNION ALL SELECT 2, 'Coordinators', file, id FROM n WHERE contains(n, 'coordinator') UNION ALL SELECT 3, 'Presenters', file, id FROM n WHERE contains(n, 'presenter')
        UNION ALL SELECT 4, 'Interactors', file, id FROM n WHERE contains(n, 'interactor') UNION ALL SELECT 5, 'Reducers', file, id FROM n WHERE contains(n, 'reducer') OR contains(n, 'composable')
        UNION ALL SELECT 6, 'Controllers', file, id FROM n WHERE contains(n, 'viewcontroller') OR contains(n, 'controller')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY file, id) AS nth FROM shown)
    SELECT place, layer, count(*) AS symbols, string_agg(file, ',' ORDER BY nth) FILTER (nth <= 5) AS examples FROM ranked GROUP BY place, layer""")(
    lambda n, e: A.architecture_layers(n).withColumn("examples", F.array_join("examples", ","))
)
graph("sink_json", "SELECT CAST(to_json({'id': id, 'kind': kind, 'line': line}) AS VARCHAR) AS json FROM nodes")(lambda n, e: K.as_json(n.select("id", "kind", "line")))
graph("search_chain_words", bm25_sql("supplier1", True) + "SELECT id, round(score, 6) AS score FROM ranked")(lambda n, e: S.search(n, "supplier1").select("id", F.round("score", 6).alias("score")))
graph("search_chain_all", "SELECT id, name FROM nodes WHERE kind = 'class'")(lambda n, e: S.search(n, "*", "class").select("id", "name"))
graph("resolve_symbol_conc_id", f"SELECT id, name FROM nodes WHERE id = '{SUPPLIER}'")(lambda n, e: S.resolve_symbol_conc(n, SUPPLIER).select("id", "name"))
graph("resolve_symbol_conc_words", bm25_sql("supplier7", True) + "SELECT id FROM ranked ORDER BY score DESC, id LIMIT 1")(lambda n, e: S.resolve_symbol_conc(n, "supplier7").select("id"))
