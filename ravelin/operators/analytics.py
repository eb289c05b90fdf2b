"""Analyses of the graph: degrees, dead code, coupling, imports, architecture, boundaries, impact, context, isolation.

Every analysis is exact over the whole graph; limits are keyword arguments
that are off by default and then keep rows in a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.paths import glob_regex, module_of_path
from ravelin.operators.traverse import held, k_hops, numbered, reached, reaching_others
from ravelin.plans.tables import DENSE, drop, table


def _count(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(name))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out, 0 where there are none: each edge is counted once before any join."""
    both = nodes.join(_count(edges, "target", "fan_in"), "id", "left").join(_count(edges, "source", "fan_out"), "id", "left")
    return both.fillna(0, ["fan_in", "fan_out"])


def complexity(nodes: DataFrame, edges: DataFrame, path: str | None = None, sort_by: str = "score", limit: int | None = None) -> DataFrame:
    """id, name, kind, file, fan_in, fan_out and score = 1.5 fan_in + fan_out."""
    chosen = nodes if path is None else nodes.where(F.lower("file").startswith(path.lower()))
    score = F.col("fan_in") * 1.5 + F.col("fan_out")
    out = degrees(chosen.select("id", "name", "kind", "file"), edges).withColumn("score", score)
    return out if limit is None else out.orderBy(F.desc(sort_by), "id").limit(limit)


def file_stats(symbols: DataFrame) -> DataFrame:
    """Per file of complexity()'s rows: their number, average degrees and largest score (0 at least)."""
    return symbols.groupBy("file").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.avg("fan_in").alias("avg_fan_in"),
        F.avg("fan_out").alias("avg_fan_out"),
        F.greatest(F.max("score"), F.lit(0.0)).alias("max_score"),
    )


def is_test_file(file: str = "file") -> Column:
    return F.col(file).contains("/Tests/") | F.col(file).contains("Tests.swift")


def dead_code(nodes: DataFrame, edges: DataFrame, include_tests: bool = False, path: str | None = None) -> DataFrame:
    """Symbols that nothing refers to; types that refer to something themselves count as alive."""
    kinds = ("protocol", "extension", "import", "associatedType", "module")  # fixed values
    chosen = nodes if path is None else nodes.where(F.lower("file").startswith(path.lower()))
    chosen = chosen.where(~F.col("kind").isin(*kinds) & ~F.col("access_level").isin("Public", "Open"))
    chosen = chosen.where(~F.col("name").isin("body", "main") & ~F.col("name").startswith("application(") & ~F.col("name").startswith("scene("))
    if not include_tests:
        chosen = chosen.where(~is_test_file())
    unused = chosen.join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    active = edges.select(F.col("source").alias("id"), F.lit(True).alias("active")).distinct()
    types = F.col("kind").isin("class", "struct", "enum")
    return unused.join(active, "id", "left").where(~(types & F.col("active").isNotNull())).drop("active")


def dead_percentage(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: total, dead and dead_percentage (0 for an empty graph)."""
    both = nodes.select(F.lit(0).alias("dead")).unionByName(dead.select(F.lit(1).alias("dead")))
    out = both.agg(F.count_if(F.col("dead") == 0).alias("total"), F.count_if(F.col("dead") == 1).alias("dead"))
    return out.withColumn("dead_percentage", F.when(F.col("total") > 0, F.col("dead") * 100.0 / F.col("total")).otherwise(F.lit(0.0)))


def modules(nodes: DataFrame, depth: int = 2, root: str = "") -> DataFrame:
    """Per module: files, symbols, types and abstracts (protocols)."""
    of = nodes.withColumn("module", module_of_path(F.col("file"), depth, root))
    types = F.col("kind").isin("class", "struct", "enum", "protocol")
    return of.groupBy("module").agg(
        F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("symbols"),
        F.count_if(types).alias("types"), F.count_if(F.col("kind") == "protocol").alias("abstracts"),
    )


def module_pairs(nodes: DataFrame, edges: DataFrame, depth: int = 2, root: str = "") -> DataFrame:
    """Distinct pairs (a, b) of different modules, a depending on b."""
    of = nodes.select("id", module_of_path(F.col("file"), depth, root).alias("module"))
    joined = edges.join(of.withColumnsRenamed({"id": "source", "module": "a"}), "source").join(of.withColumnsRenamed({"id": "target", "module": "b"}), "target")
    return joined.where("a <> b").select("a", "b").distinct()


def coupling(nodes: DataFrame, edges: DataFrame, depth: int = 2, root: str = "") -> DataFrame:
    """Per module: afferent and efferent coupling, instability, abstractness and distance from the main sequence."""
    pairs = module_pairs(nodes, edges, depth, root)
    out = modules(nodes, depth, root)
    out = out.join(pairs.groupBy(F.col("b").alias("module")).agg(F.count(F.lit(1)).alias("ca")), "module", "left")
    out = out.join(pairs.groupBy(F.col("a").alias("module")).agg(F.count(F.lit(1)).alias("ce")), "module", "left").fillna(0, ["ca", "ce"])
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    out = out.withColumn("instability", share(F.col("ce"), F.col("ca") + F.col("ce"))).withColumn("abstractness", share(F.col("abstracts"), F.col("types")))
    return out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def imports_by_module(nodes: DataFrame, first: int = 10) -> DataFrame:
    """Per imported module: the number of files that import it and the first few of them."""
    own = nodes.where("kind = 'import'").select(F.col("name").alias("module"), "file").distinct()
    nth = F.row_number().over(Window.partitionBy("module").orderBy("file"))
    return own.withColumn("n", nth).groupBy("module").agg(
        F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_list(F.when(F.col("n") <= first, F.col("file")))).alias("files")
    )


def imports_by_file(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Per file: its imported modules, sorted, and their number."""
    own = nodes.where("kind = 'import'").select(F.col("name").alias("module"), "file").distinct()
    out = own.groupBy("file").agg(F.count(F.lit(1)).alias("module_count"), F.array_sort(F.collect_list("module")).alias("modules"))
    return out if limit is None else out.orderBy(F.desc("module_count"), "file").limit(limit)


def _signals() -> dict[str, Column]:
    n = F.lower("name")
    return {  # fixed values
        "viewmodels": n.contains("viewmodel") | n.endswith("vm"),
        "coordinators": n.contains("coordinator"),
        "routers": n.contains("router") & ~n.contains("nsurlrouter"),
        "presenters": n.contains("presenter"),
        "interactors": n.contains("interactor"),
        "wireframes": n.contains("wireframe") | n.contains("assembly"),
        "reducers": n.contains("reducer") | n.contains("composable"),
        "stores": n.contains("store") & ~n.contains("restore"),
        "views": n.endswith("view") | n.endswith("screen"),
        "controllers": n.contains("viewcontroller") | n.contains("controller"),
    }


def architecture_signals(nodes: DataFrame) -> DataFrame:
    """One row of ten counts over lower-case names."""
    return nodes.agg(*(F.count_if(test).alias(name) for name, test in _signals().items()))


#: The signals that examples are given for.
WITH_EXAMPLES = ("viewmodels", "coordinators", "presenters", "interactors", "reducers", "views", "controllers")


def architecture_examples(nodes: DataFrame, most: int = 5) -> DataFrame:
    """signal, nth and file: the files of the first symbols (by file and id) that show a signal, once for each symbol."""
    tests = _signals()
    shown = F.explode(F.array_compact(F.array(*(F.when(tests[name], F.lit(name)) for name in WITH_EXAMPLES)))).alias("signal")
    nth = F.row_number().over(Window.partitionBy("signal").orderBy("file", "id"))  # cut to `most` before the shuffle
    return nodes.select(shown, "file", "id").withColumn("nth", nth).where(F.col("nth") <= most).select("signal", "nth", "file")


#: The layers that statistics are given for, in their order, and the signals that count them.
LAYERS = {"Views": "views", "ViewModels": "viewmodels", "Coordinators": "coordinators", "Presenters": "presenters", "Interactors": "interactors", "Reducers": "reducers", "Controllers": "controllers"}


def architecture_layers(nodes: DataFrame, most: int = 5) -> DataFrame:
    """place, layer, symbols (how many show its signal; a layer without any has no row) and examples (files of the first of them)."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("layer"), F.lit(signal).alias("signal"), F.col(signal).alias("symbols")) for i, (name, signal) in enumerate(LAYERS.items())))).alias("l")
    counts = architecture_signals(nodes).select(each).select("l.*").where("symbols > 0")
    files = architecture_examples(nodes, most).groupBy("signal").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "file"))), lambda x: x["file"]).alias("examples"))
    return counts.join(files, "signal", "left").select("place", "layer", "symbols", "examples")


#: The signals of each pattern.
PATTERNS = {
    "MVVM": ("viewmodels", "views"),
    "MVVM+Coordinator": ("viewmodels", "coordinators", "routers"),
    "VIPER": ("presenters", "interactors", "wireframes", "routers"),
    "TCA/ComposableArchitecture": ("reducers", "stores", "views"),
    "MVC": ("controllers", "views"),
}


def architecture(nodes: DataFrame) -> DataFrame:
    """Per pattern: score, confidence and whether it is the detected one (first by name of equal ones; none if all are 0)."""
    score = lambda names: (
        sum((F.when(F.col(c) > 0, F.ln(F.col(c)) + 1).otherwise(F.lit(0.0)) for c in names), F.lit(0.0))
        * sum(((F.col(c) > 0).cast("int") for c in names), F.lit(0)) / len(names)
    )
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), score(names).alias("score")) for p, names in PATTERNS.items()))).alias("p")
    out = architecture_signals(nodes).select(each).select("p.*")
    best = F.row_number().over(Window.orderBy(F.desc("score"), "pattern"))  # five rows
    return out.select("pattern", "score", F.least(F.col("score") / 30, F.lit(1.0)).alias("confidence"), ((best == 1) & (F.col("score") > 0)).alias("detected"))


def architecture_violations(nodes: DataFrame) -> DataFrame:
    """Patterns that are there in part only: pattern and missing."""
    rules = {("MVVM", "viewmodels"): "views > 0 AND viewmodels = 0", ("VIPER", "interactors"): "presenters > 0 AND interactors = 0"}
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(m).alias("missing"), F.expr(test).alias("found")) for (p, m), test in rules.items())))
    return architecture_signals(nodes).select(each.alias("r")).where("r.found").select("r.pattern", "r.missing")


def layer_of(file: Column, layers: list[tuple[str, str]]) -> Column:
    """The first layer (name, glob) whose glob matches, or null."""
    return F.coalesce(*(F.when(file.rlike(glob_regex(glob)), F.lit(name)) for name, glob in layers), F.lit(None).cast("string"))


def boundaries(nodes: DataFrame, edges: DataFrame, layers: list[tuple[str, str]], rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Edges from a layer to another that a rule (from, to, allowed) denies."""
    of = nodes.select("id", "file", layer_of(F.col("file"), layers).alias("layer")).where("layer is not null")
    joined = edges.select("source", "target", "kind").join(of.withColumnsRenamed({"id": "source", "file": "source_file", "layer": "source_layer"}), "source")
    joined = joined.join(of.withColumnsRenamed({"id": "target", "file": "target_file", "layer": "target_layer"}), "target")
    denied = F.lit(False)
    for a, b, allowed in rules:
        denied = denied | F.lit(not allowed) & (F.col("source_layer") == a) & (F.col("target_layer") == b)
    return joined.where((F.col("source_layer") != F.col("target_layer")) & (F.col("source_file") != F.col("target_file")) & denied)


def layers_found(nodes: DataFrame, layers: list[tuple[str, str]]) -> DataFrame:
    """Per layer: its files."""
    of = nodes.select("file", layer_of(F.col("file"), layers).alias("layer")).where("layer is not null")
    return of.groupBy("layer").agg(F.countDistinct("file").alias("files"))


def risk(amount: Column, steps: tuple[int, int, int]) -> Column:
    low, medium, high = steps
    return F.when(amount <= low, "low").when(amount <= medium, "medium").when(amount <= high, "high").otherwise("critical")


#: Up to these many affected symbols a change's risk is low, medium, high.
IMPACT_RISK, DIFF_RISK = (5, 20, 50), (10, 50, 150)


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Per seed: direct and transitive dependents (the seed not counted), affected files and tests, and risk."""
    found = reached(edges, seeds, depth).where("level > 0")
    files = found.join(nodes.select("id", "file"), "id", "left")
    out = files.groupBy("seed").agg(
        F.count_if(F.col("level") == 1).alias("direct"), F.count(F.lit(1)).alias("transitive"),
        F.countDistinct(F.when(~is_test_file(), F.col("file"))).alias("files"), F.countDistinct(F.when(is_test_file(), F.col("file"))).alias("tests"),
    )
    out = seeds.select("seed").distinct().join(out, "seed", "left").fillna(0, ["direct", "transitive", "files", "tests"])
    return out.withColumn("risk", risk(F.col("transitive"), IMPACT_RISK))


def impact_breakdown(edges: DataFrame, symbol: str) -> DataFrame:
    """The sources of the edges into a symbol, per kind, repeats kept."""
    return edges.where(F.col("target") == symbol).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("source")).alias("sources"))


#: Kinds of edges whose sources a change is said to reach: callers, conforming types and subtypes.
REACHED_BY = ("calls", "conformsTo", "inheritsFrom")


def _places(nodes: DataFrame, changed_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables: id and file of all symbols, and those in the changed files as numbered seeds."""
    places = table(nodes.select("id", "file"), "places")
    return places, numbered(places.join(changed_files, "file", "left_semi").withColumnRenamed("id", "seed"))


def _files_of(places: DataFrame, found: list[DataFrame]) -> DataFrame:
    """A table of file and is_test of the symbols whose ids are in the tables found, which go."""
    ids = places.limit(0).select("id")
    for rows in found:
        ids = ids.unionByName(rows.select("id"))
    ids, how = held(ids)
    out = table(places.join(ids, "id", "left_semi").select("file", is_test_file().alias("is_test")).distinct(), "affected_files", how)
    drop(*found)
    return out


def affected_files(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame, depth: int = 3) -> DataFrame:
    """file and is_test of every file with a symbol that depends on one in the changed files (column file)."""
    places, seeds = _places(nodes, changed_files)
    back = table(edges.select("source", "target").where("source IS NOT NULL"), "edges", DENSE)
    out = _files_of(places, reaching_others(back, seeds, depth))
    drop(places, seeds, back)
    return out


def diff_impact(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame, depth: int = 3) -> DataFrame:
    """One row for a set of changed files (column file): symbols in them, the sum of their direct impact, distinct callers,
    conforming types and subtypes, affected files and tests, and risk (none, if there is no such symbol)."""
    places, seeds = _places(nodes, changed_files)
    back = table(edges.select("source", "target", F.coalesce(F.col("kind").isin(*REACHED_BY), F.lit(False)).alias("by")).where("source IS NOT NULL"), "edges", DENSE)
    own, how = held(seeds, "seed")
    into = back.join(own, F.col("target") == F.col("seed")).groupBy("source", "number").agg(F.bool_or("by").alias("by"), F.bool_or(F.col("source") != F.col("seed")).alias("other"))
    near = into.groupBy(F.col("source").alias("id")).agg(F.min("number").alias("low"), F.max("number").alias("high"), F.bool_or("by").alias("by"), F.count_if("other").alias("direct"))
    near = table(near, "near", how)  # the first level of the walk
    files = _files_of(places, reaching_others(back, seeds, depth, near.select("id", "low", "high")))
    out = near.agg(F.coalesce(F.sum("direct"), F.lit(0)).alias("total_direct_impact"), F.count_if("by").alias("total_transitive_impact"))
    out = table(out.select(F.lit(seeds.count()).cast("long").alias("symbols"), "*"), "impact")
    drop(places, seeds, back, near)
    files = files.agg(F.count_if(~F.col("is_test")).alias("files"), F.count_if("is_test").alias("tests"))
    level = F.when(F.col("symbols") == 0, "none").otherwise(risk(F.col("total_transitive_impact"), DIFF_RISK))
    return out.join(F.broadcast(files)).withColumn("risk", level)  # one row and one row


def context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_nodes: int = 25, include_tests: bool = False, per_node: int | None = None) -> DataFrame:
    """The symbols around the seeds (column id) that score best: 2 fan_in + fan_out + 50 for seeds + 10 for entry points."""
    near = k_hops(edges, seeds, 2, per_node)
    chosen = degrees(nodes.select("id", "name", "kind", "file").join(near, "id"), edges)
    if not include_tests:
        chosen = chosen.where(~F.col("file").contains("/Tests/"))
    n = F.lower("name")
    entry = n.contains("view") | n.contains("router") | n.contains("builder") | n.contains("controller")
    score = F.col("fan_in") * 2.0 + F.col("fan_out") + F.when(F.col("hop") == 0, 50.0).otherwise(0.0) + F.when(entry, 10.0).otherwise(0.0)
    return chosen.withColumn("score", score).orderBy(F.desc("score"), "id").limit(max_nodes)


def context_pattern(ranked: DataFrame) -> DataFrame:
    """One row: the pattern that the names of context()'s rows suggest, or null."""
    has = lambda *words: F.bool_or(F.greatest(*(F.col("name").contains(w) for w in words)) if len(words) > 1 else F.col("name").contains(words[0]))
    view = F.bool_or(F.col("name").contains("View") & ~F.col("name").contains("ViewModel"))
    flags = ranked.agg(
        has("ViewModel").alias("vm"), view.alias("view"), has("Router").alias("router"), has("Coordinator").alias("coordinator"), has("Interactor").alias("interactor"),
        has("Presenter").alias("presenter"), has("Store", "Reducer").alias("store"), F.bool_or(F.col("kind") == "protocol").alias("protocol"),
    )
    name = (
        F.when(F.expr("interactor AND presenter AND router"), "VIPER").when(F.col("store"), "TCA/Redux").when(F.expr("vm AND coordinator"), "MVVM+Coordinator")
        .when(F.expr("vm AND router"), "MVVM+Router").when(F.expr("vm AND view"), "MVVM").when(F.expr("view AND protocol"), "Protocol-oriented")
    )
    return flags.select(name.alias("architecture"))


def isolation_of(attributes: str = "attributes", signature: str = "signature") -> Column:
    """MainActor, another actor's attribute, nonisolated, actor or unknown, in that order of precedence."""
    a = F.coalesce(F.col(attributes), F.array().cast("array<string>"))
    other = F.filter(a, lambda x: x.contains("Actor") & ~x.contains("nonisolated"))
    return (
        F.when(F.exists(a, lambda x: x.contains("MainActor")), F.lit("MainActor"))
        .when(F.size(other) > 0, F.translate(F.get(other, F.lit(0)), "@", ""))
        .when(F.exists(a, lambda x: x.contains("nonisolated")), F.lit("nonisolated"))
        .when(F.coalesce(F.col(signature), F.lit("")).contains("actor "), F.lit("actor"))
        .otherwise(F.lit("unknown"))
    )


def mutable_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and mutable_state: the properties that a symbol changes or refers to, each once, with whether they are published and have an actor."""
    of = nodes.where("kind = 'property'").select(F.col("id").alias("target"), "name", F.exists(F.coalesce("attributes", F.array().cast("array<string>")), lambda a: a.contains("Published")).alias("is_published"), isolation_of().alias("isolation"))
    used = edges.where("kind IN ('mutates', 'references')").select(F.col("source").alias("id"), "target").distinct().join(of, "target")
    access = F.struct(F.col("name").alias("property"), "is_published", (~F.col("isolation").isin("unknown", "nonisolated")).alias("is_protected"))
    return used.groupBy("id").agg(F.array_sort(F.collect_set(access)).alias("mutable_state"))


def concurrency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per symbol: its isolation, whether it is Sendable, its callees' isolations, calls from one isolation to another, the mutable state it uses, and warnings."""
    attributes = F.coalesce("attributes", F.array().cast("array<string>"))
    of = nodes.select("id", isolation_of().alias("isolation"), F.exists(attributes, lambda a: a.contains("Sendable")).alias("marked"))
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    joined = calls.join(of.select(F.col("id").alias("source"), F.col("isolation").alias("own")), "source")
    joined = joined.join(of.select(F.col("id").alias("target"), F.col("isolation").alias("other")), "target")
    crossing = (F.col("own") != F.col("other")) & (F.col("other") != "unknown") & (F.col("other") != "nonisolated")
    per = joined.groupBy(F.col("source").alias("id")).agg(
        F.count(F.lit(1)).alias("callees"), F.count_if(crossing).alias("cross_actor_calls"), F.array_sort(F.collect_set("other")).alias("callee_isolations")
    )
    sendable = edges.where("kind = 'conformsTo'").where(F.col("target").contains("Sendable")).select(F.col("source").alias("id"), F.lit(True).alias("sendable")).distinct()
    out = of.join(per, "id", "left").join(sendable, "id", "left").join(mutable_state(nodes, edges), "id", "left")
    out = out.fillna(0, ["callees", "cross_actor_calls"]).withColumn("sendable", F.coalesce("sendable", "marked")).drop("marked")
    out = out.withColumn("callee_isolations", F.coalesce("callee_isolations", F.array().cast("array<string>")))
    out = out.withColumn("mutable_state", F.coalesce("mutable_state", F.array().cast(out.schema["mutable_state"].dataType)))
    return out.withColumn("warnings", concurrency_warnings(F.col("isolation"), F.col("sendable"), F.col("cross_actor_calls"), F.col("mutable_state")))


def concurrency_warnings(isolation: Column, sendable: Column, cross_calls: Column, state: Column) -> Column:
    """The texts of what is doubtful about a symbol."""
    crossing = F.concat(cross_calls.cast("string"), F.lit(" call(s) into other isolations but not Sendable"))
    open_ = F.filter(state, lambda s: ~s["is_protected"])
    outside = F.concat(F.lit("mutable state outside any actor: "), F.array_join(F.transform(open_, lambda s: s["property"]), ", "))
    return F.array_compact(
        F.array(
            F.when(isolation == "unknown", "no isolation is stated"),
            F.when(~sendable & (cross_calls > 0), crossing),
            F.when(F.size(open_) > 0, outside),
            F.when(F.exists(open_, lambda s: s["is_published"]), "published properties outside the main actor"),
        )
    )
