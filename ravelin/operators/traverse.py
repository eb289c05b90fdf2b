"""Breadth-first walks, for any number of start symbols at once, one join a level.

A level's rows are kept as a table in the shared folder, so lineage stays
short and a level that is lost is read again, not walked again. Edges meet the
frontier on their key; which side is broadcast, if any, is left to the
adaptive planner, which knows the frontier's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.plans.tables import drop, table

#: Bytes that are broadcast to a join; of larger tables, those that one task holds while the other side passes; those of a row besides its key.
SENT, HELD, ROW = 32 << 20, 24 << 20, 64


def reached(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, id and level of every symbol that reaches a seed in up to depth steps, level being the fewest; seeds at 0.

    seeds: a column seed. edges: source and target; every kind counts.
    """
    back = table(edges.select("source", "target").distinct(), "edges")  # read again at every level
    seen = table(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("level")).distinct(), "level")
    frontier, levels = seen, [seen]
    for level in range(1, depth + 1):
        step = frontier.join(back, F.col("id") == F.col("target")).select("seed", F.col("source").alias("id")).distinct()
        frontier = table(step.join(seen, ["seed", "id"], "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
    return seen


def held(rows: DataFrame, key: str = "id") -> tuple[DataFrame, dict[str, str]]:
    """rows of a table (few of any one key) as the side of a join that is kept in memory, so that the other one is not sorted, and the settings to write the join with.

    With these no task keeps more than about HELD bytes; what is read against them can still be split, where one key has much of it.
    """
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    if size + ROW * n <= SENT:
        return F.broadcast(rows), {}
    partitions = "spark.sql.shuffle.partitions"
    parts = max(int(rows.sparkSession.conf.get(partitions)), (size + ROW * n) // HELD + 1)
    return rows.hint("shuffle_hash"), {partitions: str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def numbered(seeds: DataFrame) -> DataFrame:
    """A table of the different seeds (column seed) with a number each."""
    ids = seeds.select("seed").where("seed IS NOT NULL").distinct()
    return table(ids.select("seed", F.monotonically_increasing_id().alias("number")), "seeds")


def reaching_others(edges: DataFrame, seeds: DataFrame, depth: int, first: DataFrame | None = None) -> list[DataFrame]:
    """Tables whose ids together (some twice) are the symbols that reach a seed other than themselves in up to depth steps.

    edges: a table of source and target. seeds: a table as of numbered(). first:
    id, low and high of the sources of edges into seeds, the least and the
    greatest number of these, if they are known.

    Two different seeds are enough to know of a symbol: one of them is not the
    symbol itself, and that holds for all that lead to it. So a symbol is
    walked from when its first seed is found and once more when a second is,
    and rows grow with the symbols, not with pairs of symbol and seed.
    """
    frontier = seeds.select(F.col("seed").alias("id"), F.col("number").alias("low"), F.col("number").alias("high"))
    seen, found = frontier, []
    for level in range(1, depth + 1):
        if first is not None and level == 1:
            step, how = first, {}
        else:
            near, how = held(frontier)
            step = edges.join(near, F.col("id") == F.col("target")).select(F.col("source").alias("id"), "low", "high")
        known = F.when(F.col("low") == F.col("high"), 1).otherwise(2)
        both = step.withColumn("known", F.lit(0)).unionByName(seen.withColumn("known", known)).groupBy("id")
        both = both.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("known").alias("known"))
        frontier = table(both.where("known = 0 OR known = 1 AND low <> high").select("id", "low", "high"), "level", how)
        found.append(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found


def transitive_callers(edges: DataFrame, symbol: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """level, source, target and line of every call on the way to symbol, those back to visited callers included."""
    calls = table(edges.where("kind = 'calls'").select("source", "target", "line"), "calls")
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(symbol,)], "id string")
    visited, out, level = frontier, None, 0
    while depth is None or level < depth:
        level += 1
        step = table(frontier.join(calls, F.col("id") == F.col("target")).select(F.lit(level).alias("level"), "source", "target", "line"), "calls")
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        frontier = table(step.select(F.col("source").alias("id")).distinct().join(visited, "id", "left_anti"), "frontier")
        visited = visited.unionByName(frontier)
    out = out if out is not None else spark.createDataFrame([], "level int, source string, target string, line int")
    return out if limit is None else out.orderBy("level", "source", "target", "line").limit(limit)


def k_hops(edges: DataFrame, seeds: DataFrame, hops: int = 2, per_node: int | None = None) -> DataFrame:
    """id and hop of every symbol within so many undirected steps of the seeds (column id).

    per_node limits the steps out of a symbol in either direction, in the order of the edges' keys.
    """
    from pyspark.sql.window import Window

    def sided(near: str, far: str) -> DataFrame:
        own = edges.select(F.col(near).alias("near"), F.col(far).alias("far"), "kind", "line")
        if per_node is None:
            return own.select("near", "far")
        order = Window.partitionBy("near").orderBy("far", "kind", F.col("line").asc_nulls_first())
        return own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_node).select("near", "far")

    both = table(sided("source", "target").unionByName(sided("target", "source")).distinct(), "neighbours")
    seen = frontier = table(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "hop")
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("id") == F.col("near")).select(F.col("far").alias("id")).distinct()
        frontier = table(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def simple_cycles(pairs: DataFrame, longest: int = 3) -> DataFrame:
    """Every cycle of 2 to longest different nodes of pairs (a, b), once, as `path` that begins with its least node."""
    steps = table(pairs.where("a <> b").distinct(), "pairs")
    paths, out = steps.where("a < b").select(F.array("a", "b").alias("path")), None
    for length in range(2, longest + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        closed = paths.join(steps, (last == F.col("a")) & (first == F.col("b")), "left_semi")
        out = closed if out is None else out.unionByName(closed)
        if length < longest:
            longer = paths.join(steps, last == F.col("a")).where((F.col("b") > first) & ~F.array_contains("path", F.col("b")))
            paths = table(longer.select(F.concat("path", F.array("b")).alias("path")), "paths")
    return out.select("path", F.size("path").alias("edge_count"))


def _least(rows: DataFrame, near: str, far: str) -> DataFrame:
    """node and colour of every node of rows: the least node, by hash, that leads to it along (near, far); itself counts.

    A node also takes the colour of its colour, so what it knows doubles with each round.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))
    nodes = rows.select(F.col("a").alias("node")).unionByName(rows.select(F.col("b").alias("node"))).distinct()
    now = table(nodes.select("node", key("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while not now.where("new").isEmpty():
        own = now.select("node", "colour")
        come = rows.select(F.col(near).alias("node"), F.col(far).alias("to")).join(own, "node").select(F.col("to").alias("node"), "colour")
        jump = now.select("node", F.col("colour.node").alias("to")).join(own.withColumnRenamed("node", "to"), "to").select("node", "colour")
        old = own.withColumn("old", F.col("colour"))
        least = old.unionByName(come.unionByName(jump), allowMissingColumns=True).groupBy("node").agg(F.min("colour").alias("colour"), F.max("old").alias("old"))
        now, before = table(least.select("node", "colour", (F.col("colour.node") != F.col("old.node")).alias("new")), "colours"), now
        drop(before)
    return now.select("node", F.col("colour.node").alias("colour"))


def _trimmed(live: DataFrame) -> DataFrame:
    """live without what a node without a way in, or without a way out, is part of."""
    entered, left = live.select(F.col("b").alias("a")).distinct(), live.select(F.col("a").alias("b")).distinct()
    return live.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b")


def _shortened(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """live with each path through nodes of one way in and one way out as one pair; these nodes with the path's ends; and rings of such nodes.

    Pointers along the paths double in each round. None if there is no such node.
    """
    ways = live.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("prev")), allowMissingColumns=True)
    ways = ways.groupBy("node").agg(F.count("prev").alias("n_in"), F.count("next").alias("n_out"), F.min("prev").alias("prev"), F.min("next").alias("next"))
    inner = table(ways.where("n_in = 1 AND n_out = 1").select("node", "prev", "next", F.col("node").alias("least")), "inner")
    n = inner.count()
    if not n:
        drop(inner)
        return None
    nodes = table(inner.select("node"), "inner_nodes")
    for _ in range(n.bit_length() + 1):
        on = inner.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        back = inner.select(F.col("node").alias("prev"), F.col("prev").alias("prev2"))
        jumped = inner.join(on, "next", "left").join(back, "prev", "left")
        jumped = jumped.select("node", F.coalesce("prev2", "prev").alias("prev"), F.coalesce("next2", "next").alias("next"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("next2").isNotNull() | F.col("prev2").isNotNull()).alias("moved"))
        inner, before = table(jumped, "inner"), inner
        drop(before)
        if inner.where("moved").isEmpty():
            break
    rings = inner.join(nodes.withColumnRenamed("node", "next"), "next", "left_semi").select("node", F.col("least").alias("component"))
    hung = inner.join(nodes.withColumnRenamed("node", "next"), "next", "left_anti").select("node", F.col("prev").alias("a"), F.col("next").alias("b"))
    rest = live.join(nodes.withColumnRenamed("node", "a"), "a", "left_anti").join(nodes.withColumnRenamed("node", "b"), "b", "left_anti")
    short = rest.select("a", "b").unionByName(hung.where("a <> b").select("a", "b")).distinct()
    return short, hung, rings


#: Rounds of trimming and shortening before pairs are told apart by colours.
TRIMS = 6


def strong_components(pairs: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of pairs (a, b) on a cycle of two nodes or more.

    Pairs shrink by three steps. Nodes without a way in or out go. Paths through
    nodes of one way in and out become one pair, by pointers that double. Where
    that is not enough, every node takes the least node that reaches it, then,
    among pairs of one such colour, the least that it reaches: those that reach
    their colour are its component, and pairs that differ in either go. So a
    chain or tree takes a number of rounds that grows with the logarithm of its
    length. Each round's tables have at most a row for each pair or node, and go
    when the next are written.
    """
    live = table(pairs.where("a <> b").select("a", "b").distinct(), "pairs")
    found, paths, trims = [], [], 0
    while not live.isEmpty():
        n = live.count()
        trimmed = table(_trimmed(live), "pairs")
        shortened = _shortened(trimmed)
        drop(live)
        if shortened:
            live, (hung, rings) = table(shortened[0], "pairs"), (table(x, "paths") for x in shortened[1:])
            drop(trimmed)
            paths.append(hung)
            found.append(rings)
        else:
            live = trimmed
        trims += 1
        if live.count() < n and trims < TRIMS:
            continue
        trims = 0
        of = lambda colour, c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"colour_{c}"))
        forth = _least(live, "a", "b")
        inner = table(live.join(of(forth, "a"), "a").join(of(forth, "b"), "b").where("colour_a = colour_b").select("a", "b"), "pairs")
        back = _least(inner, "b", "a")
        whole = forth.join(back.withColumnRenamed("colour", "reaches"), "node").where("colour = reaches").select("node", F.col("colour").alias("component"))
        whole = table(whole, "component")
        found.append(whole)
        done = whole.select("node")
        rest = inner.join(of(back, "a"), "a").join(of(back, "b"), "b").where("colour_a = colour_b").select("a", "b")
        rest = rest.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        before, live = live, table(rest, "pairs")
        drop(before, inner)
    drop(live)
    if not found:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    for hung in reversed(paths):  # a path belongs to the component that both of its ends are in
        loops = hung.where("a = b").select(F.col("a").alias("node")).distinct().join(out, "node", "left_anti").withColumn("component", F.col("node"))
        out = table(out.unionByName(loops), "component")
        ends = lambda c: out.select(F.col("node").alias(c), F.col("component").alias(f"component_{c}"))  # noqa: B023, E731
        own = hung.join(ends("a"), "a").join(ends("b"), "b").where("component_a = component_b").select("node", F.col("component_a").alias("component"))
        out = table(out.unionByName(own), "component")
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    return out.join(sizes, "component").select("node", F.col("least").alias("component"))


def on_cycles(pairs: DataFrame) -> DataFrame:
    """Every node of pairs (a, b) that lies on a cycle of two nodes or more."""
    return strong_components(pairs).select("node")


def cycle_witnesses(pairs: DataFrame) -> DataFrame:
    """For each strong component of pairs (a, b) a shortest cycle through its least node, of any length, as simple_cycles() gives them."""
    of = table(strong_components(pairs), "components")
    steps = pairs.where("a <> b").distinct().join(of.select(F.col("node").alias("a"), "component"), "a")
    steps = table(steps.join(of.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other").select("a", "b"), "pairs")
    paths = of.where("node = component").select(F.col("node").alias("at"), F.array("node").alias("path"))
    seen, out = None, None
    while True:
        went = paths.join(steps, F.col("at") == F.col("a")).select(F.element_at("path", 1).alias("root"), F.col("b").alias("at"), "path")
        went = table(went.groupBy("root", "at").agg(F.min("path").alias("path")), "paths")
        closed = went.where("at = root").select("path")
        out = closed if out is None else out.unionByName(closed)
        ended = out.select(F.element_at("path", 1).alias("root"))
        paths = went.join(ended, "root", "left_anti")
        paths = paths if seen is None else paths.join(seen, ["root", "at"], "left_anti")
        paths = table(paths.withColumn("path", F.concat("path", F.array("at"))), "paths")
        if paths.isEmpty():
            return out.select("path", F.size("path").alias("edge_count"))
        seen = paths.select("root", "at") if seen is None else seen.unionByName(paths.select("root", "at"))
        paths = paths.select("at", "path")
