"""Swift source files as rows: lines, declarations with their spans, and call sites, by DataFrame operations.

The scanner reads code without comments and literals (sources.syntax). Braces
are counted by a running sum over a file's lines, and a block ends at the first
line that brings the depth back: openings and closings meet in one window over
(file, depth), so no line is compared with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.paths import should_include, truncated_signature
from ravelin.plans.tables import table
from ravelin.sources.syntax import lexed

#: Folders that are left out unless a configuration says otherwise.
EXCLUDE = ["**/Generated/**", "**/Pods/**", "**/.build/**", "**/DerivedData/**"]
_MODIFIERS = r"(?:(?:@\w+(?:\([^)]*\))?|public|private|internal|fileprivate|open|package|final|static|class(?=\s+(?:func|var|let))|override|lazy|weak|unowned|mutating|nonisolated(?:\(unsafe\))?|async|convenience|required|indirect)\s+){0,8}"
DECLARATION = rf"^\s*({_MODIFIERS})(class|struct|enum|protocol|actor|extension|func|var|let|typealias|import|associatedtype|macro|case)\s+([`\w.]+)(.*)$"
KINDS = {  # fixed values
    "class": "class", "struct": "struct", "enum": "enum", "protocol": "protocol", "actor": "class", "extension": "extension", "func": "method", "var": "property",
    "let": "property", "typealias": "typeAlias", "import": "import", "associatedtype": "associatedType", "macro": "macro", "case": "enumCase",
}
ATTRIBUTE = r"(@\w+(?:\([^)]*\))?|nonisolated(?:\(unsafe\))?)"
_NOT_CALLS = ("if", "for", "while", "switch", "guard", "return", "func", "init", "catch", "repeat", "where", "in", "case")


def read(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, hash and text of all *.swift files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.swift").load(folder)
    found = found.where(should_include(F.col("path"), include, EXCLUDE if exclude is None else exclude))
    return found.select("path", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def split_lines(text: Column) -> Column:
    """The lines of a text; one line end at its end makes no empty line."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", ""), r"\r?\n", -1)


def lines(sources: DataFrame) -> DataFrame:
    """file, pos (from 0), line, code (of the same length), bare (code, strings being ""), depth before and after."""
    both = F.arrays_zip(split_lines(F.col("text")).alias("line"), split_lines(F.col("code")).alias("bare"))
    own = lexed(sources).select(F.col("path").alias("file"), F.posexplode(both).alias("pos", "x")).select("file", "pos", "x.line", F.col("x.bare").alias("code"), F.regexp_replace("x.bare", r'#*"+ *"+#*', '""').alias("bare"))
    up, down = F.regexp_count("bare", F.lit(r"\{")), F.regexp_count("bare", F.lit(r"\}"))
    run = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("opens", up).withColumn("after", F.sum(up - down).over(run))
    return own.withColumn("depth", F.col("after") - up + down)


def blocks(of: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (file, pos, depth, ...) with end: the line where the block that begins there ends, or the line itself."""
    closes = of.where("after < depth").select("file", F.explode(F.sequence(F.col("after"), F.col("depth") - 1)).alias("level"), F.col("pos").alias("at"))
    ends = closes.unionByName(starts.where("opens > 0 AND after > depth").select("file", F.col("depth").alias("level"), F.col("pos").alias("at")).distinct().withColumn("own", F.lit(True)), allowMissingColumns=True)
    later = Window.partitionBy("file", "level").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    ended = ends.withColumn("end", F.min(F.when(F.col("own").isNull(), F.col("at"))).over(later)).where("own")
    ended = ended.select("file", F.col("level").alias("depth"), F.col("at").alias("pos"), "end").groupBy("file", "depth", "pos").agg(F.min("end").alias("end"))
    return starts.join(ended, ["file", "depth", "pos"], "left").withColumn("end", F.coalesce("end", "pos"))


def with_text(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (file, pos, end, ...) with the text of their lines."""
    whole = sources.select(F.col("path").alias("file"), split_lines(F.col("text")).alias("_lines"))
    cut = F.array_join(F.slice("_lines", F.col("pos") + 1, F.col("end") - F.col("pos") + 1), "\n")
    return spans.join(whole, "file").withColumn("text", cut).drop("_lines")


def _with_attributes_above(of: DataFrame) -> DataFrame:
    """lines() with `above`: the attributes on the lines before that hold nothing else."""
    alone = F.col("bare").rlike(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*$")
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = of.withColumn("alone", alone).withColumn("group", F.coalesce(F.sum(F.when(alone, 0).otherwise(1)).over(before), F.lit(0)))
    # a group is lines of attributes and the line that they stand before; nothing else of their file is put together
    within = Window.partitionBy("file", "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("alone"), F.regexp_extract_all("bare", F.lit(ATTRIBUTE), F.lit(1)))
    return own.withColumn("above", F.flatten(F.collect_list(held).over(within))).drop("alone", "group")


def declarations(sources: DataFrame) -> DataFrame:
    """id, name, kind, keyword, file, pos, line, end_line, attributes, access_level, inherits, signature, container and text of declarations."""
    of = _with_attributes_above(lines(sources))
    part = lambda i: F.regexp_extract("bare", DECLARATION, i)
    found = of.withColumn("keyword", part(2)).where("keyword <> ''")
    mods, rest = part(1), part(4)
    access = F.initcap(F.regexp_extract(mods, r"\b(public|private|internal|fileprivate|open|package)\b", 1))
    found = found.select(
        "file", "pos", "depth", "after", "opens", "keyword", F.translate(part(3), "`", "").alias("name"),
        F.concat("above", F.regexp_extract_all(mods, F.lit(ATTRIBUTE), F.lit(1))).alias("attributes"),
        F.when(access == "", "Internal").when(access == "Fileprivate", "FilePrivate").otherwise(access).alias("access_level"),
        F.filter(F.transform(F.split(F.regexp_extract(rest, r"^\s*(?:<[^>]*>)?\s*:\s*([^{]+?)\s*(?:where\b.*)?\{?\s*$", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"[\s<].*$", "")), lambda x: x != "").alias("inherits"),
    )
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    found = found.withColumn("kind", F.when((F.col("keyword") == "func") & (F.col("depth") == 0), "function").otherwise(F.try_element_at(kinds, "keyword")))
    found = with_text(sources, blocks(of, found))
    ident = F.concat_ws("::", F.lit("ts"), "file", "name", F.col("pos").cast("string"))
    found = found.withColumn("id", ident).withColumn("signature", truncated_signature(F.col("text")))
    around = Window.partitionBy("file", "level").orderBy("pos", "inner")
    openers = found.select("file", (F.col("depth") + 1).alias("level"), "pos", F.lit(0).alias("inner"), F.col("id").alias("opener"), F.col("end").alias("until"))
    inner = found.select("file", F.col("depth").alias("level"), "pos", F.lit(1).alias("inner"), F.col("id").alias("own"))
    placed = openers.unionByName(inner, allowMissingColumns=True).withColumn("last", F.last(F.when(F.col("inner") == 0, F.struct("opener", "until")), ignorenulls=True).over(around))
    container = placed.where("inner = 1").select(F.col("own").alias("id"), F.when(F.col("pos") <= F.col("last.until"), F.col("last.opener")).alias("container"))
    found = found.join(container, "id", "left")
    return found.select("id", "name", "kind", "keyword", "file", "pos", (F.col("pos") + 1).alias("line"), (F.col("end") + 1).alias("end_line"), "attributes", "access_level", "inherits", "signature", "container", "text")


def calls(sources: DataFrame) -> DataFrame:
    """file, line and name of call sites; names of one letter or with a leading underscore are left out."""
    of = lines(sources)
    undeclared = F.regexp_replace("bare", r"\bfunc\s+[^\s(<]+(?:<[^>]*>)?", "")
    names = F.explode(F.regexp_extract_all(undeclared, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("name")
    found = of.select("file", (F.col("pos") + 1).alias("line"), names)
    return found.where((F.length("name") >= 2) & ~F.col("name").startswith("_") & ~F.col("name").isin(*_NOT_CALLS))


#: Calls on a collection that change it.
CHANGING = ("append", "insert", "remove", "removeAll", "removeLast", "removeFirst", "sort", "reverse", "merge", "formUnion", "subtract", "toggle")


def uses(sources: DataFrame) -> DataFrame:
    """file, line, name, own (written with self.) and changes of each name that a line uses: assigned to, or changed by a call."""
    name, change = r"(?<![\w.])((?:self\.)?[A-Za-z_]\w*)\b(?!\s*\()", rf"(?<![\w.])((?:self\.)?[A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?:(?:[-+*/%&|^]|<<|>>)?=(?!=)|\.(?:{'|'.join(CHANGING)})\s*\()"
    # what is declared, and labels of arguments, are no uses
    bare = F.regexp_replace(F.regexp_replace("bare", r"\b(?:let|var|func|case|for)\s+\w+", " "), r"\b\w+\s*:(?!:)", " ")
    found = lines(sources).select("file", (F.col("pos") + 1).alias("line"), F.regexp_extract_all(bare, F.lit(name), F.lit(1)).alias("all"), F.regexp_extract_all(bare, F.lit(change), F.lit(1)).alias("changed"))
    each = found.select("file", "line", F.explode(F.array_distinct(F.concat("all", "changed"))).alias("text"), "changed")
    return each.select("file", "line", F.regexp_replace("text", r"^self\.", "").alias("name"), F.col("text").startswith("self.").alias("own"), F.array_contains("changed", F.col("text")).alias("changes"))


def state_edges(sources: DataFrame, d: DataFrame) -> DataFrame:
    """source, target, kind, file and line of each use of a property in a function of its type: `mutates` if it changes it, else `references`.

    d: declarations. A name that the function declares itself is its own, unless written with self.
    """
    from ravelin.operators.store import enclosing

    functions = d.where("keyword = 'func'").select("file", "id", "line", "end_line", "container")
    properties = d.where("keyword IN ('var', 'let') AND container IS NOT NULL").select("container", "name", F.col("id").alias("target"))
    used = uses(sources).groupBy("file", "line", "name").agg(F.bool_or("own").alias("own"), F.bool_or("changes").alias("changes"))
    named = used.join(properties.select("name").distinct(), "name", "left_semi")
    within = enclosing(named.select("file", "line", "name"), functions).join(named, ["file", "line", "name"])
    within = within.join(functions.select(F.col("id").alias("caller"), "container"), "caller")
    local = properties.select(F.col("container").alias("caller"), "name", F.lit(True).alias("local")).distinct()
    within = within.join(local, ["caller", "name"], "left").where("own OR local IS NULL")
    kind = F.when(F.col("changes"), "mutates").otherwise("references")
    return within.join(properties, ["container", "name"]).select(F.col("caller").alias("source"), "target", kind.alias("kind"), "file", "line")


def graph(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of source files: containment, conformance, extension, calls to `name::X`, and what functions do with the properties of their types."""
    from ravelin.operators.store import enclosing, keep_first_edges

    sources = table(lexed(sources), "code")  # read by each of the passes below
    d = table(declarations(sources), "declarations")
    null = lambda kind: F.lit(None).cast(kind)
    nodes = d.select(
        "id", "name", F.col("name").alias("qualified_name"), "kind", null("string").alias("sub_kind"), "file", "line", F.lit(1).alias("col"), "end_line",
        null("int").alias("end_col"), "signature", "attributes", "access_level", F.col("container").alias("container_usr"), null("string").alias("doc_comment"),
        null("int").alias("lines"), null("int").alias("complexity"), null("int").alias("parameter_count"),
    )

    def edge(rows: DataFrame, source: str, target: Column, kind: Column | str, line: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select(F.col(source).alias("source"), target.alias("target"), kind.alias("kind"), "file", line.cast("int").alias("line"), null("int").alias("col"), F.lit(False).alias("is_implicit"))

    types = d.where("keyword IN ('class', 'struct', 'enum', 'actor')").select("id", "file", "line", F.explode("inherits").alias("parent"))
    called = enclosing(calls(sources), d.where("keyword = 'func'").select("file", "id", "line", "end_line"))
    edges = (
        edge(d.where("container IS NOT NULL"), "container", F.col("id"), "contains", null("int"))
        .unionByName(edge(types, "id", F.concat(F.lit("synthetic::"), F.col("parent")), "conformsTo", F.col("line")))
        .unionByName(edge(d.where("keyword = 'extension'"), "id", F.concat(F.lit("synthetic::"), F.col("name")), "extendsType", F.col("line")))
        .unionByName(edge(called, "caller", F.concat(F.lit("name::"), F.col("name")), "calls", F.col("line")))
        .unionByName(edge(state_edges(sources, d), "source", F.col("target"), F.col("kind"), F.col("line")))
    )
    return nodes, keep_first_edges(edges.withColumn("load_seq", F.lit(0))).drop("load_seq")


def snippet(sources: DataFrame, file: str, line: int, end_line: int | None = None) -> DataFrame:
    """The lines of a symbol: to its end or 20 lines on, and 50 at most."""
    last = min(end_line or line + 20, line + 50)
    whole = sources.where(F.col("path") == file).select(split_lines(F.col("text")).alias("l"))
    return whole.select(F.array_join(F.slice("l", line, last - line + 1), "\n").alias("snippet"))
