"""The brackets of Swift source as a tree of rows, over text without comments and literals.

`lexed` blanks what is no code: comments (nested too), the text of strings of
one or several lines, raw or not; what a string interpolates is code and stays.
Code keeps its length, so places are the same in both.

`pieces` cuts code at brackets and line ends and numbers the pieces. A bracket's
own number and that of the one that closes it bound what lies inside, as
numbers before and after a walk of a tree would: a piece is below a bracket if
its number lies between. Structure is found by windows, without joins:

  the partner   the next bracket of the same depth
  the parent    the last bracket opened one level up
  the nearest ancestor of some kind   the last one opened at a count of those open
  a word before here in this block    the last place of the word is past the block's start
  a word in this block                the same, seen from where the block is closed

Defined cases: a null text is empty. Brackets that are never closed end with
the file. A file is one row at first, and one partition of each window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IN_CODE = re.compile(r'//|/\*|#*"""|#*"|[()]')
IN_COMMENT = re.compile(r"/\*|\*/")
BRACKETS = r"(?<=[{}()\[\]\n])|(?=[{}()\[\]\n])"


def _blank(text: str) -> str:
    return text if text.isspace() else re.sub(r"[^\r\n]", " ", text)


def without_text(text: str) -> str:
    """Source text with comments and what literals say as blanks, of the same length and lines."""
    out: list[str] = []
    at, open_ = 0, []  # strings whose interpolation is being read: delimiter, hashes, brackets open in it
    while at < len(text):
        found = IN_CODE.search(text, at)
        if not found:
            out.append(text[at:])
            break
        out.append(text[at : found.start()])
        token, at = found.group(), found.end()
        if token == "//":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.append(_blank(text[found.start() : end]))
            at = end
        elif token == "/*":
            depth = 1
            while depth and (mark := IN_COMMENT.search(text, at)):
                depth += 1 if mark.group() == "/*" else -1
                at = mark.end()
            at = len(text) if depth else at
            out.append(_blank(text[found.start() : at]))
        elif token in "()":
            out.append(token)
            if open_:
                open_[-1][2] += 1 if token == "(" else -1
                if not open_[-1][2]:
                    quote, hashes, _ = open_.pop()
                    at = _string(text, at, quote, hashes, out, open_)
        else:
            hashes = token.count("#")
            out.append(token)
            at = _string(text, at, token[hashes:], hashes, out, open_)
    return "".join(out)


def _string(text: str, at: int, quote: str, hashes: int, out: list[str], open_: list[list]) -> int:
    """Reads a string's text from `at` to its end, or to where it interpolates; returns where code goes on."""
    marks = re.compile(re.escape(quote + "#" * hashes) + r"|\\" + "#" * hashes + r"(.)" + ("" if quote == '"""' else r"|\n"), re.DOTALL)
    begun = at
    while found := marks.search(text, at):
        at = found.end()
        if found.group(1) == "(":
            out += [_blank(text[begun : at - 1]), "("]
            open_.append([quote, hashes, 1])
            return at
        if found.group(1) is None:
            out += [_blank(text[begun : found.start()]), found.group()]
            return at
    out.append(_blank(text[begun:]))
    return len(text)


def lexed(sources: DataFrame) -> DataFrame:
    """sources (path, text) with their code; those that have it stay as they are."""
    if "code" in sources.columns:
        return sources

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = [without_text(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.string())], [*batch.schema.names, "code"])

    return sources.select("path", "text").mapInArrow(work, "path string, text string, code string")


def pieces(sources: DataFrame) -> DataFrame:
    """file, i (number), piece, line (from 0), opens and closes, and level: how many brackets are open around the piece, or around the pair that it is of.

    The file as a whole is a bracket, too.
    """
    cut = F.split(F.concat(F.lit("{"), F.col("code"), F.lit("}")), BRACKETS)
    own = lexed(sources).select(F.col("path").alias("file"), F.posexplode(cut).alias("i", "piece")).where("piece <> ''")
    opens, closes = F.col("piece").isin("{", "(", "["), F.col("piece").isin("}", ")", "]")
    run = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.select("*", opens.alias("opens"), closes.alias("closes"), F.sum(F.when(F.col("piece") == "\n", 1).otherwise(0)).over(run).alias("ends"), F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(run).alias("after"))
    return own.select("file", "i", "piece", "opens", "closes", (F.col("ends") - (F.col("piece") == "\n").cast("int")).cast("int").alias("line"), (F.col("after") - F.col("opens").cast("int")).alias("level"))


def last_before(rows: DataFrame, what: Column, by: list[str], name: str, order: tuple[str, ...] = ("i",), itself: bool = False) -> DataFrame:
    """rows with the last value of `what` that is not null, earlier in order (or here, too) and among those equal in by."""
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if itself else -1)
    return rows.withColumn(name, F.last(what, ignorenulls=True).over(over))


def brackets(sources: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """pieces() with, for brackets that open: end (the number of the one that closes it), head (the code before it in its level), and holds (which of words lie inside).

    seen: for every piece, the number of the last piece so far with each of words.
    """
    own = pieces(sources)
    run = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.array(*(F.max(F.when(F.col("piece").contains(w), F.col("i"))).over(run) for w in words)) if words else F.array().cast("array<int>")
    own = own.withColumn("seen", seen)
    own = last_before(own, F.when(~F.col("opens") & ~F.col("closes") & F.col("piece").rlike(r"\S"), F.trim("piece")), ["file", "level"], "head")
    pairs = Window.partitionBy("file", "level", F.col("opens") | F.col("closes")).orderBy("i")
    own = own.withColumn("partner", F.when(F.col("opens"), F.lead(F.struct("closes", "i", "seen")).over(pairs)))
    own = own.withColumn("end", F.when(F.col("partner.closes"), F.col("partner.i")))
    inside = F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.element_at("partner.seen", F.array_position(F.array(*map(F.lit, words)), w).cast("int")) > F.col("i"), F.lit(False))) if words else F.array().cast("array<string>")
    return own.withColumn("holds", F.when(F.col("opens"), inside)).drop("partner")


def with_parent(rows: DataFrame) -> DataFrame:
    """brackets() with parent: i, end, piece, head and holds of the bracket around each."""
    parent = F.struct("i", "end", "piece", "head", "holds")
    owners = rows.where("opens").select("file", "i", (F.col("level") + 1).alias("level"), parent.alias("owner"))
    both = rows.withColumn("member", F.lit(True)).unionByName(owners, allowMissingColumns=True)
    return last_before(both, F.col("owner"), ["file", "level"], "parent").where("member").drop("owner", "member")


def nearest(rows: DataFrame, kind: Column, name: str) -> DataFrame:
    """brackets() with the value of kind of the nearest bracket around each for which that is not null."""
    chosen = F.col("opens") & kind.isNotNull()
    both = rows.withColumn("member", F.lit(True)).unionByName(
        rows.where(chosen).select("file", "i", F.lit(1).alias("step"), kind.alias("kind")).unionByName(rows.where(chosen & F.col("end").isNotNull()).select("file", F.col("end").alias("i"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("kind"))),
        allowMissingColumns=True,
    )
    turn = F.when(F.col("member"), 0).otherwise(1)  # a bracket is not its own ancestor, and closes after what is at its end
    order = Window.partitionBy("file").orderBy("i", turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("turn", turn).withColumn("count", F.sum(F.coalesce("step", F.lit(0))).over(order))
    both = last_before(both, F.col("kind"), ["file", "count"], name, ("i", "turn"))
    return both.where("member").withColumn(name, F.when(F.col("count") > 0, F.col(name))).drop("member", "step", "kind", "turn", "count")


def contexts(sources: DataFrame, before: tuple[str, ...], within: tuple[str, ...], containers: Column) -> DataFrame:
    """For each line (file, pos): which of the words `before` precede it in its block, which of those `within` its block holds, its nearest container,
    and what stands before the last brace that it opens.

    containers: the container's name from a bracket's piece and head, or null.
    """
    words = (*before, *within)
    rows = nearest(with_parent(brackets(sources, words)), containers, "container")
    named = F.array(*map(F.lit, before))
    earlier = F.filter(named, lambda w: F.coalesce(F.element_at("seen", F.array_position(named, w).cast("int")) > F.col("parent.i"), F.lit(False)))
    held = F.filter("parent.holds", lambda w: w.isin(*within))
    lines = Window.partitionBy("file", "line").orderBy("i")
    first = rows.where("piece <> '\n' AND i > 0").withColumn("nth", F.row_number().over(lines))
    braces = first.where("piece = '{'").groupBy("file", "line").agg(F.max_by("head", "i").alias("head"))
    chosen = first.where("nth = 1").select("file", "line", earlier.alias("before"), held.alias("within"), "container")
    # an item of a loop may follow other brackets of its line, so the container is asked for where the word stands
    loops = rows.where(F.col("piece").rlike(r"\bForEach\s*$")).groupBy("file", "line").agg(F.min_by("container", "i").alias("loop_container"))
    out = chosen.join(braces, ["file", "line"], "left").join(loops, ["file", "line"], "left")
    return out.withColumnRenamed("line", "pos").withColumn("container", F.coalesce("loop_container", "container")).drop("loop_container")
