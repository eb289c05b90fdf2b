"""Ranked full text, substring and pattern search over symbols.

A symbol's fields are names, qualified names and signatures with weights. The
words of a field are its runs of letters and digits, in lower case. A query
is one pass for corpus statistics (one row) and one for the scores; neither
shuffles more than a partial aggregate, and the best rows come from a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.lookup import contains_text

#: The fields' weights, and the constants of BM25.
FIELDS = {"name": 10.0, "qualified_name": 5.0, "signature": 1.0}
K1, B = 1.2, 0.75
#: Words that say nothing about a task.
STOP_WORDS = (
    "a", "an", "the", "to", "in", "for", "of", "and", "or", "is", "it", "on", "at", "by",
    "add", "fix", "update", "implement", "create", "make", "change", "modify", "remove", "delete",
    "new", "from", "with", "this", "that", "screen", "page", "feature", "functionality", "function",
    "method", "should", "need", "want", "bug",
)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def keywords(task: Column) -> Column:
    """The words of a task with three bytes or more that are no stop words; case and repeats stay."""
    words = F.split(task, r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*STOP_WORDS))


def query_terms(query: str) -> list[tuple[str, bool]]:
    """Terms of a query and whether each is a prefix; without * or quotes the last one is."""
    import re

    words = [w.lower() for w in re.findall(r"[^\W_]+\*?", query)] if '"' not in query else [w.lower() for w in re.findall(r"[^\W_]+", query)]
    terms = [(w.rstrip("*"), w.endswith("*")) for w in words]
    if terms and "*" not in query and '"' not in query:
        terms[-1] = (terms[-1][0], True)
    return terms


def rarity(n: int, df: int) -> Column:
    """What a term that df of n symbols hold is worth."""
    return F.greatest(F.ln(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(1e-6))


def saturation(weight: Column, length: Column, average: float) -> Column:
    """How much of that a symbol gets in which the term has a weight, by the symbol's length in words."""
    return weight * (K1 + 1) / (weight + K1 * (1 - B + B * length / F.lit(float(average))))


def bm25(nodes: DataFrame, terms: list[tuple[str, bool]], limit: int | None = None) -> DataFrame:
    """nodes that hold every term, with their score (greater is better)."""
    words = nodes.select("*", *(tokens(F.col(f)).alias(f"_{f}") for f in FIELDS))

    def weight(term: str, prefix: bool) -> Column:
        same = (lambda w: w.startswith(term)) if prefix else (lambda w: w == term)
        return sum((F.size(F.filter(f"_{f}", same)) * F.lit(v) for f, v in FIELDS.items()), F.lit(0.0))

    length = sum((F.size(f"_{f}") for f in FIELDS), F.lit(0))
    counted = words.select(*nodes.columns, length.alias("_len"), *(weight(*t).alias(f"_w{i}") for i, t in enumerate(terms)))
    s = counted.agg(F.count(F.lit(1)), F.avg("_len"), *(F.count_if(F.col(f"_w{i}") > 0) for i in range(len(terms)))).first()
    n, average = s[0], s[1] or 1.0
    score, every = F.lit(0.0), F.lit(bool(terms))
    for i in range(len(terms)):
        w = F.col(f"_w{i}")
        score = score + rarity(n, s[2 + i]) * saturation(w, F.col("_len"), average)
        every = every & (w > 0)
    out = counted.where(every).select(*nodes.columns, score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def trigram(nodes: DataFrame, text: str) -> DataFrame:
    """nodes with the text (three characters or more) anywhere in the name."""
    return nodes.where(contains_text("name", text) if len(text) >= 3 else F.lit(False))


def trigram_postings(nodes: DataFrame) -> DataFrame:
    """trigram and id: an index for substring search that prunes before it verifies."""
    name = F.lower("name")
    cut = F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(name, i, F.lit(3)))
    return nodes.where(F.length("name") >= 3).select(F.explode(F.array_distinct(cut)).alias("trigram"), "id")


def indexed_substring(nodes: DataFrame, postings: DataFrame, text: str) -> DataFrame:
    """As trigram(), by way of the postings of all the text's trigrams."""
    q = text.lower()
    wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    ids = postings.where(F.col("trigram").isin(*wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return trigram(nodes.join(ids, "id", "left_semi"), text)


def search(nodes: DataFrame, query: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """The first of these that finds anything: all (for an empty query or *), ranked words, substring. Kinds are chosen before the limit."""
    own = nodes if kind is None else nodes.where(F.col("kind") == kind)
    if query.strip() in ("", "*"):
        out = own.withColumn("score", F.lit(0.0))
    else:
        terms = query_terms(query)
        out = bm25(own, terms) if terms else None
        if out is None or out.isEmpty():
            out = trigram(own, query)
            out = (out if len(query) >= 3 and not out.isEmpty() else own.where(contains_text("name", query))).withColumn("score", F.lit(0.0))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def resolve_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """The id that a name stands for: itself if it has ::, or the best match of search()."""
    return nodes.where(F.col("id") == name) if "::" in name else search(nodes, name, limit=1).select(*nodes.columns)


def resolve_symbol_conc(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that id or, if there is none, the best match by ranked words or, if there is none, the first name that holds it."""
    own, terms = nodes.where(F.col("id") == name), query_terms(name)
    if own.isEmpty() and terms:
        own = bm25(nodes, terms, 1).select(*nodes.columns)
    return nodes.where(contains_text("name", name)).orderBy("id").limit(1) if own.isEmpty() else own


def seeds(nodes: DataFrame, words: list[str], per_word: int = 10) -> DataFrame:
    """The best symbols for each word by exact words, each once: column id."""
    out = None
    for word in words:
        found = bm25(nodes, [(w, False) for w, _ in query_terms(word)], per_word).select("id")
        out = found if out is None else out.unionByName(found)
    return (out if out is not None else nodes.where(F.lit(False)).select("id")).distinct()
