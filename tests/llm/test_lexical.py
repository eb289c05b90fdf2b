"""op11 against scores of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ravelin.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, k=50):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c in terms:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=50):
    rows = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, rows.collect()), key=str)


def corpus(n, seed):
    random = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(120)]
    return [(i, " ".join(random.choice(words, int(random.integers(0, 40)), p=(p := 1 / np.arange(1, 121)) / p.sum()))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Trees of few entries, leaves of few documents, few items at once, so that all paths are taken."""
    monkeypatch.setattr(lexical, "ENTRIES", 300)
    monkeypatch.setattr(lexical, "LEAF", 3)
    monkeypatch.setattr(lexical, "TOGETHER", 4)
    monkeypatch.setattr(lexical, "AT_ONCE", 50)


@pytest.mark.parametrize("k", [1, 7, 50])
def test_brute_force(spark, small, k):
    docs, items = corpus(400, 1), corpus(11, 2)
    assert got(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_of_items(spark, small, monkeypatch):
    docs, items = corpus(100, 3), corpus(9, 4)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 20)
    assert lexical.in_blocks(lexical.item_terms(spark.createDataFrame(items, ITEMS))).select("block").distinct().count() > 2
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_items_of_very_many_terms(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 5)  # sums in integers
    docs, items = corpus(60, 5), corpus(6, 6)
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [
        (None, "alpha beta"), (None, "alpha beta"), (3, None), (4, ""), (5, " .,;"), (6, "ALPHA beta"), (6, "alpha"), (2, "alpha beta"), (1, "alpha beta"),
        (7, "Àlpha ÀLPHA alpha_beta x y  "), (8, "١٢ alpha2 2alpha"), (9, "gamma " * 3000 + "alpha"), (10, "\x00alpha\x7fbeta~"),
    ]
    items = [(1, "Alpha, beta!"), (1, "gamma"), (None, "gamma"), (None, "Àlpha ١٢"), (2, None), (3, ""), (4, "nothing here"), (5, "x y ÀLPHA"), (6, "alpha alpha alpha")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, None)], items) == []


def test_copies_and_clashing_columns(spark, small):
    docs = [(i, "the same words again") for i in range(200)] + corpus(50, 7)
    items = [(0, "same words w1"), (1, "again")]
    assert got(spark, docs, items) == brute(docs, items)
    wide = spark.createDataFrame([(*r, 1, "x", "y") for r in docs], DOCS + ", rank int, score string, ITEM_ID string")
    rows = lexical.ranked(wide, spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, rows.collect()), key=str) == brute(docs, items)


def test_bounds_keep_items_out(monkeypatch):
    """Of documents with rare terms only those below promising nodes are scored."""
    monkeypatch.setattr(lexical, "LEAF", 4)
    texts = [f"common words {'abcdefghijklmnop'[i % 16] * 3} number{i // 16}" for i in range(1600)]
    vocabulary = {t: i for i, t in enumerate(sorted({w.encode() for t in texts for w in t.split()}))}
    vectors = [np.array(sorted(vocabulary[w.encode()] for w in t.split())) for t in texts]
    df = np.bincount(np.concatenate(vectors), minlength=len(vocabulary))
    pairs = [(i, w.encode()) for i in range(10) for w in f"common {'abcdefghij'[i] * 3}".split()]
    items = lexical.Items(pairs, vocabulary, df, len(texts), sum(map(len, vectors)))
    numbers = [np.sort(items.number[v]) for v in vectors]
    ids = np.stack([np.arange(1600), np.zeros(1600, int)], axis=1)
    tree = lexical.Tree(np.cumsum([len(v) for v in vectors]), np.concatenate(numbers), np.ones(6400, np.int64), items.m(np.full(1600, 4)), ids)
    best = [lexical.Best(5) for _ in items.ids]
    assert lexical.search_tree(tree, items, best) < 0.1 * len(texts) * len(items.ids)
    scores = [(-int(items.parts(np.intersect1d(n, items.terms[0]), 1, items.m(np.array([4]))).sum()), i) for i, n in enumerate(numbers)]
    found = best[0].settle()
    assert [(-s, i) for s, i in zip(found[0].tolist(), found[1][:, 0].tolist(), strict=True)] == sorted(scores)[:5]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.text("aAbB é.", max_size=12))), max_size=12),
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.text("aAbB é.", max_size=8))), max_size=5),
)
def test_any_tables(spark, docs, items):
    assert got(spark, docs, items, 3) == brute(docs, items, 3)
