"""Strong components against a depth-first search, and how many tables a chain takes."""

import random

import pytest

from ravelin.operators import traverse

rng = random.Random(3)


def brute(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    to = {a: reach(a) for a in out}
    groups = {a: min(b for b in to[a] if a in to[b]) for a in out if a in to[a]}
    return {a: c for a, c in groups.items() if sum(x == c for x in groups.values()) > 1}


def chain(n, names=None):
    names = names or [f"{i:04}" for i in range(n)]
    return list(zip(names, names[1:], strict=False))


def shuffled(n):
    names = [f"{i:04}" for i in range(n)]
    rng.shuffle(names)
    return names


GRAPHS = {
    "a ring on a chain": [*chain(20), ("0012", "0007")],
    "a ring": [*chain(9), ("0008", "0000")],
    "two rings through one node, and loops": [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "d"), ("e", "e"), ("d", "x"), ("x", "y")],
    "parallel paths of a cycle": [("s", "p1"), ("p1", "p2"), ("p2", "e"), ("s", "q1"), ("q1", "e"), ("e", "r"), ("r", "s"), ("s", "z1"), ("z1", "z2"), ("z2", "end"), ("end", "z9")],
    "parallel paths of none": [("s", "p1"), ("p1", "e"), ("s", "q1"), ("q1", "e")],
    "random": [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(55)],
    "dense and without cycles": [(f"{i:02}", f"{j:02}") for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.6],
    "cycles in a row": [e for i in range(4) for e in [(f"{i}a", f"{i}b"), (f"{i}b", f"{i}c"), (f"{i}c", f"{i}a"), (f"{i}b", f"{i}a"), (f"{i}c", f"{i + 1}a"), (f"{i}a", f"{i + 1}b")]],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = traverse.strong_components(spark.createDataFrame(GRAPHS[name], "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == brute(GRAPHS[name])


@pytest.mark.parametrize("names", [None, shuffled(1000)])
def test_a_chain_takes_few_rounds_and_leaves_no_tables(spark, monkeypatch, names):
    kept, made = set(), []
    write, forget = traverse.table, traverse.drop

    def table(df, name):
        out = write(df, name)
        kept.add(out.written_to)
        made.append(name)
        return out

    monkeypatch.setattr(traverse, "table", table)
    monkeypatch.setattr(traverse, "drop", lambda *ts: (forget(*ts), kept.difference_update(t.written_to for t in ts)))
    assert traverse.strong_components(spark.createDataFrame(chain(1000, names), "a string, b string")).isEmpty()
    assert len(made) <= 30 and len(kept) <= 6, (made, kept)
