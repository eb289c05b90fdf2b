"""op12 against a trie of nested loops."""

import hashlib
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ravelin.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            said.setdefault(c, []).append(((turn is not None, turn or 0), name, (role, text)))
    said = {c: [x[2] for x in sorted(v)] for c, v in said.items()}

    def rebuilt(c):
        h = zlib.crc32(str(c).encode()) % 9
        lender = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        return tuple(said.get(lender, [])[:h] + said[c][h:])

    whole = {c: rebuilt(c) for c in said}
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA):
    nodes = conversation_trie.trie(spark.createDataFrame(rows, schema)).drop("node", "parent")
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, nodes.collect()), key=str)


CASES = {
    "lenders of all lengths, groups with and without their first": [
        (c, t, ("user", "assistant")[t % 2], f"{'shared' if t < 3 else c % 3} {t}") for c in range(40) for t in range(c % 11 + 1) if c != 15
    ],
    "nulls, ties and repeated rows": [
        (5, None, None, None), (5, None, "user", ""), (5, 1, "user", "é"), (5, 1, "user", "é"), (5, 1, "assistant", "b"), (None, 0, "user", "x"),
        (6, 0, "", ""), (7, 0, None, None), (8, 2, "user", "é"), (-3, 0, "user", "é"), (-4, 0, "user", "é"), (0, 0, "user", "a"), (0, 1, "user", "b"),
    ],
    "an end in the middle of an older path": [(10, 0, "user", "a"), (10, 1, "user", "b"), (20, 0, "user", "a"), (30, 0, "user", "a"), (30, 1, "user", "b"), (30, 2, "user", "c")],
    "role and text do not run together": [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "", "abc")],
    "copies": [(5 * c, t, "user", f"t{t}") for c in range(60) for t in range(4)],
}


@pytest.mark.parametrize("name", CASES)
def test_brute_force(spark, name):
    assert got(spark, CASES[name]) == brute(CASES[name])


def test_turnless_and_empty(spark):
    # 1 takes its first turns from 0, which has none, and loses as many of its own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(200)}
    lost = next(c for c in h if c % 5 and h[c] >= 1)
    rows = [(lost, 0, "user", "a"), (500, 0, "user", "b")]
    nodes = got(spark, rows)
    assert nodes == brute(rows)
    assert nodes[0][:6] == (lost, 0, None, 2, 1, 1)
    assert got(spark, []) == []


def test_long_conversation_and_clashing_columns(spark):
    rows = [(5, t, "user", f"{t % 7}") for t in range(3000)] + [(6, 0, "user", "x" * 100_000)]
    schema = SCHEMA + ", slice int, node string, depth int, NAME string"
    assert got(spark, [(*r, 1, "n", 2, "m") for r in rows], schema) == got(spark, rows)
    deepest = max(got(spark, rows), key=lambda r: r[1])
    assert deepest[:7] == (5, 3000, 5, 1, 0, 1, 0)


def test_long_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    assert got(spark, CASES["copies"]) == brute(CASES["copies"])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["u", "a", None]), st.sampled_from(["", "x", "y", None])), max_size=40))
def test_any_table(spark, rows):
    assert got(spark, rows) == brute(rows)
