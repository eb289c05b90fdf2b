"""op12 sorts its turns by ranges once; what is built from them stays in those slices."""

from ravelin.llm import conversation_trie
from tests.llm.test_conversation_trie import CASES, brute, got


def test_ranges_once(spark, monkeypatch):
    frame, calls = type(spark.range(0)), []
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: calls.append(a) or deal(self, *a))
    rows = CASES["lenders of all lengths, groups with and without their first"]
    assert got(spark, rows) == brute(rows)
    assert len(calls) == 1


def test_pieces_of_ends(spark, monkeypatch):
    """Ids far apart and near, below and above zero, in pieces of one and of many."""
    rows = [(c, 0, "user", "same") for c in (-(2**62), -5, -1, 0, 5, 10, 11 * 5, 2**40, 2**62)]
    for chunk in (1, 2, 1 << 12):
        monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
        assert got(spark, rows) == brute(rows)
