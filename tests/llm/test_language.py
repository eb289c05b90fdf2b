"""op13: posteriors against sums over all labellings, gradients against differences, held-out accuracy, odd input."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import language

SCHEMA = "doc_id long, text string, lang string"
PARTS = {"aa": ["ka", "lo", "mi", "ne", "ru"], "bb": ["sch", "ung", "ei", "pf", "en"], "cc": ["ção", "ñe", "ll", "ia", "os"]}


def text(lang, n, seed):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(PARTS[lang], random.integers(1, 4))) for _ in range(n))


def rows(n, words=40):
    return [(i, text(lang := list(PARTS)[i % 3], words, i), lang) for i in range(n)]


@pytest.fixture(scope="module")
def field(spark):
    return language.fit(spark.createDataFrame(rows(300), SCHEMA))


def test_posteriors_are_sums_over_all_labellings():
    random = np.random.default_rng(0)
    field = language.Field(["a", "b", "c"], np.empty(0, np.uint64))
    field.transitions, field.begin = random.normal(size=(3, 3)), random.normal(size=3)
    says, begins = random.random((9, 3)), np.isin(np.arange(9), [0, 4, 5])
    weight = np.zeros((9, 3))
    for labels in itertools.product(range(3), repeat=9):
        w = 1.0
        for i, x in enumerate(labels):
            w *= says[i, x] * np.exp(field.begin[x] if begins[i] else field.transitions[labels[i - 1], x])
        for i, x in enumerate(labels):
            weight[i, x] += w
    assert np.allclose(field.posteriors(says, begins), weight / weight.sum(axis=1, keepdims=True))


def test_blocks_do_not_matter(monkeypatch):
    random = np.random.default_rng(1)
    field = language.Field(["a", "b"], np.empty(0, np.uint64))
    field.transitions, field.begin = random.normal(size=(2, 2)), random.normal(size=2)
    says, begins = random.random((1000, 2)), np.isin(np.arange(1000), [0, 1, 600])
    whole = []
    for block in (3, 96, 5000):
        monkeypatch.setattr(language, "BLOCK", block)
        whole.append(field.posteriors(says, begins))
    assert np.allclose(whole[0], whole[2]) and np.allclose(whole[1], whole[2])


def test_steps_follow_the_gradient(monkeypatch):
    """A first step of plain size moves transitions and weights along the numeric gradient of the likelihood."""
    windows = [("aa", text("aa", language.WORDS, 1).split()), ("bb", text("bb", language.WORDS, 2).split())]
    flat = [w for _, ws in windows for w in ws]
    words = language.Words.of(flat)
    chains = np.arange(len(flat)).reshape(2, -1)
    chains[0, 9:], said = np.arange(25, 32), np.array([[0] * 9 + [1] * 7, [1] * 16])
    random = np.random.default_rng(3)
    field = language.Field(["aa", "bb"], np.empty(0, np.uint64))
    field.weights[:] = random.normal(scale=0.1, size=field.weights.shape)
    field.weights[0] = 0
    field.transitions = random.normal(size=(2, 2))

    def likelihood():
        total = 0.0
        for chain, labels in zip(chains, said, strict=True):
            grams, whole, at = language.features(words, 0, len(flat), field.lexicon)
            score = np.add.reduceat(field.weights[grams[0]] + field.weights[grams[1]], at, axis=0).astype(float) + sum(field.weights[w].astype(float) for w in whole)
            own = field.begin[labels[0]] + sum(score[w, x] for w, x in zip(chain, labels, strict=True)) + sum(field.transitions[a, b] for a, b in itertools.pairwise(labels))
            now = np.logaddexp.reduce((field.begin + score[chain[0]])[None], axis=0)
            for w in chain[1:]:
                now = np.logaddexp.reduce(now[:, None] + field.transitions, axis=0) + score[w]
            total += own - np.logaddexp.reduce(now)
        return total / len(chains)

    def by_differences(x, at):
        kept, out = x[at], []
        for d in (1e-2, -1e-2):
            x[at] = kept + d
            out.append(likelihood())
        x[at] = kept
        return (out[0] - out[1]) / 2e-2

    seen = int(language.features(words, 0, 1, field.lexicon)[0][0][1])
    want = [by_differences(field.transitions, (0, 1)), by_differences(field.begin, 0), by_differences(field.weights, (seen, 0))]
    monkeypatch.setattr(language, "RIDGE", 0.0)
    grown = [np.zeros(x.shape) for x in (field.weights, field.transitions, field.begin)]
    language._step(field, words, chains, said, grown)  # what it adds up are squares of the gradient
    assert np.allclose(np.sqrt([grown[1][0, 1], grown[2][0], grown[0][seen, 0]]), np.abs(want), rtol=2e-2, atol=1e-4)


def test_held_out_accuracy(spark, field):
    got = language.predict(spark.createDataFrame(rows(300), SCHEMA), field).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_text(spark, field):
    parts = [text("aa", 30, 1001), text("bb", 20, 1002), text("aa", 25, 1003), text("cc", 30, 1004)]
    mixed = ". ".join(parts)
    (row,) = language.words(spark.createDataFrame([(1, mixed, None)], SCHEMA), field).collect()
    assert [s.lang for s in row.stretches] == ["aa", "bb", "aa", "cc"]
    for s, part in zip(row.stretches, parts, strict=True):
        assert abs(s.n_words - len(part.split())) <= 1 and s.score > 0.8
        assert len(set(mixed[s.start : s.end].split()) ^ set(part.split())) <= 2
    assert sum(s.n_words for s in row.stretches) == 105
    (row,) = language.predict(spark.createDataFrame([(1, mixed, None)], SCHEMA), field).collect()
    assert row.lang_pred == "aa" and row.score < 0.7


def test_labels_held_out_are_never_read(spark, field):
    wrong = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows(300)] + [(None, "ka ka", "dd"), (900, None, "ee"), (901, "ka", None)]
    other = language.fit(spark.createDataFrame(wrong, SCHEMA))
    assert other.languages == field.languages and np.array_equal(other.weights, field.weights) and np.array_equal(other.transitions, field.transitions)


def test_rows_are_bounded_by_max_rows(spark):
    learnable = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    same = [(learnable, "ka lo mi", "aa")] * 500 + [(i, text("bb", 5, i), "bb") for i in range(500)]
    windows = language.sampled(spark.createDataFrame(same, SCHEMA), 20)
    assert len(windows) == 20 and {lang for lang, _ in windows} == {"aa", "bb"}


def test_odd_input(spark, field):
    odd = [(1, None, "aa"), (1, "", "aa"), (None, " 12 ... \n", "bb"), (2, "ka", None), (3, "KA LO MI", "x"), (4, text("bb", 30_000, 5), "bb"), (5, "ka" * 60_000, "aa"), (6, "漢字 \U0001d400 İ", None)]
    schema = SCHEMA + ", LANG_PRED string, score int, `od d` string"
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in odd], schema)
    found = language.predict(frame, field)
    assert found.columns == [*frame.columns, "lang_pred_", "score_"]
    got = found.collect()
    assert [(r[-2], r[-1]) for r in got[:3]] == [("und", 0.0)] * 3
    assert [r[-2] for r in got[3:7]] == ["aa", "aa", "bb", "aa"] and got[7][-2] in field.languages
    assert [len(r[-1]) for r in language.words(frame, field).collect()][:5] == [0, 0, 0, 1, 1]
    assert language.predict(spark.createDataFrame([], SCHEMA), field).collect() == []


@pytest.mark.parametrize("labelled", [[], [(0, None, "aa")], [(i, "...", "aa") for i in range(4)]])
def test_nothing_to_learn_from(spark, labelled):
    none = language.fit(spark.createDataFrame(labelled, SCHEMA))
    frame = spark.createDataFrame([(1, "ka lo", None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language.predict(frame, none).collect()] == [("und", 0.0)]
    assert language.words(frame, none).collect()[0].stretches == []


def test_one_language(spark):
    one = language.fit(spark.createDataFrame([(i, "ka lo", "aa") for i in range(6)], SCHEMA))
    assert language.predict(spark.createDataFrame([(1, "anything", None)], SCHEMA), one).first().lang_pred == "aa"


def test_words_and_their_places():
    words = language.Words(pa.array(["Ab c", None, "", "1é-x\n", "İ"]))
    assert (words.text.tolist(), words.place.tolist(), words.size.tolist()) == ([0, 0, 3, 3, 4], [0, 3, 1, 3, 0], [2, 1, 1, 1, 1])
    assert words.strings(np.arange(5)) == ["ab", "c", "é", "x", "i"]
