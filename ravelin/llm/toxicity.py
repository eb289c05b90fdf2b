"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are weak rules about a text. Lexicon voters look for a word or the start
of a word; they come from the labelled texts, as the words and stems that are
`LEAST_RATIO` times as frequent in toxic ones. Pattern voters look at form
(shouting, emphasis, repetition, brevity). The given label is one more voter,
on the rows it may be learned from, since it can be wrong too.

The label model says that each text is toxic or not, unseen, and that each
voter fires with a rate of its own for either (its accuracy). Voters are
correlated within a class too: the model is a forest in which a voter's rate
also depends on what one other voter says, the one it shares most information
with beyond the class. So a voter that repeats its parent adds almost nothing
to the likelihood. Expectation maximisation estimates rates and forest. The
classifier is a logistic regression of the posteriors on what the lexicon and
pattern voters see in a text.

Voters, label model and classifier are fitted on at most `max_rows` labelled
rows, taken by a hash of doc_id; scores then cover every whole text in one pass
without a shuffle. Labels are used only where `learnable`; labels, lang,
source and doc_id are no input of a score.

Defined cases: a null or empty text has the score of a text in which no voter
fires. Rows of one doc_id are scored each by its own text. A doc_id with
several labels counts as toxic if one says so; null labels count as none.
Without any learnable label of either kind the score is the share of toxic
ones (0 without labels). Other columns, of whatever name, are not read; keep_clean() returns them as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.scratch import table, unused

#: Labelled rows that are learned from, at most.
MAX_ROWS = 20_000
#: Lexicon voters, at most; a stem or word must be in this share of toxic texts, in LEAST_TEXTS, and LEAST_RATIO times as frequent there.
MAX_LEXICON, LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO = 200, 0.02, 3, 25.0
#: Lengths of stems, in letters.
STEMS = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = 4
#: Twice the texts times the information that two voters must share to depend on each other (chi square of 2 degrees, 1 in 1,000).
LEAST_DEPENDENCE = 13.8
CAPITALS, BEYOND_ASCII = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(r"[^\x00-\x7f]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def signs(words: set[str]) -> set[str]:
    """The words and their stems (with a hyphen at the end)."""
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def capitals(text: str) -> int:
    """The upper-case characters of the whole text; those of A-Z are counted as bytes, which is faster."""
    raw = text.encode("utf-8", "surrogatepass")
    count = len(raw) - len(raw.translate(None, CAPITALS))
    return count if len(raw) == len(text) else count + sum(map(str.isupper, BEYOND_ASCII.findall(text)))


def patterns(text: str, n_words: int, n_different: int) -> list[int]:
    """What the pattern voters say: 1 each for shouting, emphasis, repetition and brevity."""
    return [int(capitals(text) * 3 > len(text)), int("!!" in text), int(n_words > 20 and n_different * 4 < n_words), int(n_words < 8)]


class Scorer:
    """The classifier: a weight for each voter, for any lexicon hit and for their number."""

    def __init__(self, lexicon: list[str], weights: np.ndarray):
        self.place = {s: i for i, s in enumerate(lexicon)}
        self.weights = weights
        self.heads = {s[:4] for s in lexicon}

    def row(self, text: str | None) -> np.ndarray:
        """The classifier's input: lexicon, patterns, any hit, logarithm of hits, and a constant."""
        text, n = text or "", len(self.place)
        words = WORD.findall(text.lower())
        different = set(words)
        out = np.zeros(n + PATTERNS + 3, np.float32)
        near = {w for w in different if w[:4] in self.heads}
        hits = [self.place[s] for s in signs(near) if s in self.place] if near else []
        out[hits] = 1
        out[n : n + PATTERNS] = patterns(text, len(words), len(different))
        out[n + PATTERNS :] = bool(hits), np.log1p(len(hits)), 1
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))


def depends_on(votes: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each voter the one that it depends on beyond the class, or -1: a spanning forest of greatest mutual information within the classes.

    sides: the probabilities of either class. Dependences that chance explains (LEAST_DEPENDENCE) are none.
    """
    n, known = len(votes), np.zeros((votes.shape[1],) * 2)
    for p in sides:
        for one in (votes, 1 - votes):
            for other in (votes, 1 - votes):
                both = ((one * p[:, None]).T @ other + 1e-9) / n
                apart = np.outer(p @ one + 1e-9, p @ other + 1e-9) / n / max(p.sum(), 1e-9)
                known += both * np.log(both / apart)
    parent, best, left = np.full(len(known), -1), np.full(len(known), LEAST_DEPENDENCE / 2 / n), np.ones(len(known), bool)
    for _ in range(len(known)):  # the voter nearest to those that have a place comes next
        j = np.argmax(np.where(left, best, -np.inf))
        left[j] = False
        nearer = left & (known[j] > best)
        parent[nearer], best[nearer] = j, known[j][nearer]
    return parent


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior probabilities that texts are toxic, and the model: prior, parents, and rates by class, what the parent says, and voter.

    votes: texts by voters, 1 where a voter fires. gold: the given labels.
    """
    votes = votes.astype(np.float64)
    posterior = np.where(gold > 0, 0.9, 0.05)
    prior = (gold.sum() + 1) / (len(gold) + 2)  # the classes' balance is the labels'
    for _ in range(rounds):
        sides = posterior, 1 - posterior
        parent = depends_on(votes, sides)
        above = np.where(parent >= 0, votes[:, parent], 0)
        rates, label = np.zeros((2, 2, votes.shape[1])), np.zeros(2)
        for y, p in enumerate(sides):
            alone = (p @ votes + 0.5) / (p.sum() + 2)
            for said, where in ((0, 1 - above), (1, above)):  # few texts say little, and leave the rate near that of the class
                rates[y, said] = (p @ (votes * where) + 2 * alone) / (p @ where + 2)
            label[y] = (p @ gold + 0.5) / (p.sum() + 2)
        rates, label = np.clip(rates, 1e-4, 1 - 1e-4), np.clip(label, 1e-4, 1 - 1e-4)
        says, silent = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        given = np.where(gold > 0, np.log(label[0] / label[1]), np.log((1 - label[0]) / (1 - label[1])))  # a label says one or the other
        heard = np.where(votes > 0, np.where(above > 0, says[1], says[0]), np.where(above > 0, silent[1], silent[0]))
        logit = np.log(prior / (1 - prior)) + given + heard.sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, {"prior": np.array(prior), "parent": parent, "rates": rates, "label": label}


def regression(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression of probabilities on rows, by Newton's method; the last column is the constant."""
    x, w = rows.astype(np.float64), np.zeros(rows.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + penalty * w
        bend = (x * np.clip(p * (1 - p), 1e-6, None)[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(bend, slope)
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text and toxic of learnable rows, max_rows at most, the same on every run: those whose doc_id has the least hashes."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taken = table(given.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_rows), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # bounded by max_rows
    if rows.count() > max_rows:  # a doc_id has several rows
        rows = rows.orderBy(F.xxhash64(F.lit(7), "doc_id", "text"), "doc_id", "text").limit(max_rows)
    return table(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")


def lexicon(texts: DataFrame) -> list[str]:
    """Words and stems that set toxic texts apart, the best first. Equal texts count once.

    Of signs that begin one another only the best is a voter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                sides[toxic].update(signs(set(WORD.findall((text or "").lower()))))
            found = list(sides[1])  # only what toxic texts hold can be chosen
            counts = [pa.array([side[s] for s in found], pa.int64()) for side in (sides[1], sides[0])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *counts], ["sign", "toxic", "clean"])
            rest = [s for s in sides[0] if s not in sides[1]]
            yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array(np.zeros(len(rest), np.int64)), pa.array([sides[0][s] for s in rest], pa.int64())], ["sign", "toxic", "clean"])

    once = table(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "different_texts")
    n_toxic, n_clean = (once.where(F.col("toxic") == y).count() for y in (1, 0))
    least = max(LEAST_TEXTS, LEAST_SHARE * n_toxic)
    counts = once.mapInArrow(work, "sign string, toxic long, clean long").groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    order = (F.desc(F.log(ratio) * F.col("toxic")), F.desc(F.length("sign")), "sign")
    found = counts.where((F.col("toxic") >= least) & (ratio >= LEAST_RATIO)).orderBy(*order).limit(20 * MAX_LEXICON)
    chosen: list[str] = []
    for (sign,) in found.select("sign").collect():
        bare = sign.removesuffix("-")
        if not any(bare.startswith(c) or c.startswith(bare) for c in (x.removesuffix("-") for x in chosen)):
            chosen.append(sign)
    return chosen[:MAX_LEXICON]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Scorer:
    """The classifier, from learnable labels of max_rows rows at most."""
    texts = labelled_texts(docs, labels, max_rows)
    scorer = Scorer(words := lexicon(texts), np.zeros(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scorer.row(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("toxic")], ["row", "toxic"])

    seen = texts.mapInArrow(work, "row binary, toxic int").collect()  # bounded by max_rows
    n = len(words) + PATTERNS + 3
    rows = np.array([np.frombuffer(r[0], np.float32) for r in seen]).reshape(-1, n)
    gold = np.array([r[1] for r in seen])
    if not len(gold) or gold.all() or not gold.any():
        weights = np.zeros(n)
        weights[-1] = 30.0 if len(gold) and gold.all() else -30.0
        return Scorer(words, weights)
    order = np.lexsort((gold, [zlib.crc32(r.tobytes()) for r in rows]))  # the same sums on every run
    rows, gold = rows[order], gold[order]
    posterior, _ = label_model(rows[:, : len(words) + PATTERNS], gold)
    return Scorer(words, regression(rows, posterior))


def score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with their score in a new column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by MAX_LEXICON

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shared.value
            rows = np.array([made.row(t.as_py()) for t in batch.column("text")]).reshape(-1, len(made.weights))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.score(rows))], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, `{name}` double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs whose score is below the threshold."""
    name = unused(docs, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)
