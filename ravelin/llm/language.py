"""Language of words and texts, by a linear-chain conditional random field.

A text is a chain of words (runs of letters, in lower case), and every word has
a language. What a word says about its language is a sum of learned weights of
its features: its first and last letters (affixes), its n-grams, and itself if
it is in the lexicon of frequent words. Learned transitions say how the
language goes on from word to word, so that code-switched text is labelled in
stretches. Forward-backward gives each word's posterior, over the whole text.

    fit      windows of words from at most MAX_ROWS labelled texts, spread over the languages and over each
             text; half of the chains are spliced from two texts, from which transitions are learned. Gradient
             steps on the chains' likelihood
    words    stretches of one language in each text, with their places
    predict  the language with the largest share of a text's words (sum of posteriors), and that share as score

Scoring is one pass without a shuffle. The words of many texts are one chain in
which a text's first word forgets what came before. The chain is cut into
blocks that are multiplied side by side, then what enters each block is known,
then posteriors follow, so no step waits for a single long text. Work per word
grows with the cube of the number of languages.

Defined cases: a text that is null or has no letter is `und` with score 0. Rows
of one doc_id are texts of their own. Rows without doc_id, text or lang are not
learned from. Without any learnable row every text is `und`. Of more than
MAX_LANGUAGES languages the most frequent are learned. A label that no row has
cannot be predicted. Other columns, of whatever name, are not read; predict()
and words() return them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.scratch import table, unused

#: Labelled texts that are learned from, at most; and languages.
MAX_ROWS, MAX_LANGUAGES = 4_000, 200
#: Windows of a text that are learned from, words of a window, and letters of a word in it.
WINDOWS, WORDS, LETTERS = 8, 16, 48
#: Weights for each kind of feature; words of the lexicon, and how often one must be met.
BUCKETS, LEXICON, LEAST = 1 << 15, 20_000, 5
#: Passes over the windows, chains of a step, step size, and pull towards 0.
ROUNDS, STEP, RATE, RIDGE = 3, 256, 0.5, 1e-6
#: Bytes of texts that are one chain, code points that get features at once, and words of a block.
AT_ONCE, CODES, BLOCK = 4_000_000, 1_000_000, 96
#: Parts of a language whose least keys are found apart.
SHARES = 16
UNKNOWN = "und"
BEGIN, END = 1, 2
AFFIXES = (2, 3, 4)
_FOLDED: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _folded() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    if not _FOLDED:
        _FOLDED.append(np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], np.uint32))
    return _FOLDED[0]


class Words:
    """Words of texts: letters in a row (BEGIN and END around each word), where each word starts there, its text, and its place in it."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        codes = np.frombuffer("\n".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy() + 1)))[: len(texts)]
        letters = _folded()[np.minimum(codes, 0x10FFFF)]
        inside = letters > 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        self.text = np.searchsorted(starts, first, side="right") - 1
        self.place, self.size = first - starts[self.text], last - first
        self._put(letters[inside])

    @classmethod
    def of(cls, words: list[str]) -> Words:
        """Each of words, which are all letters, as a word."""
        self = cls.__new__(cls)
        self.text, self.place, self.size = np.arange(len(words)), np.zeros(len(words), np.int64), np.fromiter(map(len, words), np.int64, len(words))
        self._put(_folded()[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)])
        return self

    def _put(self, letters: np.ndarray) -> None:
        self.at = np.concatenate(([0], np.cumsum(self.size + 2)))
        self.row = np.full(self.at[-1], BEGIN, np.uint32)
        self.row[self.at[1:] - 1] = END
        self.row[np.arange(len(letters)) + np.repeat(2 * np.arange(len(self.size)) + 1, self.size)] = letters

    def __len__(self) -> int:
        return len(self.size)

    def strings(self, chosen: np.ndarray) -> list[str]:
        parts = (self.row[self.at[i] + 1 : self.at[i + 1] - 1] for i in chosen.tolist())
        return [(x if len(x) <= LETTERS else np.concatenate((x[: LETTERS // 2], x[-LETTERS // 2 :]))).tobytes().decode("utf-32-le", "surrogatepass") for x in parts]


def _mix(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """A number from 1 to BUCKETS for the symbols of each place."""
    h = np.full(len(parts[0]), (seed * 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64) + 1


def features(words: Words, first: int, last: int, lexicon: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Numbers of the weights of words [first, last): for each symbol of their row, for each word, and where each word starts in the row.

    0 is no feature. lexicon: sorted hashes of its words.
    """
    at = words.at[first : last + 1] - words.at[first]
    row = words.row[words.at[first] : words.at[last]]
    size = words.size[first:last]
    after = np.append(row, [END, END]).astype(np.uint32)
    one, two = after[1:-1], after[2:]
    open_, wide = row != END, (row != END) & (one != END)
    grams = [np.where(open_, _mix([row, one], 1), 0), np.where(wide, _mix([row, one, two], 2) + BUCKETS + 1, 0)]
    base, whole = 2 * (BUCKETS + 1), []
    for seed, k in enumerate(AFFIXES):
        fits = size >= k
        for side, begin in enumerate((at[:-1] + 1, at[1:] - 1 - k)):
            begin = np.where(fits, begin, 0)
            here = _mix([row[begin + i] if len(row) else begin.astype(np.uint32) for i in range(k)], 10 + 2 * seed + side)
            whole.append(np.where(fits, here + base, 0))
            base += BUCKETS + 1
    hashes = word_hashes(row, at)
    near = np.searchsorted(lexicon, hashes)
    known = lexicon[np.minimum(near, len(lexicon) - 1)] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
    whole.append(np.where(known, near + base, 0))
    return grams, whole, at[:-1]


N_WEIGHTS = (2 + 2 * len(AFFIXES)) * (BUCKETS + 1)


def word_hashes(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits for each word of a row."""
    if len(at) < 2:
        return np.empty(0, np.uint64)
    sizes = np.diff(at)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    with np.errstate(over="ignore"):
        x = (row.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * powers[np.arange(len(row)) - np.repeat(at[:-1], sizes)]
        return np.add.reduceat(x, at[:-1])


class Field:
    """The random field: languages, lexicon, weights of features by language, transitions and what begins a text (logarithms)."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((N_WEIGHTS + len(lexicon), n), np.float32)
        self.transitions, self.begin = np.zeros((n, n)), np.zeros(n)

    def says(self, words: Words) -> np.ndarray:
        """What each word says about each language, the most being 1."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        first = 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(words.at, words.at[first] + CODES, side="right")) - 1)
            grams, whole, at = features(words, first, last, self.lexicon)
            summed = np.add.reduceat(self.weights[grams[0]] + self.weights[grams[1]], at, axis=0)
            for w in whole:
                summed += self.weights[w]
            out[first:last] = summed
            first = last
        out -= out.max(axis=1, keepdims=True)
        return np.exp(np.maximum(out, -30.0))

    def posteriors(self, says: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of every word the probability of each language, by forward-backward over the whole chain.

        begins: whether a word is the first of its text.
        """
        n, k = says.shape
        n_blocks = max(1, -(-n // BLOCK))
        given = np.ones((n_blocks * BLOCK, k))
        given[:n] = says
        fresh = np.ones(n_blocks * BLOCK, bool)
        fresh[:n] = begins
        given = np.ascontiguousarray(given.reshape(n_blocks, BLOCK, k).swapaxes(0, 1))
        fresh = np.ascontiguousarray(fresh.reshape(n_blocks, BLOCK).T)[:, :, None]
        moves, begin = np.exp(self.transitions - self.transitions.max()), np.exp(self.begin - self.begin.max())

        def along(state: np.ndarray, j: int) -> np.ndarray:
            new = np.where(fresh[j], state.sum(axis=-1, keepdims=True) * begin, state @ moves) * given[j]
            return new / new.sum(axis=-1, keepdims=True)

        def product() -> np.ndarray:
            """Each block as a matrix from what enters it to what leaves it."""
            m = np.broadcast_to(np.eye(k), (n_blocks, k, k))
            for j in range(BLOCK):
                m = np.where(fresh[j][:, :, None], m.sum(axis=-1, keepdims=True) * begin, m @ moves) * given[j][:, None, :]
                m = m / m.sum(axis=(1, 2), keepdims=True)
            return m

        enters, leaves = np.empty((n_blocks, k)), np.empty((n_blocks, k))
        state, after = np.full(k, 1 / k), np.ones(k)
        if n_blocks > 1:
            m = product()
            for b in range(n_blocks):
                enters[b] = state
                state = state @ m[b]
                state /= state.sum()
            for b in range(n_blocks - 1, -1, -1):
                leaves[b] = after
                after = m[b] @ after
                after /= after.sum()
        else:
            enters[0], leaves[0] = state, after
        forward = np.empty_like(given)
        now = enters
        for j in range(BLOCK):
            now = forward[j] = along(now, j)
        now = leaves
        for j in range(BLOCK - 1, -1, -1):
            forward[j] *= now
            heard = given[j] * now
            now = np.where(fresh[j], (heard @ begin)[:, None], heard @ moves.T)
            now = now / now.sum(axis=-1, keepdims=True)
        out = forward.swapaxes(0, 1).reshape(-1, k)[:n]
        return out / out.sum(axis=1, keepdims=True)


def _step(field: Field, words: Words, chains: np.ndarray, said: np.ndarray, grown: list[np.ndarray]) -> None:
    """One gradient step on chains (word numbers, chain by place) whose languages are `said`. grown: sums of squares of earlier gradients."""
    n, length = chains.shape
    k = len(field.languages)
    flat = chains.ravel()
    begin, sizes = words.at[flat], words.size[flat] + 2
    part = Words.__new__(Words)
    part.size, part.at = words.size[flat], np.concatenate(([0], np.cumsum(sizes)))
    part.row = words.row[np.repeat(begin - part.at[:-1], sizes) + np.arange(part.at[-1])]
    grams, whole, at = features(part, 0, len(flat), field.lexicon)
    score = np.add.reduceat(field.weights[grams[0]] + field.weights[grams[1]], at, axis=0).astype(np.float64)
    for w in whole:
        score += field.weights[w]
    given = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30)).reshape(n, length, k)
    moves, start = np.exp(field.transitions - field.transitions.max()), np.exp(field.begin - field.begin.max())
    forward, backward = np.empty_like(given), np.ones_like(given)
    for j in range(length):
        now = (start if j == 0 else forward[:, j - 1] @ moves) * given[:, j]
        forward[:, j] = now / now.sum(axis=1, keepdims=True)
    for j in range(length - 2, -1, -1):
        now = (given[:, j + 1] * backward[:, j + 1]) @ moves.T
        backward[:, j] = now / now.sum(axis=1, keepdims=True)
    post = forward * backward
    post /= post.sum(axis=2, keepdims=True)
    true = np.eye(k)[said]
    both = np.zeros((k, k))
    for j in range(1, length):
        pair = forward[:, j - 1, :, None] * moves * (given[:, j] * backward[:, j])[:, None, :]
        both += (true[:, j - 1, :, None] * true[:, j, None, :] - pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    wrong = ((true - post) / n).reshape(-1, k)
    slope = np.zeros(field.weights.shape)
    word_of = np.repeat(np.arange(len(flat)), sizes)
    for c in range(k):
        for g in grams:
            slope[:, c] += np.bincount(g, wrong[word_of, c], len(slope))
        for w in whole:
            slope[:, c] += np.bincount(w, wrong[:, c], len(slope))
    slope[0] = 0
    slope -= RIDGE * field.weights
    for x, s, g in zip((field.weights, field.transitions, field.begin), (slope, both / n, (true[:, 0] - post[:, 0]).mean(axis=0)), grown, strict=True):
        g += s * s
        x += (RATE * s / np.sqrt(g + 1e-8)).astype(x.dtype)


def learned(windows: list[tuple[str, list[str]]], seed: int = 13) -> Field:
    """The field, from (language, words) windows of WORDS words each."""
    languages = sorted({lang for lang, _ in windows})
    flat = [w for _, ws in windows for w in ws]
    words = Words.of(flat)
    hashes, counts = np.unique(word_hashes(words.row, words.at), return_counts=True)
    often = np.lexsort((hashes, -counts))[:LEXICON]
    field = Field(languages, np.sort(hashes[often[counts[often] >= LEAST]]))
    if len(languages) < 2:
        return field
    of = np.searchsorted(languages, [lang for lang, _ in windows])
    numbers = np.arange(len(flat)).reshape(-1, WORDS)
    random = np.random.default_rng(seed)
    grown = [np.zeros(x.shape) for x in (field.weights, field.transitions, field.begin)]
    for _ in range(ROUNDS):
        order, other = random.permutation(len(windows)), random.permutation(len(windows))
        cut = np.where(random.random(len(windows)) < 0.5, WORDS, random.integers(1, WORDS, len(windows)))  # a whole window, or two halves
        own = np.arange(WORDS)[None, :] < cut[:, None]
        chains = np.where(own, numbers[order], numbers[other])
        said = np.where(own, of[order][:, None], of[other][:, None])
        for at in range(0, len(chains), STEP):
            _step(field, words, chains[at : at + STEP], said[at : at + STEP], grown)
    return field


def sampled(docs: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str, list[str]]]:
    """(language, words) windows of at most max_rows learnable rows (one each at least for every language), the same on every run.

    docs: doc_id, text, lang. Rows are taken by the least hashes of doc_id and text within a language.
    """
    rows = docs.select("text", "lang", F.xxhash64(F.lit(13), F.col("doc_id").cast("string"), "text").alias("key"), "doc_id")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).drop("doc_id")
    by_lang = Window.partitionBy("lang").orderBy("key")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang").collect()
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    shares = Window.partitionBy("lang", F.pmod("key", F.lit(SHARES))).orderBy("key")  # so no task sees more of a language than SHARES * each keys
    least = rows.select("lang", "key").withColumn("i", F.row_number().over(shares)).where(F.col("i") <= each)
    least = least.withColumn("i", F.row_number().over(by_lang)).where(F.col("i") <= each)
    bounds = least.where(F.col("lang").isin([r[0] for r in counts])).groupBy("lang").agg(F.max("key").alias("most"))
    taken = rows.join(F.broadcast(bounds), "lang").where(F.col("key") <= F.col("most")).select("lang", "key", "text")  # MAX_LANGUAGES rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, out = [], [], []
            for i in range(batch.num_rows):
                words = Words(batch.column("text").slice(i, 1))
                if not len(words):
                    continue
                starts = np.unique(np.linspace(0, max(0, len(words) - WORDS), WINDOWS).astype(int))
                chosen = (starts[:, None] + np.arange(WORDS)).ravel() % len(words)  # a short text is repeated
                langs.append(batch.column("lang")[i].as_py())
                keys.append(batch.column("key")[i].as_py())
                out.append(words.strings(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.string()))], ["lang", "key", "words"])

    seen = taken.mapInArrow(work, "lang string, key long, words array<string>")
    seen = seen.withColumn("i", F.row_number().over(by_lang)).where(F.col("i") <= each)  # copies share a hash
    found = sorted((lang, key, words) for lang, key, words, _ in table(seen, "windows").collect())  # bounded by max_rows
    return [(lang, words[a : a + WORDS]) for lang, _, words in found for a in range(0, len(words), WORDS)]


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Field:
    """The field, from the rows of docs (doc_id, text, lang) that may be learned from."""
    return learned(sampled(docs, max_rows))


def _chains(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in stretches of about AT_ONCE bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    group = np.cumsum(size.astype(np.int64)) // AT_ONCE
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def _labelled(docs: DataFrame, field: Field, names: list[str], schema: str, answer) -> DataFrame:
    """docs with what answer(words, posteriors, number of texts) makes of each chain, in new columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # its size depends on the number of languages only

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for part in _chains(batch) if batch.num_rows else ():
                words = Words(part.column("text"))
                if len(words) and field.languages:
                    post = field.posteriors(field.says(words), np.diff(words.text, prepend=-1) > 0)
                else:
                    post = np.zeros((len(words), max(1, len(field.languages))))
                yield pa.RecordBatch.from_arrays([*part.columns, *answer(field, words, post, part.num_rows)], [*part.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, {schema}")


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the language of each whole text and its share of the words, in new columns lang_pred and score."""
    names = [unused(docs, "lang_pred"), unused(docs, "score")]

    def answer(field: Field, words: Words, post: np.ndarray, n: int) -> list[pa.Array]:
        shares = np.stack([np.bincount(words.text, post[:, c], n) for c in range(post.shape[1])], axis=1)
        total = shares.sum(axis=1)
        best = shares.argmax(axis=1)
        known = total > 0
        score = np.where(known, shares.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        lang = np.where(known, np.array([*field.languages, UNKNOWN], object)[best], UNKNOWN)
        return [pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))]

    return _labelled(docs, field, names, f"`{names[0]}` string, `{names[1]}` double", answer)


def words(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the stretches of one language in each text, in a new column `stretches`: start and end (code points), lang, n_words, and mean posterior."""
    name = unused(docs, "stretches")

    def answer(field: Field, words: Words, post: np.ndarray, n: int) -> list[pa.Array]:
        best = post.argmax(axis=1) if len(post) else np.empty(0, np.int64)
        starts = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0)) if field.languages else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(words)) if len(starts) else starts
        sums = np.add.reduceat(post.max(axis=1), starts) if len(starts) else np.empty(0)
        columns = [
            pa.array(words.place[starts].astype(np.int32)), pa.array((words.place + words.size)[ends - 1].astype(np.int32)),
            pa.array(np.array(field.languages, object)[best[starts]] if len(starts) else [], pa.string()),
            pa.array((ends - starts).astype(np.int32)), pa.array(sums / np.maximum(ends - starts, 1)),
        ]
        rows = pa.StructArray.from_arrays(columns, ["start", "end", "lang", "n_words", "score"])
        counts = np.bincount(words.text[starts], minlength=n) if len(starts) else np.zeros(n, np.int64)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), rows)]

    kind = "array<struct<start: int, end: int, lang: string, n_words: int, score: double>>"
    return _labelled(docs, field, [name], f"`{name}` {kind}", answer)
