"""Removal of repeated byte strings, by ranks of positions that grow in length until they are unique or long enough.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else, in the same document or another. Positions are ranked by what follows
them, sorted by Spark, and reranked at greater lengths, as in prefix doubling;
a position drops out once its rank is unique (nothing that long repeats there)
or once it is past the threshold (all of its windows repeat).

Ranking every position would sort all bytes in every round. So only
synchronising positions are ranked: of every window of `length` bytes, the
leftmost start of that `GRAM`-byte string in it with the least hash. Equal
windows have theirs at the same place, so no repeat is lost, and about one
position in sixty is left. Each stands for a stretch of neighbouring windows:

  round 1  ranks by the GRAM bytes: a position of unique rank drops out, with all its windows
  round 2  ranks by the whole stretch, all bytes of its windows: equal ones repeat as a whole, and are done
  round 3  what is left, at the edges of repeats, is ranked window by window
           at exactly `length` bytes; of equal stretches one takes part for all

The first two rounds are one sort by (first rank, second rank), through which
tasks stream with at most two positions in memory. Of positions equal in both
ranks a batch of texts sends only two to where that rank is sorted; the others
repeat for certain and go anywhere, so a rank that very many positions share
loads no task more than another. Equal windows have the same first rank, so
round 3 brings the stretches' bytes together by first rank and ranks their
windows inside the task, where no window is shuffled. A first rank with more
than AT_HOME bytes of different stretches is not ranked there: its windows are
sorted by Spark, each by its own rank, and so spread.

Ranks are 64-bit hashes, compared only among positions of one first rank, so a
stretch or window must agree in two of them. Spans come together by document, and a
document's bytes are cut in one pass. Texts are shuffled compressed.

Rows are told apart by doc_id and 128 bits of their text, so that rows without
a doc_id, or under one, keep their own spans.

Defined cases: a null text has no bytes. Texts shorter than length lose
nothing. Rows that share a doc_id are documents of their own; equal rows
repeat each other and lose the same bytes. A null doc_id is returned as null.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.scratch import table

LENGTH, GRAM = 200, 40
#: Windows of a text that are looked at together.
AT_ONCE = 1 << 18
#: Bytes of one first rank's stretches that round 3 ranks inside a task, and windows that it ranks at once.
AT_HOME, WINDOWS = 16_000_000, 200_000
LOW = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15
DONE, OPEN, FOR_ALL = 0, 1, 2
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64, up to n at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        out = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(max(n, 1 << 14), base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[0] = out[0], out[1]
    return _POWERS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the synchronising positions' grams, and first and last + 1 window of the stretches they stand for."""
    n_windows, wide = len(data) - length + 1, length - gram + 1
    for first in range(0, n_windows, AT_ONCE):
        count = min(AT_ONCE, n_windows - first)
        part = np.frombuffer(data, np.uint8, count + length - 1, first).astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(part) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(part * up[: len(part)])))
        grams = _mixed((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        key = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
        rows = np.concatenate([key, np.full(-len(key) % wide, 2**64 - 1, np.uint64)]).reshape(-1, wide)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:count], before[wide - 1 : wide - 1 + count]) & LOW).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        yield grams[place[starts]], starts + first, np.append(starts[1:], count) + first


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the text's compressed bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [squeeze.compress(t.as_buffer()) if t.is_valid else squeeze.compress(b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["doc_id", "text_hash", "data"])

    rows = docs.select("doc_id", _name(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, f"doc_id {_kind(docs)}, text_hash binary, data binary")


def _name() -> Column:
    """What tells texts of one doc_id apart: 128 bits."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("text_hash")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _beyond_two(grams: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether two earlier positions have the same gram and whole."""
    order = np.lexsort((whole, grams))
    g, w = grams[order], whole[order]
    out = np.zeros(len(g), bool)
    out[order[2:]] = (g[2:] == g[:-2]) & (w[2:] == w[:-2])
    return out


def positions(docs: DataFrame, length: int) -> DataFrame:
    """gram, whole (hashes), doc_id, text_hash, first and n (windows) of every synchronising position.

    known: the position is not among the first two of its gram and whole in a
    batch of texts, so it repeats for certain; its gram is then a random number.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, text in enumerate(batch.column("text")):
                data = text.as_py() or b""
                for grams, first, last in stretches(data, length):
                    whole = [hash_of(data[a : b + length - 1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    for out, x in zip(found, (grams, np.array(whole, np.uint64), np.full(len(first), i), first, last - first), strict=True):
                        out.append(x)
            if found[0]:
                grams, whole, row, first, n = map(np.concatenate, found)
                known = _beyond_two(grams, whole)
                grams[known] = _mixed(np.arange(known.sum(), dtype=np.uint64) + grams[known])
                who = batch.select(["doc_id", "text_hash"]).take(pa.array(row))
                columns = [pa.array(grams.view(np.int64)), pa.array(whole.view(np.int64)), *who.columns, pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(known)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "whole", "doc_id", "text_hash", "first", "n", "known"])

    rows = docs.select("doc_id", _name(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, f"gram long, whole long, doc_id {_kind(docs)}, text_hash binary, first int, n int, known boolean")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rounds 1 and 2 over positions sorted by gram and whole: those that stay, with what becomes of them."""
    names = ["gram", "doc_id", "text_hash", "first", "n", "state"]
    held, seen = None, None  # the last run's first two rows; a gram that has had a run before the held one

    def told(rows: pa.RecordBatch, at: np.ndarray, state: int) -> pa.RecordBatch:
        chosen = rows.select(names[:5]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.full(len(at), state, np.int32))], names)

    def runs(rows: pa.RecordBatch, end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, seen
        gram, whole = (rows.column(c).to_numpy() for c in ("gram", "whole"))
        starts = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]))))
        sizes = np.diff(np.append(starts, len(gram)))
        if not end:  # the last run may go on
            s, n = int(starts[-1]), int(sizes[-1])
            held = rows.slice(s, min(n, 2))
            yield told(rows, np.arange(s + 2, s + n), DONE)
        of = gram[starts]
        others = np.concatenate(([of[0] == seen if seen is not None else False], of[1:] == of[:-1]))
        others |= np.concatenate((of[1:] == of[:-1], [False]))
        if not end:
            if len(of) > 1:
                seen = of[-1] if of[-1] == of[-2] else None
            elif not others[0]:
                seen = None
            starts, sizes, others = starts[:-1], sizes[:-1], others[:-1]
        many = sizes > 1
        run = np.repeat(many, sizes)
        yield told(rows, np.flatnonzero(run) + (int(starts[0]) if len(starts) else 0), DONE)
        yield told(rows, starts[~many & others], OPEN)
        yield told(rows, starts[many & others], FOR_ALL)

    for batch in batches:
        known = batch.column("known")
        yield told(batch, np.flatnonzero(known.to_numpy(zero_copy_only=False)), DONE)
        batch = batch.filter(pc.invert(known))
        if batch.num_rows:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from runs(rows, end=False)
    if held is not None:
        yield from runs(held, end=True)


def _runs(row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows that follow each other in one row start, and how many they are."""
    starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)))) if len(row) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(row)))


def _window_ranks(rows: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Rank, row, first byte and whether it is OPEN of every window of rows."""
    n, first = rows.column("n").to_numpy().astype(np.int64), rows.column("first").to_numpy().astype(np.int64)
    hash_of = xxhash.xxh3_64_intdigest
    ranks = (hash_of(data[s : s + length]) for data, k in zip(rows.column("data").to_pylist(), n.tolist(), strict=True) for s in range(k))
    total = int(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return np.fromiter(ranks, np.uint64, total), row, first[row] + place, (rows.column("state").to_numpy() == OPEN)[row]


def _windows_at_home(batches: Iterator[pa.RecordBatch], length: int, at_home: int) -> Iterator[pa.RecordBatch]:
    """Round 3 over stretches sorted by gram: spans of repeated windows (data is null), and the stretches of grams too large to rank here."""
    names, waiting, held, large = ["gram", "doc_id", "text_hash", "first", "n", "state", "data"], [], 0, None

    def solved(rows: pa.RecordBatch) -> pa.RecordBatch:
        rank, row, first, open_ = _window_ranks(rows, length)
        gram = rows.column("gram").to_numpy()[row]
        order = np.lexsort((rank, gram))
        same = (rank[order][1:] == rank[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        twice = np.zeros(len(rank), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        twice &= open_
        row, first = row[twice], first[twice]
        starts, sizes = _runs(row, first)
        who = rows.select(["gram", "doc_id", "text_hash"]).take(pa.array(row[starts]))
        more = [pa.array(first[starts].astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(np.full(len(starts), DONE, np.int32)), pa.nulls(len(starts), pa.binary())]
        return pa.RecordBatch.from_arrays([*who.columns, *more], names)

    def ranked(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """solved() for whole grams, about WINDOWS windows at a time."""
        gram, before = rows.column("gram").to_numpy(), np.cumsum(rows.column("n").to_numpy().astype(np.int64))
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        at = 0
        while at < len(starts):
            done = before[starts[at] - 1] if starts[at] else 0
            last = max(at + 1, int(np.searchsorted(before[np.append(starts[1:], len(gram)) - 1], done + WINDOWS, side="right")))
            end = int(starts[last]) if last < len(starts) else len(gram)
            yield solved(rows.slice(int(starts[at]), end - int(starts[at])))
            at = last

    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        if large is not None:  # the large gram may go on
            n = int(np.searchsorted(gram, large, side="right"))
            yield batch.slice(0, n).select(names)
            if n == len(gram):
                continue
            batch, gram, large = batch.slice(n), gram[n:], None
        cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
        if cut or (waiting and waiting[-1].column("gram")[0].as_py() != gram[0]):
            rows = pa.Table.from_batches([*waiting, batch.slice(0, cut).select(names)]).combine_chunks().to_batches()
            for r in rows:
                yield from ranked(r)
            waiting, held = [], 0
        rest = batch.slice(cut).select(names)
        waiting.append(rest)
        held += rest.nbytes
        if held > at_home:
            yield from waiting
            waiting, held, large = [], 0, gram[-1]
    if waiting:
        for r in pa.Table.from_batches(waiting).combine_chunks().to_batches():
            yield from ranked(r)


def _windows_by_rank(left: DataFrame, length: int, kind: str) -> DataFrame:
    """Round 3 for stretches of large grams: every window is sorted by its rank, which spreads them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
            cuts = np.unique(np.searchsorted(ends, np.arange(WINDOWS, int(ends[-1]) + WINDOWS, WINDOWS)) + 1) if len(ends) else []
            at = 0
            for end in (min(int(c), len(ends)) for c in cuts):
                if end > at:
                    rows = batch.slice(at, end - at)
                    rank, row, first, open_ = _window_ranks(rows, length)
                    who = rows.select(["gram", "doc_id", "text_hash"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), *who.columns, pa.array(first.astype(np.int32)), pa.array(open_)], ["rank", "gram", "doc_id", "text_hash", "first", "open"])
                at = end

    windows = left.mapInArrow(work, f"rank long, gram long, doc_id {kind}, text_hash binary, first int, open boolean")

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ranks that more than one row has; the last row of a batch waits for the next one's first."""
        held, before = None, None

        def chosen(rows: pa.RecordBatch, same: np.ndarray) -> pa.RecordBatch:
            keep = same & rows.column("open").to_numpy(zero_copy_only=False)
            return rows.select(["doc_id", "text_hash", "first"]).filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            rank, gram = rows.column("rank").to_numpy(), rows.column("gram").to_numpy()
            equal = (rank[1:] == rank[:-1]) & (gram[1:] == gram[:-1])
            same = np.concatenate(([before == (rank[0], gram[0])], equal)) | np.concatenate((equal, [False]))
            yield chosen(rows.slice(0, len(rank) - 1), same[:-1])
            before = (rank[-2], gram[-2]) if len(rank) > 1 else before
            held = rows.slice(len(rank) - 1)
        if held is not None:
            yield chosen(held, np.array([before == (held.column("rank")[0].as_py(), held.column("gram")[0].as_py())]))

    dealt = windows.repartition("rank").sortWithinPartitions("rank", "gram")
    return dealt.mapInArrow(twice, f"doc_id {kind}, text_hash binary, first int").withColumn("n", F.lit(1))


def repeated_windows(texts: DataFrame, left: DataFrame, length: int, kind: str, at_home: int) -> DataFrame:
    """Round 3: doc_id, text_hash, first and n of the windows of OPEN stretches that start anywhere else, too."""
    per_doc = left.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("gram", "first", "n", "state")).alias("found"))
    both = _with_texts(texts, per_doc, "inner")
    names = ["gram", "doc_id", "text_hash", "first", "n", "state", "data"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, (data, found) in enumerate(zip(batch.column("data"), batch.column("found"), strict=True)):
                text, (gram, first, n, state) = unpack.decompress(data.as_py()), found.values.flatten()
                parts = [text[f : f + k + length - 1] for f, k in zip(first.to_pylist(), n.to_pylist(), strict=True)]
                who = batch.select(["doc_id", "text_hash"]).take(pa.array(np.full(len(parts), i)))
                yield pa.RecordBatch.from_arrays([gram, *who.columns, first, n, state, pa.array(parts, pa.binary())], names)

    schema = f"gram long, doc_id {kind}, text_hash binary, first int, n int, state int, data binary"
    dealt = both.mapInArrow(work, schema).repartition("gram").sortWithinPartitions("gram")
    ranked = table(dealt.mapInArrow(lambda batches: _windows_at_home(batches, length, at_home), schema), "windows")
    large = ranked.where(F.col("data").isNotNull())
    return ranked.where(F.col("data").isNull()).select("doc_id", "text_hash", "first", "n").unionByName(_windows_by_rank(large, length, kind))


def _with_texts(texts: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """texts with `found` of per_doc, always by a shuffle of both: the hint only says that per_doc is hashed, not sorted."""
    t, p = texts.alias("t"), per_doc.hint("shuffle_hash").alias("p")
    same = F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.text_hash") == F.col("p.text_hash"))
    return t.join(p, same, how).select("t.doc_id", "t.text_hash", "t.data", "p.found")


def cut(data: bytes, first: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int]:
    """data without the bytes that windows starting in [first, first + n) cover, and the number of runs that go."""
    order = np.argsort(first)
    a, b = first[order], np.maximum.accumulate((first + n)[order] + length - 1)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    starts, ends = a[new], b[np.append(new[1:], len(a)) - 1]
    kept = [data[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)]
    return b"".join(kept), len(starts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, at_home: int = AT_HOME) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay (kept) of each row of docs."""
    kind = _kind(docs)
    ranks = positions(docs, length).repartition("gram").sortWithinPartitions("gram", "whole")
    stay = table(ranks.mapInArrow(_ranked, f"gram long, doc_id {kind}, text_hash binary, first int, n int, state int"), "positions")
    texts = compressed(docs)
    windows = repeated_windows(texts, stay.where(F.col("state") != DONE), length, kind, at_home)
    spans = stay.where(F.col("state") == DONE).select("doc_id", "text_hash", "first", "n").unionByName(windows)
    per_doc = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n")).alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, kept, runs = [], [], []
            for data, found in zip(batch.column("data"), batch.column("found"), strict=True):
                text, n = unpack.decompress(data.as_py()), 0
                sizes.append(len(text))
                if found.is_valid and len(found):
                    fields = found.values.flatten()
                    text, n = cut(text, *(f.to_numpy().astype(np.int64) for f in fields), length)
                kept.append(text)
                runs.append(n)
            lost = np.array(sizes, np.int64) - np.fromiter(map(len, kept), np.int64, len(kept))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lost), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_texts(texts, per_doc, "left").mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
