"""SimHash near-dedup by meet-in-the-middle ball hashing.

The fingerprint of a text is the majority of the XXH64 hashes (seed 42) of its
word shingles, bit by bit. Fingerprints link at `radius` 3 or fewer differing
bits; documents of one connected component are near copies of each other.

The search works on distinct fingerprints, so that a group of equal ones, of
whatever size, is one row. Two of them at distance 3 differ in at least one of
three blocks of bits; with that block masked out at most 2 bits differ. So
each fingerprint emits, for each masked block, all variants within half of
that (1 bit), and those at distance 3 or less meet in a variant. Rows are
dealt by variant; in a bucket, links are verified against whole fingerprints
and returned as a forest, never as all pairs: a bucket of k fingerprints gives
fewer than k links. A bucket larger than `SMALL` is worked through by its
members' own balls, in time and memory in proportion to k. Its size is bounded
by the number of different fingerprints within 1 bit of one variant.

Defined cases: a null text is an empty one and has fingerprint zero, as any
text without a word; such texts link like any other. Rows that share a doc_id
each have a row in the result. A null doc_id takes part, but is never a
component's id while the component has another. Other columns of the input
are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.components import roots
from ravelin.llm.scratch import table, unused

#: First bit and width of the blocks that are masked out.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size are compared pair by pair, inside the task.
SMALL = 512
#: Shingles whose bits are counted at once.
CHUNK = 200_000


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, k = len(words), words_per_shingle
    if not n:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return hash_of(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - k] + 1))
    hashes = np.fromiter(
        (hash_of(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64,
        n - k + 1,
    )
    return int(np.packbits(_majority(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """variant and fp: for each masked block, fp without it and with at most one other bit flipped."""
    pairs = []
    for number, (first, width) in enumerate(BLOCKS):
        block = ((1 << width) - 1) << first
        outside = [bit for bit in range(64) if not block >> bit & 1]
        for flip in (0, *(1 << bit for bit in outside)):
            pairs.append((~block & (2**64 - 1), flip | (number + 1) << first))  # the block's own bits say which it is
    signed = lambda x: x - 2**64 if x >> 63 else x
    both = F.array(*(F.struct(F.lit(signed(m)).cast("long").alias("m"), F.lit(signed(x)).cast("long").alias("x")) for m, x in pairs))
    return fps.select("fp", F.explode(both).alias("v")).select(
        F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.x")).alias("variant"), "fp"
    )


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric truth matrix, the least row reachable."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def bucket_links(members: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what pairs of the distinct members at `radius` or fewer bits connect.

    members: distinct unsigned 64-bit fingerprints. A small bucket is compared
    pair by pair. In a large one, members in the ball (1 bit) of one variant
    are all within 2 bits of each other and hang on the first; a member 2
    bits from a variant is within 3 of those in its ball and hangs on one.
    """
    if len(members) <= SMALL or radius != 3:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
        label = _forest(near)
        moved = label != np.arange(len(members))
        return members[moved], members[label[moved]]
    flips = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ball = np.concatenate([members, *(members ^ f for f in flips)])
    owner = np.tile(members, 65)
    order = np.lexsort((owner, ball))
    ball, owner = ball[order], owner[order]
    first = np.concatenate(([True], ball[1:] != ball[:-1]))
    heads, head_owner = ball[first], owner[first]
    hung = head_owner[np.cumsum(first) - 1]
    out_a, out_b = [owner[owner != hung]], [hung[owner != hung]]
    for i in range(64):
        for j in range(i):
            probe = members ^ flips[i] ^ flips[j]
            at = np.minimum(np.searchsorted(heads, probe), len(heads) - 1)
            hit = (heads[at] == probe) & (head_owner[at] != members)
            out_a.append(members[hit])
            out_b.append(head_owner[at][hit])
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
    return pairs[0], pairs[1]


def _sorted_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all buckets in rows sorted by variant; the last bucket of a batch waits for the next."""
    names, held = ["a", "b"], (np.empty(0, np.int64), np.empty(0, np.uint64))

    def linked(variant: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        if len(fp):
            starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
            sizes = np.diff(np.append(starts, len(fp)))
            two = starts[sizes == 2]
            x, y = fp[two], fp[two + 1]
            near = np.bitwise_count(x ^ y) <= 3
            a.append(x[near])
            b.append(y[near])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                more = bucket_links(fp[s : s + n])
                a.append(more[0])
                b.append(more[1])
        both = np.stack([np.concatenate(a), np.concatenate(b)]) if a else np.empty((2, 0), np.uint64)
        both = np.unique(both, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(both)], names)

    for batch in batches:
        variant = np.concatenate([held[0], batch.column(0).to_numpy()])
        fp = np.concatenate([held[1], batch.column(1).to_numpy().view(np.uint64)])
        cut = np.searchsorted(variant, variant[-1]) if len(variant) else 0
        yield linked(variant[:cut], fp[:cut])
        held = variant[cut:], fp[cut:]
    yield linked(*held)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are 3 or fewer bits apart."""
    dealt = variants(fps).repartition("variant").sortWithinPartitions("variant", "fp")
    return dealt.mapInArrow(_sorted_links, "a long, b long").distinct()


def near_groups(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp, root (the component's least fingerprint) and component_id (its least doc_id) for each row of docs."""
    marked = table(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    linked = roots(links(distinct.select("fp")))
    placed = distinct.join(linked, distinct.fp == linked.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    members = table(placed.join(of_root, "root").select(F.col("fp").alias("of"), "root", "component_id"), "members")
    return marked.join(members, marked.fp == members.of).drop("of")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def named_rows(docs: DataFrame) -> DataFrame:
    """text, and as doc_id what tells rows apart that share an id or have none: whether it is null, it and the text's hash."""
    own = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    return docs.select(own.alias("doc_id"), "text")


def chosen_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs that chosen names (in a column component_id, by a doc_id of named_rows()), each once."""
    key = unused(docs, "row_key")
    keys = table(chosen.select(F.xxhash64("component_id.id", "component_id.text_hash").alias(key)).distinct(), "chosen")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text")))
    return keyed.join(keys, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def keep_one(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (null being the largest) and, of its texts, the one with the least hash."""
    return chosen_rows(docs, near_groups(named_rows(docs), words_per_shingle))
