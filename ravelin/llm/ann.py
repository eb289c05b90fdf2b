"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: rotations are learned on a bounded sample (each makes
the signs of the rotated vectors as close to them as it can), and a code's bits
are the signs after all of them. Vectors of unequal length are first lifted
onto a sphere by one more component, where the largest inner product is the
smallest angle. Codes are split into `substrings` pieces of `bits` bits, and
each piece is an index whose buckets are rows of a table, (piece, value). A
query probes in every piece all values within `flips` bits of its own. By the
pigeonhole principle a code that no probe meets differs in flips + 1 bits or
more in every piece, so every code within Hamming radius
substrings * (flips + 1) - 1 of the query's is retrieved, and of those beyond it
the ones that are near in some piece. Everything retrieved is ranked by the
inner products of the original vectors in double precision.

`bits`, `flips` and `substrings` are measured, not fixed: up to MEASURED queries
get their true neighbours by one scan, and of all plans that retrieve RECALL
of these the one with the least work is taken. So they follow
the table, at any size. If no plan retrieves that, every query is answered by scans of
all vectors, exactly.

The index is cut by rows: vectors are dealt into shards of about SHARD rows by a
hash, and a task builds the buckets of its shard (each piece's rows in the
order of their values, and where each value starts). Every query probes every shard, looks
at what the buckets give and nothing else, and gets k rows back; so vectors are shuffled once, and no pair is. (An
index dealt by bucket, joined with the probes, wrote 0.54 GB of pairs for 0.02 GB of vectors here.)
The first shards tell each query a score that its k-th neighbour has at
least; the others return only what reaches it. Queries are broadcast in rounds of at most
QUERY_BYTES. Equal vectors are one vector until the end: of those, a query
can only return the k with the smallest vec_id beside its own, so k + 1 are
kept, and a vector that very many rows share costs no more than one.

Defined cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do those whose length is not the most common one
(the smaller, if two are), nor rows without a vec_id. Rows that share a vec_id are candidates of
their own for other queries, never for each other; as queries, those with
different vectors each have k rows, and equal rows are one query. Ties go to the smaller
vec_id. Fewer candidates than k: all are returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.scratch import drop, table

#: Vectors that rotations are learned on, at most, and rounds of learning.
SAMPLE, ROUNDS = 4096, 8
#: Bits of a whole code, at most, and the sizes of pieces and numbers of flipped bits that are weighed against each other.
CODE_BITS, PIECES, FLIPS = 4096, range(4, 21), (0, 1, 2)
#: Share of the measured queries' true neighbours that must be retrieved, and the number of these queries.
RECALL, MEASURED = 0.95, 256
#: Ranking a row that is retrieved costs about as much as so many probes of a bucket.
PAIR = 3
#: Rows of a shard, about, and what share of the shards is searched first.
SHARD, FIRST = 16_384, 8
#: Bytes of queries that are broadcast at once, queries that probe at once, and rows that are multiplied at once.
QUERY_BYTES, PROBING, AT_ONCE = 32_000_000, 256, 20_000
FOUND = "u long, no long, least long, score double"


class Plan(NamedTuple):
    bits: int
    flips: int
    substrings: int


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (most["n"] if most else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """no, embedding, ids (the k + 1 smallest vec_ids, each with its number of rows), least (the first of them), solo (it, if there is no other)."""
    same = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    each = rows.groupBy(*same, "vec_id").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"))
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = each.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    own = few.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    least = F.col("ids")[0]["vec_id"]
    return own.select(F.monotonically_increasing_id().alias("no"), "h1", "h2", "embedding", "ids", least.alias("least"), F.when(F.size("ids") == 1, least).alias("solo"))


def learn(sample: np.ndarray, n_bits: int, seed: int = 42) -> np.ndarray:
    """Rotations, side by side, for n_bits bits at least: each is fitted in turns to the signs that it gives."""
    rng, d, out = np.random.default_rng(seed), sample.shape[1], []
    for _ in range(ceil(n_bits / d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(sample @ turn).T @ sample)
            turn = (u @ v).T
        out.append(turn)
    return np.concatenate(out, axis=1)


class Codes:
    """What turns vectors into pieces of codes: the rotations and the largest length among all rows."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        self.rotations = learn(self.lift(sample), CODE_BITS).astype(np.float32)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def pieces(self, x: np.ndarray, plan: Plan, query: bool) -> np.ndarray:
        """The values of x's pieces: a row for each vector, a column for each piece."""
        lifted = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lift(x)
        signs = lifted.astype(np.float32) @ self.rotations[:, : plan.bits * plan.substrings] > 0
        weights = 1 << np.arange(plan.bits, dtype=np.int32)
        return signs.reshape(len(x), plan.substrings, plan.bits) @ weights


def ball(plan: Plan) -> np.ndarray:
    """What a piece is combined with to give all values within plan.flips bits of it."""
    return np.array([sum(1 << b for b in c) for n in range(plan.flips + 1) for c in combinations(range(plan.bits), n)], np.int32)


def n_shards(n_rows: int) -> int:
    return max(1, ceil(n_rows / SHARD))


def plans(codes: Codes, queries: np.ndarray, near: np.ndarray, of: np.ndarray, others: np.ndarray, n_rows: int, n_queries: int) -> Iterator[tuple[float, float, float, Plan]]:
    """Cost (probes and rows for each query), recall on (queries[of], near), and the share of rows retrieved, of each plan that might do."""
    width = codes.rotations.shape[1]
    for bits in PIECES:
        whole = Plan(bits, 0, width // bits)
        q, n, o = codes.pieces(queries, whole, True), codes.pieces(near, whole, False), codes.pieces(others, whole, False)
        far = np.bitwise_count(q[of] ^ n)
        random = np.bitwise_count(q[:64, None] ^ o[None])
        for flips in (f for f in FLIPS if f < bits):
            hit = far <= flips
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), whole.substrings)
            recall = np.cumsum(np.bincount(first, minlength=whole.substrings + 1)[:-1]) / max(1, len(first))
            enough = np.flatnonzero(recall >= RECALL)
            m = int(enough[0]) + 1 if len(enough) else whole.substrings
            met = random[:, :, :m] <= flips
            values = sum(comb(bits, f) for f in range(flips + 1))
            pairs = max(float(met.sum(axis=2).mean()), m * values / 2**bits / 4) * n_rows
            yield m * (values * n_shards(n_rows) + n_rows / max(1, n_queries)) + PAIR * pairs, float(recall[m - 1]), float(met.any(axis=2).mean()), Plan(bits, flips, m)


def best_plan(codes: Codes, queries: np.ndarray, near: np.ndarray, of: np.ndarray, others: np.ndarray, n_rows: int, n_queries: int) -> Plan | None:
    """The cheapest plan with RECALL on the measured queries; None if no plan has it."""
    enough = [f for f in plans(codes, queries, near, of, others, n_rows, n_queries) if f[1] >= RECALL]
    return min(enough)[3] if enough else None


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Buckets:
    """A shard's index: for each piece, the rows in the order of their values, and where each value starts."""

    def __init__(self, pieces: np.ndarray, plan: Plan):
        self.near, self.n_rows = ball(plan), len(pieces)
        self.order = [np.argsort(values, kind="stable").astype(np.int32) for values in pieces.T]
        self.starts = [np.searchsorted(values[o], np.arange((1 << plan.bits) + 1)).astype(np.int32) for values, o in zip(pieces.T, self.order, strict=True)]

    def met(self, queries: np.ndarray) -> np.ndarray:
        """Which rows (columns) the probes of which query (rows) retrieve."""
        out = np.zeros((len(queries), self.n_rows), bool)
        for values, order, starts in zip(queries.T, self.order, self.starts, strict=True):
            probes = (values[:, None] ^ self.near).ravel()
            first, n = starts[probes], starts[probes + 1] - starts[probes]
            place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            out[np.repeat(np.arange(len(probes)) // len(self.near), n), order[place]] = True
        return out


def _best(u: np.ndarray, no: np.ndarray, least: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each u: the highest score, then the smallest least."""
    order = np.lexsort((no, least, -score, u))
    of = u[order]
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return order[place < k]


class _Kept:
    """The k best of each query among what has been seen, in memory for k of each at most and a lot of new ones."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.most = k, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > 2 * self.most + 300_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        columns = tuple(map(np.concatenate, zip(*self.parts, strict=True)))
        best = _best(*columns, self.k)
        columns = tuple(c[best] for c in columns)
        self.parts, self.held, self.most = [columns], len(best), len(best)
        return columns

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.cut()], ["u", "no", "least", "score"])


def _queries(units: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (ascending), components, own vec_ids and whether there is one."""
    units = units.sort_by("u")
    own = units.column("own").combine_chunks()
    return units.column("u").to_numpy(), _matrix(units.column("embedding")), own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)


def probed(shards: DataFrame, units: pa.Table, codes: Codes, plan: Plan, k: int) -> DataFrame:
    """The k best vectors of each query in each shard, of those that its probes retrieve: u, no, least, score.

    units with a column kth: only what has that score or more.
    """
    numbers, components, own, owned = _queries(units)
    kth = units.sort_by("u").column("kth").to_numpy() if "kth" in units.column_names else np.full(len(numbers), -np.inf)
    shared = shards.sparkSession.sparkContext.broadcast((codes, numbers, components, own, owned, kth))  # bounded by CODE_BITS and QUERY_BYTES

    def work(rows: pa.Table) -> pa.Table:
        codes, numbers, components, own, owned, kth = shared.value
        x, no, least = _matrix(rows.column("embedding")), rows.column("no").to_numpy(), rows.column("least").to_numpy()
        solo = rows.column("solo").combine_chunks()
        alone, solo = solo.is_valid().to_numpy(zero_copy_only=False), solo.fill_null(0).to_numpy()
        index, out = Buckets(codes.pieces(x, plan, False), plan), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in range(0, len(numbers), PROBING):
            met = index.met(codes.pieces(components[at : at + PROBING], plan, True))
            for i, row in enumerate(met, at):
                found = np.flatnonzero(row)
                if owned[i]:
                    found = found[~(alone[found] & (solo[found] == own[i]))]
                rough = x[found] @ components[i]  # a sum in another order differs by less than the margin
                bound = max(kth[i], np.partition(rough, -k)[-k]) if len(found) > k else kth[i]
                found = found[rough >= bound - 1e-9 * (1 + abs(bound))] if np.isfinite(bound) else found
                score = (x[found] * components[i]).sum(axis=1)
                found, score = found[score >= kth[i]], score[score >= kth[i]]
                best = np.lexsort((no[found], least[found], -score))[:k]
                out.append((np.full(len(best), numbers[i]), no[found[best]], least[found[best]], score[best]))
        return pa.table(dict(zip(("u", "no", "least", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return shards.select("no", "embedding", "least", "solo", "shard").groupBy("shard").applyInArrow(work, FOUND)


def scanned(groups: DataFrame, units: pa.Table, k: int) -> DataFrame:
    """The k best vectors of each of few queries in each partition, by all inner products: u, no, least, score."""
    shared = groups.sparkSession.sparkContext.broadcast(_queries(units))  # bounded by the caller

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, components, own, owned = shared.value
        kept, bound = _Kept(k), np.full(len(numbers), -np.inf)
        each = max(1, 2_000_000 // max(1, len(numbers)))
        for batch in batches:
            for s in range(0, batch.num_rows, each):
                part = batch.slice(s, each)
                x, solo = _matrix(part.column("embedding")), part.column("solo")
                rough = components @ x.T
                rough[owned[:, None] & (own[:, None] == solo.fill_null(0).to_numpy()) & solo.is_valid().to_numpy(zero_copy_only=False)] = -np.inf
                if rough.shape[1] >= k:  # a sum in another order differs by less than the margin
                    kth = np.partition(rough, -k, axis=1)[:, -k]
                    bound = np.maximum(bound, np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth), -np.inf))
                at, of = np.nonzero((rough >= bound[:, None]) & np.isfinite(rough))
                for p in range(0, len(at), AT_ONCE):
                    a, o = at[p : p + AT_ONCE], of[p : p + AT_ONCE]
                    kept.add(numbers[a], part.column("no").to_numpy()[o], part.column("least").to_numpy()[o], (x[o] * components[a]).sum(axis=1))
        yield from kept.rows()

    return groups.select("no", "embedding", "least", "solo").mapInArrow(work, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("u").orderBy(F.desc("score"), "least", "no")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _fitted(groups: DataFrame, units: DataFrame, n_rows: int, n_units: int, longest: float, k: int) -> tuple[Codes, Plan | None]:
    """Codes learned on a sample of vectors and the plan measured on a sample of queries."""
    by_hash = lambda df, n: df.orderBy(F.xxhash64("embedding"), *df.columns[:1]).limit(n)
    sample = _matrix(by_hash(groups.select("no", "embedding"), SAMPLE).toArrow().column("embedding"))
    some = by_hash(units.select("u", "embedding", "own"), MEASURED).toArrow().sort_by("u")
    near = _top(scanned(groups, some, k), k).join(groups.select("no", "embedding"), "no").select("u", "embedding").toArrow()
    codes = Codes(sample, longest)
    of = np.searchsorted(some.column("u").to_numpy(), near.column("u").to_numpy())
    queries = _matrix(some.column("embedding"))
    return codes, best_plan(codes, queries, _matrix(near.column("embedding")).reshape(-1, queries.shape[1]), of, sample[:512], n_rows, n_units)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, plan: Plan | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner product with each query."""
    rows = table(usable(vectors), "usable_vectors")
    groups = table(distinct_vectors(rows, k), "vectors")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n_rows, longest, width = groups.agg(F.count(F.lit(1)), F.max(length), F.max(F.size("embedding"))).first()
    if not n_rows:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")).distinct()
    solos = groups.where("solo is not null").select(F.col("solo").alias("own")).distinct()
    asked = asked.join(solos, asked.query_id == solos.own, "left")
    # a query without own has the same result as any other with its vector, but for the row of its own
    vectors_of = groups.select("h1", "h2", "embedding")
    units = table(asked.select("h1", "h2", "own").distinct().join(vectors_of, ["h1", "h2"]).withColumn("u", F.monotonically_increasing_id()), "queries")
    same = (F.col("a.h1") == F.col("u.h1")) & (F.col("a.h2") == F.col("u.h2")) & F.col("a.own").eqNullSafe(F.col("u.own"))
    query_ids = table(asked.alias("a").join(units.alias("u"), same).select("a.query_id", "u.u"), "query_ids")
    n_units = units.count()
    if not n_units:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes, fitted = _fitted(groups, units, n_rows, n_units, float(longest), k)
    plan = plan or fitted
    count = n_shards(n_rows)
    shards = groups.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "no"), F.lit(count)))
    first, rest = shards.where(F.col("shard") < ceil(count / FIRST)), shards.where(F.col("shard") >= ceil(count / FIRST))
    rounds = ceil(n_units * width * 8 / QUERY_BYTES)
    near = rows.sparkSession.createDataFrame([], FOUND)
    for r in range(rounds if plan else 0):
        part = units.where(F.pmod(F.xxhash64("u"), F.lit(rounds)) == r).select("u", "embedding", "own")
        found = table(_top(probed(first, part.toArrow(), codes, plan, k), k), "near")
        if count > 1:
            kth = found.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            told = part.join(kth, "u", "left").select(*part.columns, F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
            found = table(_top(found.unionByName(probed(rest, told.toArrow(), codes, plan, k)), k), "near")
        near = near.unionByName(found)
    enough = near.groupBy("u").count().where(F.col("count") >= min(k, n_rows - 1)).select("u")
    short = table(units.join(enough, "u", "left_anti"), "short")
    n_short = short.count()
    for r in range(parts := ceil(n_short / MEASURED)):
        part = short.where(F.pmod(F.xxhash64("u"), F.lit(parts)) == r).select("u", "embedding", "own")
        found = table(_top(scanned(groups, part.toArrow(), k), k), "scanned")
        near = near.join(part.select("u"), "u", "left_anti").unionByName(found)
    each = near.join(groups.select("no", F.explode("ids").alias("id")), "no").join(query_ids, "u").where(F.col("id.vec_id") != F.col("query_id"))
    each = each.select("query_id", "u", "score", F.col("id.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.least("id.n", F.lit(k)))).alias("copy"))
    best = Window.partitionBy("query_id", "u").orderBy(F.desc("score"), "vec_id")
    drop(rows)
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
