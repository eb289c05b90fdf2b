"""What a review found cut short: each test fails on the code before it."""

import random
from collections import Counter
from itertools import combinations
from math import ceil

import numpy as np

import corpus_pipeline
from ravelin.llm import decontaminate, near_copies, simhash, toxicity


def test_masks_find_short_items():
    for n in range(1, 13):
        for k in range(n - ceil(n * decontaminate.LEAST) + 1):
            for other in combinations(range(n), k):
                masks = [decontaminate.ALL_MASKS[m] for m in decontaminate.masks_of(n)]
                assert any(all(s + o < n and s + o not in other for o in m) for m in masks for s in range(n)), (n, other)


def test_short_items_overlap(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(1, 13)]
    docs, want = [], set()
    for n, t in items:
        allowed = n - ceil(n * decontaminate.LEAST)
        for k in range(allowed + 2):
            for other in combinations(range(n), k):
                words = ["x" if j in other else w for j, w in enumerate(t.split())]
                if k <= allowed:
                    want.add((len(docs), n))
                docs.append((len(docs), f"a b {' '.join(words)} c d {t.split()[0] if n == 1 and not other else 'e'}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.first_word == 2 for r in got)


def test_filters_tell_rows_apart(spark):
    t = lambda s: " ".join(f"{s}{j}" for j in range(40))
    rows = [(1, t("leak")), (1, t("clean")), (None, t("leak")), (None, t("other")), (2, t("fine")), (2, t("fine"))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, t("leak"))], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, bench, by_text=True).collect()
    assert Counter(map(tuple, kept)) == Counter(rows) - Counter([(1, t("leak")), (None, t("leak"))])
    for keep_one in (simhash.keep_one, near_copies.keep_one):
        one = keep_one(docs).collect()
        assert {tuple(r) for r in one} == set(rows) - {(None, t("leak"))} and len(one) == 4


def test_stage_takes_near_copies(spark):
    """Copies of 200 texts at 0.8 to 1 all go and texts below 0.8 all stay."""
    r, rows, near, far = random.Random(3), [], set(), set()
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(200):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(100, 800))]
        other = list(words)
        for j in r.sample(range(len(words)), max(1, int(len(words) * r.uniform(0, 0.04)))):
            other[j] = "changed"
        rows += [(i, " ".join(words), "s"), (1000 + i, " ".join(other), "s")]
        (near if jaccard(grams(words), grams(other)) >= 0.8 else far).add(1000 + i)
    rows += [(2000, None, "s"), (2001, "", "s")]
    kept = {d.doc_id for d in corpus_pipeline.near_copies_out(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()}
    assert len(near) > 80 and len(far) > 20
    assert not near & kept and far <= kept and set(range(200)) <= kept and 2000 in kept and 2001 not in kept


def test_large_buckets_give_few_pairs():
    base, r = np.arange(64, dtype=np.uint32), np.random.default_rng(2)
    signs = np.where(r.random((2000, 64)) < 0.02, r.integers(100, 10**6, (2000, 64)), base).astype(np.uint32)
    for n in (40, 300, 2000):
        pairs = near_copies.bucket_pairs(np.arange(n), signs[:n])
        assert len(pairs) == n - 1 and set(pairs.ravel().tolist()) == set(range(n))
    two = np.array([0] * 1990 + [5] * 4 + [7] * 6)
    every = [near_copies.cross_pairs(np.arange(2000), signs, two, band) for band in range(near_copies.BANDS)]
    crossing, joined = np.concatenate(every), 1990 * 10 + 24
    assert len(np.unique(crossing, axis=0)) == len(crossing)
    agree = (signs[crossing[:, 0]] == signs[crossing[:, 1]]).reshape(-1, near_copies.BANDS, near_copies.ROWS).all(axis=2)
    assert agree.any(axis=1).all() and joined * 0.99 < len(crossing) <= joined


def test_one_bucket_over_many_batches():
    """A bucket that fills whole batches, alone and with others after it."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    bucket = np.array([16] * 100 + [32] * 3 + [48])
    signs = [x.tobytes() for x in r.integers(0, 2**32, (104, 64)).astype(np.uint32)]
    rows = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.arange(104)), pa.array(signs, pa.binary())], ["bucket", "set_hash", "signature"])
    for size in (7, 50, 104):
        got = list(near_copies._by_bucket(rows.slice(at, size) for at in range(0, 104, size)))
        assert [(int(b[0][0]), len(b[0])) for b in got] == [(16, 100), (32, 3)] and np.concatenate([b[1] for b in got]).tolist() == list(range(103))
        assert list(near_copies._by_bucket(rows.slice(0, 100).slice(at, size) for at in range(0, 100, size)))[0][1].tolist() == list(range(100))


def test_forest_and_cross_pairs_link_what_all_pairs_link(spark):
    """A group whose copies are near some others only: components as from all pairs."""
    r = random.Random(4)
    base = [f"w{r.randrange(9000)}" for _ in range(90)]
    texts = []
    for i in range(150):
        words = list(base)
        for j in r.sample(range(90), 1 + i % 3):
            words[j] = f"x{r.randrange(9000)}"
        texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    label = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                least, other = sorted((label[i], label[j]))
                label = [least if x == other else x for x in label]
    got = near_copies.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {g.doc_id: g.component_id for g in got} == dict(enumerate(label)) and len(set(label)) > 1


def test_sketches_decide_small_sets_and_estimate_large_ones():
    r = np.random.default_rng(5)
    for n, spread in ((100, 0.0), (5000, near_copies.MARGIN)):
        base = r.permutation(np.unique(r.integers(0, 2**63, n).astype(np.uint64)))
        sets = [np.unique(np.concatenate([base[: int(n * keep)], r.integers(0, 2**63, n - int(n * keep)).astype(np.uint64)])) for keep in (0.5, 0.7, 0.89, 0.95, 1)]
        for one in sets:
            true = [len(np.intersect1d(one, x)) / len(np.union1d(one, x)) for x in sets]
            got = near_copies.shares(one[: near_copies.SKETCH], [x[: near_copies.SKETCH] for x in sets])
            assert (np.abs(got - true) <= spread).all()


def test_links_between_components_are_whole_whatever_the_blocks(spark, monkeypatch):
    """Small and large sets, buckets in several blocks and parts: components as from all pairs, no block over its bound, each pair met once."""
    r = random.Random(6)
    texts = []
    for size, n in ((60, 120), (700, 40)):
        base = [f"w{r.randrange(9000)}" for _ in range(size)]
        for i in range(n):
            words = list(base)
            for j in r.sample(range(size), size // 60 * (1 + i % 4)):
                words[j] = f"x{r.randrange(9000)}"
            texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                least, other = sorted((label[i], label[j]))
                label = [least if x == other else x for x in label]
    assert 10 < len(set(label)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for hot, block in ((8192, 512), (20, 7)):
        monkeypatch.setattr(near_copies, "HOT", hot)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        got = near_copies.near_groups(docs).collect()
        assert {g.doc_id: g.component_id for g in got} == dict(enumerate(label))
    rows = [(b, i, i % 3 if i % 2 else 1) for b in (1, 2) for i in range(40)] + [(3, i, 0) for i in range(20)]
    dealt = near_copies.blocks(spark.createDataFrame(rows, "bucket long, set_hash long, root long")).collect()
    met = []
    for part in {d.part for d in dealt}:
        mine = [d for d in dealt if d.part == part]
        assert len({d.set_hash for d in mine}) == len(mine) and len({d.bucket for d in mine}) == 1
        met += [(d.bucket, *sorted((d.set_hash, e.set_hash))) for d in mine if d.left for e in mine if e.right and d.root != e.root and not (d.right and e.left and d.set_hash > e.set_hash)]
    true = [(b, i, j) for b, i, x in rows for c, j, y in rows if b == c and i < j and x != y]
    assert sorted(met) == sorted(true)


def test_shouting_is_a_third_of_the_whole_text():
    for n in (512, 700, 1000, 1023, 1024, 5000):
        for share in (0.18, 0.25, 0.32, 0.34, 0.5):
            k = int(n * share)
            for capital in "AÜ":
                for t in (capital * k + "a" * (n - k), "a" * (n - k) + capital * k):
                    assert toxicity.patterns(t, 50, 50)[0] == (sum(map(str.isupper, t)) * 3 > n), (n, share)
