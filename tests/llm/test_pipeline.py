"""The pipeline against its steps done plainly on a small corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from ravelin.llm.queries import ORACLES, QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, at = random.Random(11), tmp_path_factory.mktemp("sf")
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    bench = [text(20) for _ in range(4)]
    long = text(2000)
    rows = []
    for i in range(240):
        t = text(rng.randrange(20, 80)) + (" awful nasty vile" if i % 6 == 0 else "")
        rows.append((i, t))
    rows += [(300 + i, rows[1 + 6 * i][1]) for i in range(10)] + [(400, long), (401, long + " end")]
    rows += [(500 + i, f"{text(30)} {b} {text(10)}") for i, b in enumerate(bench)] + [(600, None), (601, "")]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(rows)


def test_stages(spark, corpus):
    at, texts = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = docs.persist()
            seen.append(Counter(r.doc_id for r in docs.collect()))
    clean, single, free, mixed = seen
    assert set(texts) - set(clean) == {i for i in range(0, 240, 6)}
    gone = {300 + i for i in range(10)} | {401, 601}
    assert set(clean) - set(single) == gone and 600 in single
    assert set(single) - set(free) == {500, 501, 502, 503}
    size = {i: len((texts[i] or "").split()) for i in free}
    words = Counter()
    for i, n in mixed.items():
        assert n <= 2
        words[i % 3] += n * size[i]
    total, per = sum(size.values()), {s: sum(v for i, v in size.items() if i % 3 == s) for s in range(3)}
    weight, target, open_ = {0: 3, 1: 1, 2: 2}, {}, {0, 1, 2}
    while True:
        level = (1.5 * total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * per[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * per[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for s in range(3):
        assert abs(words[s] - target[s]) <= max(v for i, v in size.items() if i % 3 == s)


def test_run(spark, corpus):
    from tokenizers import Tokenizer

    at, texts = corpus
    t, place, got = Tokenizer.from_file(tokenizer_path()), 0, corpus_pipeline.run(spark, at).collect()
    assert len(got) > 200
    for r in sorted(got, key=lambda r: r.start):
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)


def test_registry():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES}
    assert set(ORACLES) <= set(QUERIES)
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
