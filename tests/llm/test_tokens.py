import zlib

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import token_counts, token_files
from ravelin.llm.queries import tokenizer_path
from ravelin.llm.tokens import Encoder

TEXTS = [
    "plain words, and more words. Again\nA new line",
    None,
    "",
    " leading",
    "trailing ",
    "\nline first",
    "line last\n",
    "two  spaces and\n\ntwo lines \n mixed",
    "tab\there\r\nand\x0b\x0c",
    "don't we'll it's.) (x). .,. a,b.c, ... ,",
    "digits 123,456 x2. y²,",
    "<|endoftext|> in text <|endoftext|>",
    "mark \x01 \x01word",
    "é ü ß　漢字, 日本語. 🙂🙂",
    ".",
    ",",
    " ",
    "\n",
    "word " * 3000,
    "x" * 20000,
]


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_encoder_equals_the_library(direct):
    got = []
    for counts, ids in Encoder(tokenizer_path()).encode(pa.array(TEXTS)):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == direct


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001)
    data = token_files.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert (token_files.unpack(data, bits, 1001) == ids).all()


def test_files(spark, direct):
    rows = [(i * 7 % 20, t, "other") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest = token_files.write(docs, tokenizer_path())
    got = token_files.read(manifest).collect()
    by_id = {}
    for i, ids in enumerate(direct):
        by_id.setdefault(i * 7 % 20, []).append(ids)
    place = 0
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
        if r.doc_id is not None and r.doc_id != 3:
            ids = by_id[r.doc_id][0] + [2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(got, key=lambda r: r.start)[-1].doc_id is None


def test_random_access(spark, tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 40_000, 20)
    ids = rng.integers(0, 50257, counts.sum())
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "a")) as out:
        writer = token_files.ShardWriter(out, 50257)
        writer.add(np.arange(20), np.ones(20, bool), counts, ids)
        writer.close()
    shard = token_files.ShardReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "a")))
    for i, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        assert (shard.document(i) == part).all()


def test_histogram(spark, direct):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = token_counts.length_histogram(docs, tokenizer_path()).collect()
    lengths = [len(x) for x in direct]
    assert sorted(r.n_tokens for r in got) == sorted(set(lengths))
    for r in got:
        assert r.n_docs == lengths.count(r.n_tokens)
        assert (r.all_docs, r.all_tokens) == (len(lengths), sum(lengths))
        assert r.docs_within == sum(x <= r.n_tokens for x in lengths)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= r.n_tokens)


def test_limits_and_quantiles(spark, direct):
    """Any limit, between lengths and beyond them, and any share, against brute force."""
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    histogram, lengths = token_counts.length_histogram(docs, tokenizer_path()), sorted(map(len, direct))
    asked = sorted({0, 1, 10**12, *lengths, *(x + 1 for x in lengths)})
    got = token_counts.at_limits(histogram, [None, -5, *asked, asked[-1]]).collect()
    assert [r["limit"] for r in got] == asked
    for r in got:
        short = [x for x in lengths if x <= r["limit"]]
        assert (r.docs_within, r.docs_beyond, r.tokens_within) == (len(short), len(lengths) - len(short), sum(short))
        assert r.truncated_tokens == sum(min(x, r["limit"]) for x in lengths)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.share: r.n_tokens for r in token_counts.quantiles(histogram, [*shares, 1.5, -1]).collect()}
    assert got == {q: next(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths)) for q in shares}
    empty = histogram.limit(0)
    assert token_counts.quantiles(empty, shares).count() == 0
    assert [tuple(r) for r in token_counts.at_limits(empty, [7]).collect()] == [(7, 0, 0, 0, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(docs, tokenizer_path())).count() == 0
    assert token_counts.length_histogram(docs, tokenizer_path()).count() == 0
