"""Stages and operators on clashing names, repeated rows, very long texts, empty tables and broken files."""

import random
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import decontaminate, line_dedup, mixing, near_copies, simhash, suffix_dedup, token_files, toxicity, warc
from ravelin.llm.queries import tokenizer_path
from ravelin.llm.scratch import unused

rng = random.Random(23)
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, copy int, kept_id long, leaked long, leaked_text long, row_key long, total_copies int, component_id long, size long, words int"


def noise(n, of=5000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for i, t, s in rows], CLASHING)


def test_unused(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert unused(df, "a") == "a__" and unused(df, "b") == "b"


def test_stages_keep_clashing_columns(spark):
    rows = [(i, noise(40) + (" awful nasty" if i % 4 == 0 else ""), f"s{i % 3}") for i in range(120)]
    docs, labels = clashing(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, rows[1][1])], "item_id long, text string")
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i in range(120) if i % 4}
    assert all(r.score == 0.5 for r in clean.collect())
    for kept in (simhash.keep_one(docs), near_copies.keep_one(docs), decontaminate.keep_clean(docs, bench, by_text=True), decontaminate.keep_clean(docs, bench), mixing.mixed_rows(docs)):
        assert kept.columns == docs.columns
        assert all(tuple(r)[5:] == (0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for r in kept.collect())


def test_keep_one_of_repeated_rows(spark):
    x, y = noise(50), noise(50)
    for n in (1, 3):
        docs = spark.createDataFrame([(1, x), (5, x), (5, y)], "doc_id long, text string").repartition(n)
        for keep_one in (simhash.keep_one, near_copies.keep_one):
            assert sorted(map(tuple, keep_one(docs).collect())) == [(1, x), (5, y)]
    docs = spark.createDataFrame([(1, x), (1, y), (1, x)], "doc_id long, text string")
    assert sorted(map(tuple, near_copies.keep_one(docs).collect())) == sorted([(1, x), (1, y)])


def test_mix_of_repeated_rows_meets_its_budget(spark):
    rows = [(i // 8, noise(10), "ab"[i % 2]) for i in range(160)] + [(None, noise(10), "a")] * 6 + [(999, "same text here", "b")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    wanted, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        wanted[r.target] += r.taken
    source_of = {"a": None, "b": None}
    per = defaultdict(int)
    for i, t, s in rows:
        per[s] += len(t.split())
    for r in mixing.mixed_rows(docs).collect():
        got[r.source] += len(r.text.split())
    targets = sorted(wanted)
    assert len(targets) == len(source_of)
    for s, words in got.items():
        assert min(abs(words - t) for t in targets) <= 10, (s, words, targets)
    counts = Counter(map(tuple, mixing.mixed_rows(docs).where("doc_id = 999").collect()))
    assert 9 <= counts[999, "same text here", "b"] <= 18


def brute_overlaps(docs, items):
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            if not own:
                continue
            best = None
            for place in range(-len(own) + 1, len(words)):
                agree = [int(0 <= place + j < len(words) and words[place + j] == w) for j, w in enumerate(own)]
                n = min(13, len(own))
                if any(sum(agree[s : s + n]) >= ceil(0.8 * n) for s in range(len(own) - n + 1)):
                    best = max(best or (0, 0), (sum(agree), -place))
            if best:
                yield d, i, -best[1], best[0], len(own)


@pytest.mark.parametrize("vocabulary", [3, 12, 60])
def test_decontamination_against_brute_force(spark, vocabulary):
    items = [(i, noise(n, vocabulary)) for i, n in enumerate((1, 2, 4, 5, 6, 8, 11, 12, 13, 14, 20, 30))] + [(50, None), (51, "")]
    docs = [(i, noise(rng.randrange(1, 70), vocabulary)) for i in range(15)] + [(90, None), (91, "")]
    for k, (_, item) in enumerate(items[:12]):
        words = item.split()
        for j in rng.sample(range(len(words)), min(len(words), k % 4)):
            words[j] = "other"
        docs.append((20 + k, f"{noise(9, vocabulary)} {' '.join(words).upper()} {noise(9, vocabulary)}"))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "item_id", "first_word", "matched", "item_words").collect()) == Counter(brute_overlaps(docs, items))


def test_very_long_texts(spark):
    long = noise(400_000, 10**6)
    rows = [(1, long, "a"), (2, long[:1_000_000] + " " + noise(20), "a"), (3, "short text of a few words only", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert len(set(fps.values())) == 3
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {1, 2, 3}
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (cut[1].n_removed, cut[2].n_removed, cut[3].n_removed) == (1_000_000, 1_000_000, 0) or cut[1].n_removed - 1_000_000 in (1, 2)
    item = " ".join(long.split()[200_000:200_020])
    hits = decontaminate.overlaps(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [(h.doc_id, h.first_word, h.matched) for h in hits] == [(1, 200_000, 20)]
    assert {r.doc_id: r.n_lines for r in line_dedup.dedup_lines(docs).collect()} == {1: 1, 2: 1, 3: 1}
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3
    assert sum(r.n_tokens for r in token_files.read(token_files.write(docs, tokenizer_path())).collect()) > 800_000


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_repeated_ids_and_odd_columns(spark, tmp_path):
    text = [noise(60) for _ in range(40)]
    rows = [(i % 10, t, f"s{i % 2}") for i, t in enumerate(text)] + [(None, noise(60), None), (3, None, "s0"), (4, "", "s1")]
    clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, text[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    counts = Counter(r.doc_id for r in got)
    assert set(counts) <= {None, *range(10)} and sum(counts.values()) >= 40
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()


def test_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    path, n = warc.write(pages).first()
    data = open(path.removeprefix("file://"), "rb").read()
    whole, members = [], data.split(b"\x1f\x8b\x08")[1:]
    for name, cut in (("a", data[:-20]), ("b", data[: -len(members[-1]) - 3]), ("c", data)):
        (tmp_path / name).write_bytes(cut)
        whole.append((f"file://{tmp_path}/{name}", n))
    for (file, _), problem in zip(whole, ("the file ends within a record", "5 of 6 records", None)):
        got = warc.decoded_pages(spark.createDataFrame([(file, n)], "path string, n_records long")).collect()
        assert len(got) == 6 and [r.problem for r in got if r.problem] == ([problem] if problem else [])


def test_revisits_name_records_that_exist(spark):
    html = "<p>equal</p>" * 30
    pages = spark.createDataFrame([(i, "u", html) for i in range(5)] + [(9, "u", "other" * 50)], "page_id long, url string, html string").repartition(3)
    import gzip

    heads = []
    for path, _ in warc.write(pages).collect():
        text = gzip.open(path.removeprefix("file://")).read().decode()
        heads += [dict(x.split(": ", 1) for x in part.split("\r\n\r\n")[0].split("\r\n")[1:] if ": " in x) for part in text.split("WARC/1.1")[1:]]
    names = {h["WARC-Record-ID"] for h in heads}
    assert len(names) == len(heads) and sum("WARC-Refers-To" in h for h in heads) == 4
    assert all(h["WARC-Refers-To"] in names for h in heads if "WARC-Refers-To" in h)


def test_texts_of_one_32_bit_hash_keep_their_own_spans(spark):
    """Without a doc_id rows are told apart by their text alone; a text without a repeat loses nothing."""
    plain = spark.range(200_000).select(F.concat_ws(" ", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256) for i in range(5))).alias("text"))
    pair = plain.groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("t")).where(F.size("t") > 1).orderBy("t").first().t[:2]
    with_repeat, without = pair
    docs = spark.createDataFrame([(None, with_repeat), (None, without), (7, with_repeat[:300]), (None, with_repeat), (None, with_repeat)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    n = len(with_repeat.encode())
    assert got == Counter({(None, n, n, b""): 3, (None, n, 0, without.encode()): 1, (7, 300, 300, b""): 1})


def test_labelled_rows_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(300)] + [(9, "same")] * 300 + [(i, "x") for i in range(400)], "doc_id long, text string")
    for most in (1, 50, 120, 100_000):
        texts = toxicity.labelled_texts(docs, labels, most)
        again = toxicity.labelled_texts(docs, labels, most)
        assert texts.count() <= most and sorted(texts.collect()) == sorted(again.collect())
    assert texts.count() > 300 and toxicity.labelled_texts(docs, labels, 120).count() == 120
