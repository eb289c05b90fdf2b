"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import ann, conversation_trie, decontaminate, language, lexical, line_dedup, mixing, simhash, suffix_dedup, token_counts, token_files, toxicity, warc

#: A file of the installed tokenizers, by name; executors have the same package.
TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.decoded_pages(warc.write(_read(spark, sf_dir, "pages")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_read(spark, sf_dir, "conversations")).drop("node", "parent")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_files": op2_token_files,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_mix_sources": op5_mix_sources,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        first_docs AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
        marked AS (
            SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
            FROM keyed k LEFT JOIN first_docs f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_warc": r"""
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN p.page_id > f.first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id > f.first_page THEN f.first_page END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    "op5_mix_sources": r"""
        WITH sizes AS (
            SELECT doc_id, source, md5('42:' || CAST(doc_id AS VARCHAR)) AS key,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents),
        per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
        weighed AS (
            SELECT source, source_size, 2 * source_size AS cap,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
            FROM per),
        filled AS (
            SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total,
                   CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS filled_cap,
                   CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_weight,
                   row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) AS turn
            FROM weighed),
        level AS (
            SELECT turn AS level_turn, filled_cap AS level_cap, open_weight AS level_weight FROM filled
            WHERE weight * (total - filled_cap) / open_weight <= cap ORDER BY turn LIMIT 1),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN turn < level_turn THEN CAST(cap AS DOUBLE)
                        ELSE weight * (total - level_cap) / level_weight END AS target
            FROM filled, level),
        placed AS (
            SELECT doc_id, source, size,
                   CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM sizes),
        cut AS (
            SELECT p.doc_id, p.size, t.source_size, t.target, p.before, CAST(floor(t.target) AS BIGINT) AS budget,
                   CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
            FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
        FROM cut""",
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        words AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM d),
        tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term),
        sizes AS (SELECT r, count(*) AS n FROM words GROUP BY r),
        whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tfs, whole GROUP BY term, n_docs),
        lengths AS (SELECT r, 50 + (50 * n * n_docs) // n_terms AS m FROM sizes, whole),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        scored AS (
            SELECT a.item_id, t.r, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * l.m))) AS BIGINT) AS score
            FROM asked a JOIN tfs t ON t.term = a.term JOIN weights w ON w.term = a.term JOIN lengths l ON l.r = t.r
            GROUP BY a.item_id, t.r, t.doc_id),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
            FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op12_conversation_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, count(*) AS size,
                   xor(list_reduce(
                       list_transform(range(8 * strlen(CAST(conv_id AS VARCHAR))),
                           lambda i: CAST((ascii(CAST(conv_id AS VARCHAR)[CAST(i // 8 AS BIGINT) + 1]) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT)),
                       lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                       4294967295), 4294967295) % 9 AS h
            FROM t GROUP BY conv_id),
        borrowed AS (
            SELECT c.conv_id, c.h, c.conv_id - c.conv_id % 5 AS lender, least(c.h, coalesce(l.size, 0)) AS taken
            FROM convs c LEFT JOIN convs l ON l.conv_id = c.conv_id - c.conv_id % 5),
        rebuilt AS (
            SELECT b.conv_id, t.pos AS depth, t.role, t.said FROM borrowed b JOIN t ON t.conv_id = b.lender AND t.pos <= b.taken
            UNION ALL
            SELECT b.conv_id, t.pos - b.h + b.taken, t.role, t.said FROM borrowed b JOIN t ON t.conv_id = b.conv_id AND t.pos > b.h),
        whole AS (
            SELECT c.conv_id, coalesce(list({'role': r.role, 'said': r.said} ORDER BY r.depth) FILTER (WHERE r.depth IS NOT NULL), []) AS seq
            FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
        members AS (SELECT conv_id, len(seq) AS length, unnest(range(len(seq) + 1)) AS depth, seq FROM whole),
        nodes AS (
            SELECT depth, seq[1:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '') AS ends
            FROM members GROUP BY depth, seq[1:depth]),
        children AS (SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (
            SELECT n.*, coalesce(c.n, 0) AS n_children,
                   (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE strlen(n.key[n.depth].said) END AS saved
            FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key),
        above AS (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes),
        sums AS (
            SELECT up AS depth, key[1:up] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
            FROM above GROUP BY up, key[1:up])
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
               sha256(n.ends) AS ends_sha256
        FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key
        LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]""",
}
