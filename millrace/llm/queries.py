"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, exact_dedup, language_id, line_dedup, order_minhash, pii_crf, revisits, sentencepiece_codec, suffix_dedup, token_blocks
from millrace.llm.shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.learn(docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.written_and_read(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2)


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records of three crawls (revisits.captures), written, read back and resolved."""
    return revisits.resolve(revisits.written_and_read(revisits.captures(table(spark, sf_dir, "pages")))).select(
        "record_id", "status", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.coalesce(F.col("headers")["etag"], F.lit("")).alias("etag"), F.col("headers")["date"].alias("date"), F.col("headers")["content-type"].alias("content_type"),
        F.coalesce(F.octet_length("content"), F.lit(-1)).cast("bigint").alias("n_bytes"), F.coalesce(F.sha1("content"), F.lit("")).alias("content_sha1"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii_crf": op2_pii_crf,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_blocks": op6_token_blocks,
    "op7_revisits": op7_revisits,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_order_minhash": op10_order_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS line FROM d),
        p AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos, len(regexp_split_to_array(trim(x), '\s+')) >= 4 AS long
            FROM l WHERE trim(x) <> ''
        ),
        w AS (
            SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y,
                row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) > 1 AS again
            FROM p
        ),
        v AS (SELECT *, y IS NOT NULL AND row_number() OVER (PARTITION BY x, y ORDER BY doc_id, pos) > 1 AS pair FROM w),
        g AS (SELECT doc_id, pos, line, x, (long AND again) OR pair OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM v),
        s AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_runs
            FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM g) GROUP BY doc_id
        ),
        k AS (
            SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.line) AS kept
            FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line AND g.gone WHERE g.doc_id IS NULL GROUP BY l.doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE len(ls) END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op7_revisits": r"""
        WITH u AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, regexp_replace(url, '#.*$', '') AS url FROM pages
        ), k AS (
            SELECT page_id, html, d,
                lower(regexp_extract(url, '^[a-z]+://(?:www[.])?([^/?]*)', 1)) || coalesce(nullif(rtrim(regexp_extract(url, '^[a-z]+://[^/?]*([^?]*)', 1), '/'), ''), '/') AS base,
                list_sort(list_filter(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda x: NOT regexp_matches(x, '^((ref|utm_[a-z]+|gclid|fbclid)=.*)?$'))) AS q
            FROM u
        ), r AS (
            SELECT page_id * 3 + n AS record_id, n = 0 OR (n = 1 AND page_id % 2 <> 0) AS full_one, page_id * 3600 + n * 86400 AS ts, d, html,
                base || CASE WHEN len(q) > 0 THEN '?' || list_aggregate(q, 'string_agg', '&') ELSE '' END AS key,
                CASE WHEN page_id % 5 <> 0 THEN '"' || d[1:16] || CASE WHEN page_id % 7 = 0 AND n = 2 THEN '-new' ELSE '' END || '"' END AS etag,
                CASE WHEN page_id % 5 = 0 THEN 'day ' || page_id END AS modified
            FROM k, (SELECT unnest([0, 1, 2]) AS n) WHERE n > 0 OR page_id % 11 <> 0
        ), f AS (SELECT *, ts * 2 AS o FROM r WHERE full_one), v AS (SELECT *, ts * 2 + 1 AS o FROM r WHERE NOT full_one),
        j AS (
            SELECT v.record_id, v.etag, v.ts, f.record_id AS src, f.d AS fd, f.html AS fhtml, f.etag AS fetag,
                coalesce(CASE WHEN v.etag IS NOT NULL THEN v.etag = f.etag ELSE v.modified = f.modified END, false) AS ok
            FROM v ASOF LEFT JOIN f ON v.key = f.key AND v.o > f.o
        )
        SELECT record_id, 'full' AS status, CAST(-1 AS BIGINT) AS source_id, coalesce(etag, '') AS etag, CAST(ts AS VARCHAR) AS date, 'text/html; charset=utf-8' AS content_type,
            CAST(strlen(html) AS BIGINT) AS n_bytes, d AS content_sha1
        FROM f
        UNION ALL
        SELECT record_id, CASE WHEN src IS NULL THEN 'unresolved' WHEN ok THEN 'resolved' ELSE 'mismatch' END, coalesce(CASE WHEN ok THEN src END, -1),
            coalesce(etag, CASE WHEN ok THEN fetag END, ''), CAST(ts AS VARCHAR), CASE WHEN ok THEN 'text/html; charset=utf-8' ELSE 'text/plain' END,
            coalesce(CASE WHEN ok THEN CAST(strlen(fhtml) AS BIGINT) END, -1), coalesce(CASE WHEN ok THEN fd END, '')
        FROM j
    """,
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), g AS (SELECT text_sha256, max(doc_id) AS most, count(*) AS n FROM d GROUP BY text_sha256)
        SELECT doc_id, coalesce(most, doc_id) AS keep_id, n AS group_size, coalesce(doc_id = most, most IS NULL) AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
}
