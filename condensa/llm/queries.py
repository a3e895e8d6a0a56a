"""Queries opN_* of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folder of the tokenizer files, where they are not those of the package ``public_tokenizers``; executors read it too.
TOKENIZERS = os.environ.get("CONDENSA_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), output="digest")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.substring import repeated_words

    return repeated_words(table(spark, sf_dir, "documents"), texts=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.unigram import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.secrets import digest_columns, find_secrets, labelled_samples, train

    docs = table(spark, sf_dir, "documents")
    return digest_columns(find_secrets(docs, train(labelled_samples(docs))))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.warc import archive_digests

    return archive_digests(table(spark, sf_dir, "pages"))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.additive import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from condensa.llm.url_tree import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns alone find: the columns of op2 that SQL can say."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of each page, and the verdict where a rule gives it."""
    from pyspark.sql import functions as F

    judged = op9_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in 20 successive words of a benchmark text, by broadcast suffix automata."""
    from pyspark.sql import functions as F

    from condensa.llm.substring import in_reference, union_of

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return union_of(in_reference(docs, items)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("words").cast("long").alias("words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        secret_patterns, url_rules, benchmark_spans,
        op1_toxicity, op2_secrets, op3_warc, op4_simhash, op5_bpe, op6_decontamination, op7_substring_dedup,
        op8_additive_quantisation, op9_url_filter, op10_token_counts,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PART = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "secret_patterns": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        kinds AS (SELECT * FROM (VALUES (0, 'assign', '{_ASSIGN}', 2, 6), (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)) AS v(k, kind, p, part, least)),
        found AS (
            SELECT doc_id, k, kind, least, regexp_split_to_array(t, '{_ASSIGN}') AS gaps, regexp_extract_all(t, '{_ASSIGN}') AS hits, regexp_extract_all(t, '{_ASSIGN}', 2) AS vals FROM d, kinds WHERE k = 0
            UNION ALL SELECT doc_id, k, kind, least, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d, kinds WHERE k = 1
            UNION ALL SELECT doc_id, k, kind, least, string_split_regex(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}') FROM d, kinds WHERE k = 2
        ),
        placed AS (
            SELECT doc_id, k, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(hits[i]) AS n
            FROM found, unnest(range(1, len(hits) + 1)) AS u(i) WHERE length(vals[i]) >= least
        ),
        told AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
            FROM placed GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
        FROM d LEFT JOIN told USING (doc_id)
    """,
    "url_rules": f"""
        WITH u AS (SELECT page_id, translate({_PART.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PART.format(2)} AS path FROM pages),
        rules AS (SELECT * FROM (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')) AS v(verdict, rule, h, p)),
        fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
                FROM u, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN fit USING (page_id)
    """,
    "benchmark_spans": """
        WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        item AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT array_to_string(w[s : s + 19], ' ') AS k FROM item, unnest(range(1, len(w) - 18)) AS t(s)),
        hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM doc, unnest(range(1, len(w) - 18)) AS t(s)) JOIN win USING (k), unnest(range(s, s + 20)) AS c(p)),
        run AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit)
        SELECT doc_id, min(p) - 1 AS "start", count(*) AS words FROM run GROUP BY doc_id, g
    """,
    "op3_warc": """
        SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisit THEN first_id END AS refers_to
        FROM (SELECT *, octet_length(encode(body)) >= 100 AND first_id <> page_id AS revisit
              FROM (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages))
    """,
    "op6_decontamination": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, len(k) AS size, array_to_string(k, ' ') AS k FROM
                (SELECT item_id, w[s : s + 9] AS k FROM item, unnest(range(1, greatest(2, len(w) - 8))) AS t(s) WHERE len(w) > 0)),
        doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        hit AS (SELECT d.doc_id, s, d.size, win.item_id
                FROM (SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS k
                      FROM doc, (SELECT DISTINCT size FROM win) AS z, unnest(range(1, len(w) - size + 2)) AS t(s)) AS d
                JOIN win ON win.k = d.k AND win.size = d.size),
        cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + size)) AS t(p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
        SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op7_substring_dedup": """
        WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id, s) AS rn
                FROM doc, unnest(range(1, len(w) - 18)) AS t(s)),
        gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM win, unnest(range(s, s + 20)) AS t(p) WHERE rn > 1 GROUP BY doc_id),
        kept AS (SELECT doc_id, w, list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS k FROM doc LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
        FROM kept
    """,
}
