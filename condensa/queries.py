"""Queries over the test tables, one for each operator; most with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa import inputs
from condensa.functions import core, detect, signals
from condensa.operators import bloat, html, lines, ranking, safety, schema_csv, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name; ``sql`` reads them as views with a prefix of their own."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, name: str) -> DataFrame:
        return self.spark.sql(text.replace(f"FROM {name}", "FROM {own}"), own=getattr(self, name))

    def log_lines(self) -> DataFrame:
        return self.sql(inputs.LOG_LINES, "events")

    def hit_lines(self) -> DataFrame:
        return self.sql(inputs.HIT_LINES, "events")

    def diff_lines(self) -> DataFrame:
        return self.sql(inputs.DIFF_LINES, "events")

    def yaml_lines(self) -> DataFrame:
        return self.sql(inputs.YAML_LINES, "part")


def query(oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


BYTES = "octet_length(encode(text))"
TOKENS = f"CAST(ceil({BYTES} / CAST(4.0 AS DOUBLE) * CAST(1.2 AS DOUBLE)) AS BIGINT)"
LINES = "string_split(text, chr(10))"
#: Every other line of a text: what a lossy view may leave.
HALF = f"array_to_string(list_filter({LINES}, lambda x, i: i % 2 = 1), chr(10))"


def _half(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: i % 2 == 0), "\n")


SAMPLE = lambda n: f"list_filter({LINES}[1:{n}], lambda x: regexp_matches(x, '\\S'))"

# ---------------------------------------------------------------- sizes, keys, gates


@query(f"SELECT doc_id, CAST({BYTES} AS INTEGER) AS n_bytes, {TOKENS} AS tokens, {BYTES} >= 512 AS over_gate FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.octet_length("text").alias("n_bytes"), core.token_estimate("text").alias("tokens"), core.over_gate("text").alias("over_gate"))


@query(
    """SELECT doc_id, sha256(text)[1:24] AS stash_key, '<<stash:' || sha256(text)[1:24] || '>>' AS marker,
    regexp_matches(text || '<<stash:' || sha256(text)[1:24] || '>>', '<<stash:[0-9a-fA-F]{24}>>') AS marked,
    regexp_full_match(sha256(text)[1:24 - CAST(doc_id % 2 AS INT)], '[0-9a-fA-F]{24}') AS valid FROM documents"""
)
def stash_keys(t: Tables) -> DataFrame:
    key = core.stash_key("text")
    return t.documents.select(
        "doc_id", key.alias("stash_key"), core.marker(key).alias("marker"), core.has_marker(F.concat("text", core.marker(key))).alias("marked"),
        core.valid_key(F.substring(key, F.lit(1), F.lit(24) - (F.col("doc_id") % 2).cast("int"))).alias("valid"),
    )


@query(
    f"""WITH d AS (SELECT doc_id, {TOKENS} AS before, list_distinct(string_split_regex(text, '\\n\\s*\\n')) AS blocks,
      CAST(ceil(octet_length(encode({HALF} || '<<stash:' || sha256(text)[1:24] || '>>')) / CAST(4.0 AS DOUBLE) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS after FROM documents)
    SELECT doc_id, before, after, after < before AS accepted FROM d"""
)
def acceptance(t: Tables) -> DataFrame:
    shown = F.concat(_half(F.col("text")), core.marker(core.stash_key("text")))
    return t.documents.select("doc_id", core.token_estimate("text").alias("before"), core.token_estimate(shown).alias("after"), core.accepted("text", shown).alias("accepted"))


@query(
    """WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS l FROM documents)
    SELECT doc_id, array_to_string(l[2:4], '') AS text, CAST(2 AS INT) AS start_line, CAST(len(l[2:4]) AS INT) AS line_count, CAST(len(l) AS INT) AS total_lines,
    len(l) > 1 + len(l[2:4]) AS has_more FROM d WHERE len(l) >= 2"""
)
def retrieve_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", core.line_slice("text", 2, 3).alias("s")).where("s is not null").select("doc_id", "s.*")


# ---------------------------------------------------------------- conversations


@query(
    """WITH z AS (SELECT conv_id, coalesce(max(CASE WHEN role = 'system' THEN turn + 1 END), 0) AS floor, max(CASE WHEN role = 'user' THEN turn END) AS ceiling FROM conversations GROUP BY conv_id)
    SELECT * FROM z WHERE ceiling >= floor"""
)
def live_zone(t: Tables) -> DataFrame:
    return safety.live_zone(t.conversations, "conv_id", "turn", "role", F.col("role") == "system")


@query(
    """WITH z AS (SELECT conv_id, coalesce(max(CASE WHEN role = 'system' THEN turn + 1 END), 0) AS floor, max(CASE WHEN role = 'user' THEN turn END) AS ceiling FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, CAST(ceil(octet_length(encode(text)) / CAST(4.0 AS DOUBLE) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS tokens FROM conversations JOIN z USING (conv_id)
    WHERE turn BETWEEN floor AND ceiling AND role = 'assistant' AND octet_length(encode(text)) >= 512"""
)
def live_candidates(t: Tables) -> DataFrame:
    zone = safety.live_zone(t.conversations, "conv_id", "turn", "role", F.col("role") == "system")
    rows = t.conversations.join(zone, "conv_id").where(F.col("turn").between(F.col("floor"), F.col("ceiling")) & (F.col("role") == "assistant") & core.over_gate("text"))
    return rows.select("conv_id", "turn", core.token_estimate("text").alias("tokens"))


@query("SELECT conv_id, coalesce(max(CASE WHEN role = 'system' THEN turn + 1 END), 0) AS frozen FROM conversations GROUP BY conv_id")
def frozen_count(t: Tables) -> DataFrame:
    return safety.frozen_count(t.conversations, "conv_id", "turn", F.col("role") == "system")


@query(
    """SELECT conv_id, turn AS tool_use_index, nxt AS tool_result_index FROM
    (SELECT conv_id, turn, role, lead(role) OVER w AS after, lead(turn) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND after = 'assistant'"""
)
def tool_pairs(t: Tables) -> DataFrame:
    return safety.tool_pairs(t.conversations, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 128 ELSE 32 END AS may_skip, CAST(CASE WHEN turn % 2 = 0 THEN 0.45 ELSE 0.25 END AS DOUBLE) AS max_lossy_ratio,
    round(CAST(len(text) AS DOUBLE) * CAST(0.1 AS DOUBLE), 6) AS read_cost, round(CAST(len(text) AS DOUBLE) * CAST(1.25 AS DOUBLE), 6) AS write_cost FROM conversations"""
)
def plan_policy(t: Tables) -> DataFrame:
    skip, ratio = safety.policy(F.when(F.col("turn") % 2 == 0, "payg").otherwise("subscription"))
    n = F.length("text").cast("double")
    return t.conversations.select("conv_id", "turn", skip.alias("may_skip"), ratio.alias("max_lossy_ratio"), F.round(safety.cache_cost(n, "read"), 6).alias("read_cost"), F.round(safety.cache_cost(n, "write"), 6).alias("write_cost"))


REQUEST_BODY = """CASE conv_id % 5
  WHEN 0 THEN '{"input":[{"type":"message"}]}' WHEN 1 THEN '{"other":1}'
  WHEN 2 THEN '{"messages":[{"role":"user","content":"x"},{"role":"tool","tool_call_id":"a","content":"y"}]}'
  WHEN 3 THEN '{"messages":[{"role":"user","content":"x"}]}' ELSE '{"messages":"none"}' END"""


@query(
    f"""SELECT request_id, CASE WHEN json_extract(body, '$.input') IS NOT NULL THEN 'responses' WHEN json_type(body, '$.messages') IS DISTINCT FROM 'ARRAY' THEN 'unknown'
    WHEN list_bool_or(list_transform(CAST(json_extract(body, '$.messages') AS JSON[]), lambda m: json_extract_string(m, '$.role') = 'tool' OR json_extract(m, '$.tool_calls') IS NOT NULL OR json_extract(m, '$.tool_call_id') IS NOT NULL)) THEN 'chat_completions'
    ELSE 'anthropic' END AS format FROM (SELECT conv_id AS request_id, {REQUEST_BODY} AS body FROM (SELECT DISTINCT conv_id FROM conversations) AS c) AS r"""
)
def request_format(t: Tables) -> DataFrame:
    from condensa.sources.requests import detect_format

    rows = t.conversations.select("conv_id").distinct().withColumn("body", F.expr(REQUEST_BODY))
    return rows.select(F.col("conv_id").alias("request_id"), detect_format(F.col("body")).alias("format"))


# ---------------------------------------------------------------- content types

_HTML = """WITH s AS (SELECT {key}, lower(CASE WHEN octet_length(encode({text})) <= 3000 THEN {text} WHEN octet_length(encode({text}[1:3000])) = 3000 THEN {text}[1:3000]
  ELSE {text}[1:list_max(list_filter(range(750, 3000), lambda n: octet_length(encode({text}[1:n])) <= 3000))] END) AS s FROM {table}),
c AS (SELECT {key}, CAST(regexp_matches(s, '^\\s*<!doctype html') AS INT) AS d, CAST(regexp_matches(s, '<html[ \\t>]') AS INT) AS h, CAST(regexp_matches(s, '<head[ \\t>]') AS INT) AS e,
CAST(regexp_matches(s, '<body[ \\t>]') AS INT) AS b, len(regexp_extract_all(s, '<(?:div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[ \\t>]')) AS n FROM s)"""


@query(
    _HTML.format(key="page_id", text="html", table="pages")
    + " SELECT page_id, round(CASE WHEN d + h > 0 OR n >= 3 THEN least(1.0, 0.5 * d + 0.3 * h + 0.1 * e + 0.1 * b + least(0.3, 0.03 * n)) ELSE 0 END, 6)::DOUBLE AS confidence FROM c"
)
def html_confidence(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.round(detect.html_confidence("html"), 6).alias("confidence"))


_AS_TEXT = "SELECT block, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({lines}) AS l GROUP BY block"


def _as_text(df: DataFrame) -> DataFrame:
    """block, text: the lines of each block put together again."""
    return df.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(
    f"""WITH b AS ({_AS_TEXT.format(lines=inputs.HIT_LINES)}), s AS (SELECT block, {SAMPLE(100)} AS x FROM b)
    SELECT block, round(len(list_filter(x, lambda l: regexp_matches(l, '^[^:\\s]+:\\d+:'))) / CAST(len(x) AS DOUBLE), 6) AS share FROM s"""
)
def search_share(t: Tables) -> DataFrame:
    return _as_text(t.hit_lines()).select("block", F.round(detect.search_share("text"), 6).alias("share"))


_LOG_KIND = """CASE WHEN regexp_matches(l, '(?i)\\b(?:error|fail|failed|fatal|critical)\\b') THEN 0 WHEN regexp_matches(l, '(?i)\\b(?:warn|warning)\\b') THEN 1
WHEN regexp_matches(l, '(?i)\\b(?:info|debug|trace)\\b') THEN 2 WHEN regexp_matches(l, '^\\s*\\d{4}-\\d{2}-\\d{2}') THEN 3 WHEN regexp_matches(l, '^\\s*\\[\\d{2}:\\d{2}:\\d{2}\\]') THEN 4
WHEN regexp_matches(l, '^\\s*(?:={3,}|-{3,})') THEN 5 WHEN regexp_matches(l, '^\\s*(?:PASSED|FAILED|SKIPPED)') THEN 6 WHEN regexp_matches(l, '^\\s*(?:npm ERR!|yarn error|cargo error)') THEN 7
WHEN regexp_matches(l, 'Traceback \\(most recent call last\\)') THEN 8 WHEN regexp_matches(l, '^\\s*at\\s+[\\w.$]+\\(') THEN 9 END"""


@query(
    f"""WITH b AS ({_AS_TEXT.format(lines=inputs.LOG_LINES)}), s AS (SELECT block, {SAMPLE(200)} AS x FROM b),
    k AS (SELECT block, len(x) AS n, list_filter(list_transform(x, lambda l: {_LOG_KIND}), lambda v: v IS NOT NULL) AS v FROM s)
    SELECT block, round(CASE WHEN len(v) / CAST(n AS DOUBLE) >= 0.1 THEN least(1.0, 0.3 + 0.5 * (len(v) / CAST(n AS DOUBLE)) + 0.05 * len(list_filter(v, lambda y: y < 2))) ELSE 0 END, 6) AS confidence FROM k"""
)
def log_confidence(t: Tables) -> DataFrame:
    return _as_text(t.log_lines()).select("block", F.round(detect.log_confidence("text"), 6).alias("confidence"))


@query(
    f"""WITH b AS ({_AS_TEXT.format(lines=inputs.DIFF_LINES)})
    SELECT block, len(list_filter({LINES}[1:500], lambda x: regexp_matches(x, '^(?:diff --git |diff --combined |diff --cc |--- a/|@@\\s+[-+]\\d+,\\d+\\s+[-+]\\d+,\\d+\\s+@@)'))) > 0 AS is_diff FROM b
    UNION ALL SELECT -1 - doc_id, false FROM documents"""
)
def diff_detect(t: Tables) -> DataFrame:
    every = _as_text(t.diff_lines()).unionByName(t.documents.select((-1 - F.col("doc_id")).alias("block"), "text"))
    return every.select("block", detect.is_diff("text").alias("is_diff"))


def _delimited(d: str) -> str:
    """Share of the lines that have the most usual number of a delimiter."""
    return f"""SELECT doc_id, '{d}' AS delimiter, round(CASE WHEN n >= 3 AND c[1] > 0 AND best.c > 0 THEN best.n / CAST(n AS DOUBLE) ELSE 0 END, 6) AS share FROM (
      SELECT doc_id, n, c, list_max(list_transform(list_distinct(c), lambda v: {{'n': len(list_filter(c, lambda y: y = v)), 'c': v}})) AS best FROM (
        SELECT doc_id, len(x) AS n, list_transform(x, lambda l: length(l) - length(replace(l, '{d}', ''))) AS c FROM (SELECT doc_id, {SAMPLE(50)} AS x FROM documents) AS x) AS k) AS m"""


@query(" UNION ALL ".join(map(_delimited, "|,;")))
def delimiter_share(t: Tables) -> DataFrame:
    each = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.round(detect.delimiter_share("text", d), 6).alias("share")) for d in "|,;"])
    return t.documents.select("doc_id", F.explode(each).alias("d")).select("doc_id", "d.*")


@query(
    f"""WITH b AS ({_AS_TEXT.format(lines=inputs.YAML_LINES)}), x AS (SELECT block, list_filter({SAMPLE(200)}, lambda l: NOT regexp_matches(l, '^\\s*[#;]')) AS x FROM b),
    k AS (SELECT block, len(x) AS n, len(list_filter(x, lambda l: regexp_matches(l, '^\\s*[A-Za-z0-9._/-]+\\s*:(?:\\s|$)'))) AS keys FROM x)
    SELECT block, n, keys FROM k"""
)
def config_features(t: Tables) -> DataFrame:
    xs = F.filter(detect.sampled("text", 200), lambda x: ~x.rlike(r"^\s*[#;]"))
    return _as_text(t.yaml_lines()).select("block", F.size(xs).cast("bigint").alias("n"), detect.matching(xs, r"^\s*[A-Za-z0-9._/-]+\s*:(?:\s|$)").cast("bigint").alias("keys"))


_LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "java")
_CODE_TEXT = "array_to_string(list_transform({lines}, lambda x, i: CASE i % 9 WHEN 0 THEN 'def f(' || x WHEN 1 THEN '  const a = ' || x WHEN 2 THEN 'interface A ' || x WHEN 3 THEN 'func (x) ' || x WHEN 4 THEN '#[a] ' || x WHEN 5 THEN 'public class A ' || x ELSE x END), chr(10))"


def _code_hits(lang: str) -> str:
    from condensa.kernels.detect import CODE_LINE

    pattern = CODE_LINE[lang].pattern.replace("'", "''")
    return f"CAST(len(list_filter(string_split(code, chr(10))[1:100], lambda x: regexp_matches(x, '^\\s*(?:{pattern})'))) AS BIGINT) AS {lang}"


@query(f"SELECT doc_id, {', '.join(map(_code_hits, _LANGUAGES))} FROM (SELECT doc_id, {_CODE_TEXT.format(lines=LINES)} AS code FROM documents) AS c")
def code_hits(t: Tables) -> DataFrame:
    """Lines of the documents made to look like those of six languages."""
    starts = {0: "def f(", 1: "  const a = ", 2: "interface A ", 3: "func (x) ", 4: "#[a] ", 5: "public class A "}

    def line(x: Column, i: Column) -> Column:
        out = x
        for k, start in starts.items():
            out = F.when((i + 1) % 9 == k, F.concat(F.lit(start), x)).otherwise(out)
        return out

    docs = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("code"))
    return docs.select("doc_id", *[detect.code_hits("code", lang).cast("bigint").alias(lang) for lang in _LANGUAGES])


@query()
def content_types(t: Tables) -> DataFrame:
    every = (
        t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text").unionByName(t.pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
        .unionByName(_as_text(t.log_lines()).select(F.lit("logs").alias("source"), F.col("block").alias("id"), "text"))
        .unionByName(_as_text(t.hit_lines()).select(F.lit("hits").alias("source"), F.col("block").alias("id"), "text"))
        .unionByName(_as_text(t.diff_lines()).select(F.lit("diffs").alias("source"), F.col("block").alias("id"), "text"))
    )
    return every.select("source", "id", detect.content_type("text").alias("content_type"))


# ---------------------------------------------------------------- statistics


@query(
    """SELECT event_type, count(value) AS n, count(DISTINCT value) AS unique_count, round(count(DISTINCT value) / CAST(count(value) AS DOUBLE), 6) AS unique_ratio, min(value) AS min_val, max(value) AS max_val,
    round(avg(value), 6) AS mean_val, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS stdev, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75
    FROM events GROUP BY event_type"""
)
def field_stats(t: Tables) -> DataFrame:
    s = stats.field_stats(t.events, "event_type", "value")
    return s.select("event_type", "n", "unique_count", "min_val", "max_val", *[F.round(c, 6).alias(c) for c in ("unique_ratio", "mean_val", "variance", "stdev", "p25", "p75")])


@query(
    """WITH c AS (SELECT o_orderstatus, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil(0.8 * sum(n) OVER (PARTITION BY o_orderstatus)) AS top, count(*) OVER (PARTITION BY o_orderstatus) AS kinds FROM c),
    k AS (SELECT *, sum(CAST(top AS INT)) OVER (PARTITION BY o_orderstatus) AS k FROM w)
    SELECT o_orderstatus, value, n FROM k WHERE kinds BETWEEN 2 AND 50 AND k <= 5 AND NOT top"""
)
def rare_values(t: Tables) -> DataFrame:
    return stats.rare_values(t.orders, "o_orderstatus", "o_orderpriority")


@query(
    """WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem JOIN m USING (l_returnflag) WHERE s > 0 AND abs(l_extendedprice - m) > 2 * s"""
)
def sigma_outliers(t: Tables) -> DataFrame:
    return stats.sigma_outliers(t.lineitem, "l_returnflag", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")


@query(
    """WITH s AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
    m AS (SELECT user_id, avg(step) AS m, stddev_samp(step) AS d, count(*) AS n FROM s GROUP BY 1)
    SELECT user_id, event_id, round(step, 6) AS step FROM s JOIN m USING (user_id) WHERE n > 10 AND d > 0 AND abs(step - m) > 2 * d"""
)
def change_points(t: Tables) -> DataFrame:
    return stats.change_points(t.events, "user_id", "event_id", "value").select("user_id", "event_id", F.round("step", 6).alias("step"))


@query(
    """WITH s AS (SELECT user_id, event_id, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS r, row_number() OVER w - 1 AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    m AS (SELECT user_id, stddev_samp(value) AS d, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, event_id FROM s JOIN m USING (user_id) WHERE n > 10 AND p BETWEEN 5 AND n - 6 AND d > 0 AND abs(l - r) > 2 * d"""
)
def window_jumps(t: Tables) -> DataFrame:
    return stats.window_jumps(t.events, "user_id", "event_id", "value").select("user_id", "event_id")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 12")
def top_n(t: Tables) -> DataFrame:
    return stats.top_n(t.orders, "o_orderpriority", "o_totalprice", "o_orderkey", 12).select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query(
    """SELECT doc_id, lang, sha256(substring(text, 1, 50))[1:8] AS cluster FROM
    (SELECT *, row_number() OVER (PARTITION BY lang, substring(text, 1, 50) ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 2"""
)
def cluster_sample(t: Tables) -> DataFrame:
    return stats.cluster_sample(t.documents, "lang", "text", "doc_id").select("doc_id", "lang", "cluster")


@query("SELECT min(event_id) AS event_id, sha256(event_type || '|' || props)[1:16] AS content_hash, count(*) AS copies FROM events GROUP BY event_type, props")
def content_dedup(t: Tables) -> DataFrame:
    rows = t.events.withColumn("one", F.lit(1))
    return stats.first_copies(rows, "one", F.concat_ws("|", "event_type", "props"), "event_id").select("event_id", "content_hash", "copies")


@query("SELECT doc_id, content_hash, copies FROM (SELECT min(doc_id) AS doc_id, sha256(text)[1:16] AS content_hash, count(*) AS copies FROM documents GROUP BY text) WHERE copies > 1")
def document_copies(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("one", F.lit(1))
    return stats.first_copies(rows, "one", F.col("text"), "doc_id").where("copies > 1").select("doc_id", "content_hash", "copies")


@query(
    """WITH c AS (SELECT o_orderstatus, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) AS total, count(*) OVER (PARTITION BY o_orderstatus) AS kinds FROM c)
    SELECT o_orderstatus, value, CAST(n AS VARCHAR) || '/' || CAST(total AS VARCHAR) AS share FROM w WHERE kinds <= 10"""
)
def dropped_histogram(t: Tables) -> DataFrame:
    return stats.histogram(t.orders, "o_orderstatus", "o_orderpriority")


@query(
    """WITH m AS (SELECT source, avg(len(text)) AS m, stddev_samp(len(text)) AS s FROM documents GROUP BY 1)
    SELECT doc_id, source, CAST(len(text) AS INT) AS n_chars FROM documents JOIN m USING (source) WHERE s > 0 AND abs(len(text) - m) > 2 * s"""
)
def length_outliers(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", F.length("text").alias("n_chars"))
    return stats.sigma_outliers(rows, "source", "n_chars")


@query("SELECT doc_id, regexp_matches(lower(text), 'error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected') AS is_error FROM documents")
def error_items(t: Tables) -> DataFrame:
    from condensa.kernels.jsoncrush import ERROR_WORDS

    return t.documents.select("doc_id", F.lower("text").rlike("|".join(ERROR_WORDS)).alias("is_error"))


@query(
    """WITH k AS (SELECT event_type, unnest(CASE WHEN event_id % 11 = 0 THEN ['k', 'odd'] ELSE ['k'] END) AS field FROM events), c AS (SELECT event_type, field, count(*) AS n FROM k GROUP BY ALL),
    r AS (SELECT event_type, count(*) AS rows FROM events GROUP BY 1) SELECT event_type, field, n, rows FROM c JOIN r USING (event_type) WHERE n < 0.2 * rows AND rows >= 5"""
)
def rare_fields(t: Tables) -> DataFrame:
    keys = F.when(F.col("event_id") % 11 == 0, F.array(F.lit("k"), F.lit("odd"))).otherwise(F.array(F.lit("k")))
    return stats.rare_fields(t.events, "event_type", keys)


@query(
    """SELECT event_type, 'a' AS field, count(*) AS n, count(DISTINCT event_id) AS unique_count, 'int' AS type, false AS nullable FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'b', count(*), count(DISTINCT CASE WHEN event_id % 5 > 0 THEN user_id END), CASE WHEN count(*) FILTER (event_id % 5 > 0) > 0 THEN 'string' ELSE 'string' END, count(*) FILTER (event_id % 5 = 0) > 0 FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'c', count(*) FILTER (event_id % 7 > 0), count(DISTINCT CASE WHEN event_id % 7 > 0 THEN event_id % 2 END), CASE WHEN count(DISTINCT CASE WHEN event_id % 7 > 0 THEN event_id % 2 END) = 2 THEN 'json' WHEN max(CASE WHEN event_id % 7 > 0 THEN event_id % 2 END) = 1 THEN 'bool' ELSE 'float' END,
      count(*) FILTER (event_id % 7 = 0) > 0 FROM events GROUP BY 1"""
)
def key_profile(t: Tables) -> DataFrame:
    """Objects with an integer, a string that may be null, and a key that may be missing and holds numbers or booleans."""
    e = F.col("event_id")
    b = F.when(e % 5 > 0, F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))).otherwise("null")
    c = F.when(e % 7 > 0, F.concat(F.lit(',"c":'), F.when(e % 2 == 0, "1.5").otherwise("true"))).otherwise("")
    rows = t.events.select("event_type", F.concat(F.lit('{"a":'), e.cast("string"), F.lit(',"b":'), b, c, F.lit("}")).alias("o"))
    return stats.key_profile(rows, "event_type", "o")


@query(
    """WITH u AS (SELECT count(*) AS rows, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderstatus) AS s, o_custkey % 10 AS g FROM orders GROUP BY g)
    SELECT g, CASE WHEN p >= s THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS field, greatest(p, s) AS kinds FROM u WHERE p BETWEEN 2 AND 8 AND p <= 0.7 * rows"""
)
def discriminator(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("g", F.col("o_custkey") % 10)
    return stats.discriminators(rows, "g", ["o_orderpriority", "o_orderstatus"])


@query(
    """SELECT user_id, n, CAST(k AS BIGINT) AS k, CAST(f AS BIGINT) AS first, CAST(least(greatest(1, floor(k * CAST(0.15 AS DOUBLE) + 0.5)), k - f) AS BIGINT) AS last FROM
    (SELECT user_id, n, k, least(k, greatest(1, floor(k * CAST(0.3 AS DOUBLE) + 0.5))) AS f FROM (SELECT user_id, count(*) AS n, CASE WHEN count(*) <= 8 THEN count(*) ELSE least(greatest(floor(count(*) / 4), 3), 15) END AS k FROM events GROUP BY 1))"""
)
def sample_budget(t: Tables) -> DataFrame:
    k, first, last = stats.ends(F.col("n"))
    rows = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", "n", k.cast("bigint").alias("k"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))


@query(
    """WITH s AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) / CAST(count(*) AS DOUBLE) AS u, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AS e, max(value) > avg(value) + 2 * stddev_samp(value) AS o, min(event_id) % 5 = 0 AS score, max(event_id) % 3 = 0 AS changes, count(*) % 2 = 0 AS message, user_id % 4 > 0 AS low FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN NOT (score OR u < 0.1 OR e OR o) THEN 'skip' WHEN score THEN 'top_n' WHEN changes THEN 'time_series' WHEN message AND low THEN 'cluster' ELSE 'smart_sample' END AS strategy FROM s"""
)
def sampling_strategy(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg(
        (F.count_distinct("event_type") / F.count(F.lit(1))).alias("u"), F.bool_or(F.col("event_type") == "error").alias("e"), (F.max("value") > F.avg("value") + 2 * F.stddev_samp("value")).alias("o"),
        (F.min("event_id") % 5 == 0).alias("score"), (F.max("event_id") % 3 == 0).alias("changes"), (F.count(F.lit(1)) % 2 == 0).alias("message"),
    )
    return s.select("user_id", stats.recommended(F.col("score"), F.col("changes"), F.col("message"), F.col("u") < 0.1, F.col("e"), F.col("o"), F.col("user_id") % 4 > 0).alias("strategy"))


@query(
    """SELECT n_regionkey, '[' || CAST(count(*) AS VARCHAR) || ']{n_name:string,n_nationkey:int}' || chr(10) || string_agg(n_name || ',' || CAST(n_nationkey AS VARCHAR) || chr(10), '' ORDER BY n_nationkey) AS "table" FROM nation GROUP BY 1"""
)
def schema_table(t: Tables) -> DataFrame:
    return schema_csv.render(t.nation, ["n_regionkey"], "n_nationkey", ["n_nationkey", "n_name"])


@query(
    """SELECT doc_id, CASE WHEN octet_length(encode(text)) > 256 AND NOT contains(text, '<<stash:') THEN CASE WHEN NOT regexp_matches(text, '[<>\\s]') AND len(regexp_replace(text, '[^A-Za-z0-9+/=_-]', '', 'g')) / CAST(octet_length(encode(text)) AS DOUBLE) >= 0.95
    THEN 'base64' WHEN len(regexp_extract_all(text, '<[A-Za-z/!]')) >= 3 THEN 'html' ELSE 'string' END END AS kind, CASE WHEN octet_length(encode(text)) < 1024 THEN CAST(octet_length(encode(text)) AS VARCHAR) || 'B' ELSE printf('%.1fKB', octet_length(encode(text)) / CAST(1024.0 AS DOUBLE)) END AS size FROM documents"""
)
def opaque_cells(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", schema_csv.opaque_kind(F.col("text")).alias("kind"), schema_csv.human_size(F.octet_length("text")).alias("size"))


# ---------------------------------------------------------------- text

QUERY_WORDS = ["thnt", "erble", "ander", "idiot"]
_WORD_TOKENS = "regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')"
_BM25 = f"""s AS (SELECT doc_id, i - 1 AS pos, {LINES}[i] AS line FROM documents, unnest(range(1, len({LINES}) + 1)) AS t(i)),
w AS (SELECT doc_id, pos, line, {_WORD_TOKENS} AS w FROM s),
f AS (SELECT doc_id, pos, line, len(w) AS l, list_transform({QUERY_WORDS}, lambda q: len(list_filter(w, lambda x: x = q))) AS tf FROM w),
c AS (SELECT doc_id, count(*) AS n, greatest(avg(l), 1.0) AS m, [{", ".join(f"count(*) FILTER (tf[{i}] > 0)" for i in range(1, 5))}] AS df FROM f GROUP BY 1),
r AS (SELECT doc_id, pos, line, n, list_sum(list_transform([1, 2, 3, 4], lambda i: CASE WHEN tf[i] > 0 THEN ln((n - df[i] + 0.5) / (df[i] + 0.5) + 1) * (tf[i] * 2.2) / (tf[i] + 1.2 * (0.25 + 0.75 * l / m)) ELSE 0 END)) AS raw FROM f JOIN c USING (doc_id)),
b AS (SELECT doc_id, pos, line, n, CASE WHEN max(raw) OVER (PARTITION BY doc_id) > 0 THEN raw / max(raw) OVER (PARTITION BY doc_id) ELSE 0 END AS relevance FROM r)"""


def _text_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@query(f"WITH {_BM25} SELECT doc_id, CAST(pos AS INT) AS pos, CAST(round(relevance, 6) AS DOUBLE) AS relevance FROM b WHERE relevance > 0")
def bm25(t: Tables) -> DataFrame:
    r = ranking.bm25(_text_lines(t), "doc_id", "pos", ranking.tokens(F.col("line")), QUERY_WORDS)
    return r.where("relevance > 0").select("doc_id", "pos", F.round("relevance", 6).alias("relevance"))


@query(
    f"""WITH {_BM25}, x AS (SELECT doc_id, CAST(pos AS INT) AS pos, octet_length(encode(line)) AS nb, round((pos + 1.0) / n + 2.0 * relevance, 9) AS score FROM b),
    y AS (SELECT doc_id, pos, nb, score, coalesce(sum(nb) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < greatest(floor(sum(nb) OVER (PARTITION BY doc_id) * 0.5), 1) AS keep FROM x)
    SELECT doc_id, pos, CAST(nb AS INTEGER) AS nb FROM y WHERE keep"""
)
def extract_select(t: Tables) -> DataFrame:
    rows = _text_lines(t)
    r = ranking.bm25(rows, "doc_id", "pos", ranking.tokens(F.col("line")), QUERY_WORDS)
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    scored = rows.join(r, ["doc_id", "pos"]).join(n, "doc_id").select("doc_id", "pos", F.octet_length("line").alias("nb"), F.round((F.col("pos") + 1.0) / F.col("n") + 2.0 * F.col("relevance"), 9).alias("score"))
    return ranking.select_within(scored, "doc_id", "pos", "score", "nb").select("doc_id", "pos", "nb")


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), f AS (SELECT doc_id, len(w) AS n, list_transform(['thnt', 'erble', 'thnt'], lambda q: len(list_filter(w, lambda x: x = q))) AS tf FROM w)
    SELECT doc_id, CAST(round(list_sum(list_transform(tf, lambda f: CASE WHEN f > 0 THEN ln(CAST(0.5 AS DOUBLE) / 1.5 + 1) * f * 2.2 / (f + 1.2) ELSE 0 END)), 6) AS DOUBLE) AS relevance FROM f"""
)
def relevance_alone(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(ranking.relevance_alone(F.col("text"), "thnt erble thnt"), 6).alias("relevance"))


@query(
    f"""WITH s AS (SELECT doc_id, {_WORD_TOKENS.replace('line', 'text')} AS w FROM documents), h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]') OR list_contains(['assert','error','exception','fail','failed','failure','fixme','todo','traceback','warning'], trim(x, '_')))) AS k FROM s)
    SELECT doc_id, n, CAST(round(k / (n + 1.0), 6) AS DOUBLE) AS salience FROM h"""
)
def salience(t: Tables) -> DataFrame:
    w = ranking.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("n"), F.round(ranking.salience(w), 6).alias("salience"))


@query(
    """WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), x AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM a, unnest(range(1, len(w) - 1)) AS t(i)),
    b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark), y AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 2], ' ') AS s FROM b, unnest(range(1, len(w) - 1)) AS t(i)),
    n AS (SELECT item_id, count(*) AS n FROM y GROUP BY 1)
    SELECT doc_id, item_id, CAST(round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS DOUBLE) AS share FROM x JOIN y USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) / CAST(any_value(n) AS DOUBLE) >= 0.85"""
)
def near_dup_containment(t: Tables) -> DataFrame:
    sh = ranking.shingles(ranking.tokens(F.col("text")))
    got = ranking.containment(t.documents, t.benchmark, "doc_id", "item_id", sh, sh)
    return got.select("doc_id", "item_id", F.round("share", 6).alias("share"))


@query(
    f"""WITH p AS (SELECT doc_id, i - 1 AS pos, {LINES}[i] AS line FROM documents, unnest(range(1, len({LINES}) + 1)) AS t(i)), f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, line) AS first_pos FROM p WHERE trim(line) <> '')
    SELECT doc_id, CAST(pos AS INT) AS pos, CAST(first_pos AS INT) AS first_pos FROM f WHERE pos > first_pos"""
)
def repeated_lines(t: Tables) -> DataFrame:
    return ranking.repeated_blocks(t.documents.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id", "text")


_SECRETS = """list_filter(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND
list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: -(len(x) - len(replace(x, c, ''))) / CAST(len(x) AS DOUBLE) * log2((len(x) - len(replace(x, c, ''))) / CAST(len(x) AS DOUBLE)))) / log2(len(list_distinct(string_split(x, '')))) >= 0.85)"""


@query(f"SELECT doc_id, CAST(len({_SECRETS}) AS INT) AS n_secrets FROM documents")
def entropy_secrets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(core.secret_tokens("text")).alias("n_secrets"))


@query(
    f"""WITH d AS (SELECT doc_id, {_SECRETS} AS own, regexp_extract_all({HALF}, '[A-Za-z0-9+/=_-]{{20,}}') AS seen FROM documents)
    SELECT doc_id, coalesce(list_bool_and(list_transform(own, lambda t: len(list_filter(seen, lambda x: x = t)) >= len(list_filter(own, lambda x: x = t)))), true) AS kept FROM d"""
)
def secrets_preserved(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", core.keeps_secrets("text", _half(F.col("text"))).alias("kept"))


@query(
    """WITH q AS (SELECT conv_id, turn, text || ' see "Order Id" 12345 a@b.org or ' || chr(39) || 'Part ' || turn || chr(39) || ', not "x"' AS q FROM conversations)
    SELECT conv_id, turn, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(q, '[A-Za-z0-9@._-]+'), lambda x: regexp_matches(x, '^[0-9]{4,}$') OR contains(x, '@') OR (contains(x, '.') AND len(x) >= 4))
      || list_filter(list_transform(regexp_extract_all(q, '"[^"]*"|' || chr(39) || '[^' || chr(39) || ']*' || chr(39)), lambda x: x[2:-2]), lambda x: length(trim(x)) >= 2), lambda x: lower(x)))) AS anchors FROM q"""
)
def query_anchors(t: Tables) -> DataFrame:
    turn = F.col("turn").cast("string")
    q = F.concat("text", F.lit(' see "Order Id" 12345 a@b.org or \'Part '), turn, F.lit("', not \"x\""))
    return t.conversations.select("conv_id", "turn", signals.query_anchors(q).alias("anchors"))


# ---------------------------------------------------------------- lines

_LEVEL = """CASE WHEN regexp_matches(line, '\\b(?:CRITICAL|critical|Critical|FATAL|fatal|Fatal|ERROR|error|Error)\\b') THEN 'error' WHEN regexp_matches(line, '\\b(?:FAILED|failed|Failed|FAIL|fail|Fail)\\b') THEN 'fail'
WHEN regexp_matches(line, '\\b(?:WARNING|warning|Warning|WARN|warn|Warn)\\b') THEN 'warn' WHEN regexp_matches(line, '\\b(?:INFO|info|Info)\\b') THEN 'info' WHEN regexp_matches(line, '\\b(?:DEBUG|debug|Debug)\\b') THEN 'debug'
WHEN regexp_matches(line, '\\b(?:TRACE|trace|Trace)\\b') THEN 'trace' ELSE 'unknown' END"""
_KEY = """regexp_extract(line, '^[^:=]*') || regexp_replace(regexp_replace(regexp_replace(substring(line, len(regexp_extract(line, '^[^:=]*')) + 1), '0x[0-9a-fA-F]+', 'ADDR', 'g'), '[0-9]+', 'N', 'g'), '/[A-Za-z0-9_/]*[A-Za-z0-9_][A-Za-z0-9_/]*/', '/PATH/', 'g')"""
_SUMMARY = "regexp_matches(line, '^(?:===|---|\\d+ (?:passed|failed|skipped|error|warning)|(?:Tests?|Suites?)(?: |:)\\s*\\d|TOTAL|Total|Summary|(?:Build|Compile).*(?:succeeded|failed|complete))')"


@query(f"SELECT block, pos, {_LEVEL} AS level, {_SUMMARY} AS summary, regexp_matches(line, '^\\$+\\s+\\S') AS command FROM ({inputs.LOG_LINES}) AS l")
def log_levels(t: Tables) -> DataFrame:
    return lines.classify(t.log_lines()).select("block", "pos", "level", "summary", "command")


_TOOLS = ("npm WARN old lockfile of ", "   Compiling part ", "PASS src/test", "make[1]: Entering ", "=== test session starts ", "nothing said about ")


@query(
    """SELECT CAST(floor(event_id / 40) AS BIGINT) AS block, CASE CAST(floor(event_id / 40) AS BIGINT) % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'cargo' WHEN 2 THEN 'jest' WHEN 3 THEN 'make' WHEN 4 THEN CASE WHEN count(*) FILTER (event_id % 10 = 0) > count(*) FILTER (event_id % 10 <> 0) THEN 'make' ELSE 'pytest' END
    ELSE CASE WHEN count(*) FILTER (event_id % 10 = 0) > 0 THEN 'make' ELSE 'generic' END END AS format FROM events GROUP BY 1"""
)
def log_formats(t: Tables) -> DataFrame:
    """Logs of five tools and of none, each with some lines of a compiler."""
    block = F.floor(F.col("event_id") / 40)
    line = F.when((F.col("event_id") % 10 == 0) & (block % 6).isin(4, 5), "gcc -c a.c").otherwise(F.concat(F.element_at(F.array(*map(F.lit, _TOOLS)), (block % 6 + 1).cast("int")), F.col("event_type")))
    rows = t.events.select(block.cast("bigint").alias("block"), F.col("event_id").alias("pos"), line.alias("line"))
    return _as_text(rows).select("block", signals.log_format(core.lines("text")).alias("format"))


@query(f"SELECT block, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'fail') AS fails, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (level = 'info') AS info, count(*) AS total FROM (SELECT block, {_LEVEL} AS level FROM ({inputs.LOG_LINES}) AS l) GROUP BY 1")
def log_level_counts(t: Tables) -> DataFrame:
    return lines.level_counts(t.log_lines())


@query(f"SELECT block, pos, {_KEY} AS key FROM ({inputs.LOG_LINES}) AS l WHERE {_LEVEL} = 'warn'")
def warning_keys(t: Tables) -> DataFrame:
    return t.log_lines().where(signals.level("line") == "warn").select("block", "pos", signals.dedupe_key("line").alias("key"))


_LOG_SELECT = f"""c AS (SELECT block, pos, line, {_LEVEL} AS level, {_SUMMARY} AS summary, regexp_matches(line, '^\\$+\\s+\\S') AS command, regexp_matches(line, '&&\\s*$') AS more FROM ({inputs.LOG_LINES}) AS l),
s AS (SELECT *, least(1.0, CASE level WHEN 'error' THEN 1.0 WHEN 'fail' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'debug' THEN 0.05 WHEN 'trace' THEN 0.02 ELSE 0.1 END + CASE WHEN summary THEN 0.4 ELSE 0 END) AS score,
  pos = min(pos) OVER (PARTITION BY block) OR command OR coalesce(lag(command AND more) OVER (PARTITION BY block ORDER BY pos), false) AS protected FROM c),
p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY block, level ORDER BY pos) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY block, level ORDER BY pos DESC) = 1 THEN 1 ELSE 2 END AS place,
  level = 'warn' AND row_number() OVER (PARTITION BY block, CASE WHEN level = 'warn' THEN {_KEY} END ORDER BY pos) = 1 AS fresh FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY block, level ORDER BY place, score DESC, pos) AS best, sum(CAST(fresh AS INT)) OVER (PARTITION BY block ORDER BY pos) AS nth FROM p),
g AS (SELECT *, protected OR summary OR (level IN ('error', 'fail') AND best <= 10) OR (fresh AND nth <= 5) AS picked FROM k),
n AS (SELECT *, max(CAST(picked AS INT)) OVER (PARTITION BY block ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) > 0 AND NOT protected AS free FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY block, free ORDER BY score DESC, pos) AS rk FROM n),
z AS (SELECT block, pos, line, protected OR (free AND rk <= 100) AS kept FROM r)"""


@query(f"WITH {_LOG_SELECT} SELECT block, pos FROM z WHERE kept")
def log_select(t: Tables) -> DataFrame:
    return lines.log_select(t.log_lines()).where("kept").select("block", "pos")


@query(
    f"""WITH {_LOG_SELECT}, i AS (SELECT *, sum(CAST(kept AS INT)) OVER (PARTITION BY block ORDER BY pos) AS i FROM z)
    SELECT block, CAST(min(pos) + 1 AS INT) AS start_line, count(*) AS line_count FROM i WHERE NOT kept GROUP BY block, i"""
)
def log_omissions(t: Tables) -> DataFrame:
    return lines.omissions(lines.log_select(t.log_lines()), F.col("kept"))


@query(
    f"""WITH l AS ({inputs.LOG_LINES}), n AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY block ORDER BY pos) = line THEN 0 ELSE 1 END AS f FROM l), r AS (SELECT *, sum(f) OVER (PARTITION BY block ORDER BY pos) AS run FROM n)
    SELECT block, CAST(min(pos) AS INT) AS pos, CASE WHEN count(*) > 1 THEN min(line) || '  [x' || CAST(count(*) AS VARCHAR) || ']' ELSE min(line) END AS line, count(*) AS n FROM r GROUP BY block, run"""
)
def fold_repeats(t: Tables) -> DataFrame:
    return lines.fold_repeats(t.log_lines())


@query(
    f"""SELECT block, pos, category, CAST(CASE category WHEN 'error' THEN 0.95 WHEN 'importance' THEN 0.6 WHEN 'warning' THEN 0.75 WHEN 'markdown' THEN 0.45 ELSE 0 END AS DOUBLE) AS score, regexp_matches(lower(line), 'error|fail|exception|traceback|fatal|panic|crash') AS triage FROM
    (SELECT block, pos, line, CASE WHEN regexp_matches(line, '(?i)\\b(?:error|exception|fail|failed|failure|fatal|crash|panic|abort|timeout|denied|rejected)\\b') THEN 'error' WHEN regexp_matches(line, '(?i)\\b(?:important|note|todo|fixme|hack|xxx|bug|fix)\\b') THEN 'importance'
    WHEN regexp_matches(line, '(?i)\\b(?:warn|warning)\\b') THEN 'warning' WHEN regexp_matches(line, '^(?:#{{1,4}} |\\*\\*|> )') THEN 'markdown' END AS category FROM ({inputs.LOG_LINES}) AS l) AS k"""
)
def keyword_signals(t: Tables) -> DataFrame:
    return t.log_lines().select("block", "pos", signals.keyword_category("line").alias("category"), signals.keyword_score("line").alias("score"), signals.has_indicator("line").alias("triage"))


_HITS = f"""h AS (SELECT block, pos, regexp_extract(line, '^([^\\s:]+):(\\d+):(.*)$', 1) AS file, CAST(regexp_extract(line, '^([^\\s:]+):(\\d+):(.*)$', 2) AS BIGINT) AS line_number, regexp_extract(line, '^([^\\s:]+):(\\d+):(.*)$', 3) AS content
FROM ({inputs.HIT_LINES}) AS l WHERE regexp_matches(line, '^[^\\s:]+:\\d+:')),
q AS (SELECT *, round(least(1.0, CASE WHEN contains(content, 'worker') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(content, '\\berrors?\\b') THEN 0.5 WHEN regexp_matches(content, '\\bdeprecateds?\\b') THEN 0.4 ELSE 0 END), 6) AS score FROM h)"""


@query(f"WITH {_HITS} SELECT block, pos, file, line_number, content, CAST(score AS DOUBLE) AS score FROM q")
def search_scores(t: Tables) -> DataFrame:
    return lines.parse_hits(t.hit_lines()).withColumn("score", lines.hit_score(F.col("content"), "worker"))


@query(
    f"""WITH {_HITS}, f AS (SELECT block, file, round(sum(score), 6) AS fs, count(*) AS n FROM q GROUP BY ALL), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY fs DESC, file) AS fk FROM f) WHERE fk <= 15),
    fk AS (SELECT *, least(30, sum(n) OVER (PARTITION BY block)) AS k FROM fr),
    p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY block, file ORDER BY pos) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY block, file ORDER BY pos DESC) = 1 THEN 1 ELSE 2 END AS place FROM q),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, file, line_number, content ORDER BY place, score DESC, pos) AS cp FROM p) WHERE cp = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY block, file ORDER BY place, score DESC, line_number, pos) AS nth FROM d),
    t AS (SELECT block, file, least(5, count(*)) AS take FROM o GROUP BY ALL),
    a AS (SELECT block, file, greatest(0, least(take, k - coalesce(sum(take) OVER (PARTITION BY block ORDER BY fk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS allowed FROM t JOIN fk USING (block, file))
    SELECT block, pos, file, line_number FROM o JOIN a USING (block, file) WHERE nth <= allowed"""
)
def search_select(t: Tables) -> DataFrame:
    hits = lines.parse_hits(t.hit_lines()).withColumn("score", lines.hit_score(F.col("content"), "worker"))
    return lines.select_hits(hits).select("block", "pos", "file", "line_number")


_DIFF = f"""l AS ({inputs.DIFF_LINES}), a AS (SELECT *, sum(CAST(starts_with(line, 'diff --git ') AS INT)) OVER (PARTITION BY block ORDER BY pos) AS file_no FROM l),
b AS (SELECT *, CASE WHEN file_no > 0 THEN sum(CAST(starts_with(line, '@@ ') AS INT)) OVER (PARTITION BY block, file_no ORDER BY pos) ELSE 0 END AS hunk_no FROM a),
d AS (SELECT *, CASE WHEN file_no = 0 THEN 'prelude' WHEN starts_with(line, '@@ ') THEN 'hunk' WHEN hunk_no = 0 THEN 'header' WHEN line[1] = '+' THEN 'add' WHEN line[1] = '-' THEN 'del' ELSE 'context' END AS kind FROM b)"""


@query(f"WITH {_DIFF} SELECT block, pos, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no, kind FROM d")
def diff_rows(t: Tables) -> DataFrame:
    return lines.diff_rows(t.diff_lines()).select("block", "pos", "file_no", F.col("hunk_no").cast("bigint").alias("hunk_no"), "kind")


@query(
    f"""WITH {_DIFF}, e AS (SELECT *, kind IN ('add', 'del') AS ch, kind IN ('add', 'del', 'context') AS body FROM d),
    f AS (SELECT *, max(CAST(ch AS INT)) OVER (PARTITION BY block, file_no, hunk_no) AS any_ch, max(CAST(ch AS INT)) OVER (PARTITION BY block, file_no, hunk_no ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, row_number() OVER (PARTITION BY block, file_no, hunk_no ORDER BY pos) - 2 AS nth FROM e)
    SELECT block, pos FROM f WHERE NOT body OR CASE WHEN any_ch = 1 THEN near = 1 ELSE nth < 2 END"""
)
def diff_context(t: Tables) -> DataFrame:
    return lines.diff_context(lines.diff_rows(t.diff_lines())).where("kept").select("block", "pos")


@query(
    f"""WITH {_DIFF}, h AS (SELECT block, file_no, hunk_no, count(*) FILTER (kind = 'add') AS additions, count(*) FILTER (kind = 'del') AS deletions, count(*) FILTER (kind = 'context') AS context_lines,
    max(CASE WHEN regexp_matches(line, '\\b(?:error|fix)s?\\b') THEN 1 ELSE 0 END) AS prior, max(CASE WHEN contains(line, 'purchase') THEN 1 ELSE 0 END) AS w FROM d WHERE kind IN ('add', 'del', 'context') GROUP BY ALL)
    SELECT block, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no, additions, deletions, context_lines, CAST(round(least(1.0, least(0.3, 0.03 * (additions + deletions)) + 0.3 * prior + 0.2 * w), 6) AS DOUBLE) AS score FROM h"""
)
def diff_hunks(t: Tables) -> DataFrame:
    return lines.diff_hunks(lines.diff_rows(t.diff_lines()), "purchase").withColumn("hunk_no", F.col("hunk_no").cast("bigint"))


@query(
    f"""WITH {_DIFF}, h AS (SELECT block, file_no, hunk_no, least(0.3, 0.03 * count(*) FILTER (kind IN ('add', 'del'))) + 0.3 * max(CASE WHEN regexp_matches(line, '\\b(?:error|fix)s?\\b') THEN 1 ELSE 0 END) AS score FROM d WHERE kind IN ('add', 'del', 'context') GROUP BY ALL),
    p AS (SELECT *, CASE WHEN hunk_no = min(hunk_no) OVER w OR hunk_no = max(hunk_no) OVER w THEN 0 ELSE 1 END AS place FROM h WINDOW w AS (PARTITION BY block, file_no)),
    r AS (SELECT *, row_number() OVER (PARTITION BY block, file_no ORDER BY place, round(score, 6) DESC, hunk_no) AS nth FROM p)
    SELECT block, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no FROM r WHERE nth <= 2"""
)
def diff_hunk_cap(t: Tables) -> DataFrame:
    hunks = lines.diff_hunks(lines.diff_rows(t.diff_lines()))
    return lines.select_hunks(hunks, 2).select("block", "file_no", F.col("hunk_no").cast("bigint").alias("hunk_no"))


@query(
    f"""WITH {_DIFF}, f AS (SELECT block, file_no, count(*) FILTER (kind IN ('add', 'del')) AS changes FROM d WHERE file_no > 0 AND hunk_no > 0 GROUP BY ALL)
    SELECT block, CAST(file_no AS BIGINT) AS file_no, changes FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY changes DESC, file_no) AS nth FROM f) WHERE nth <= 4"""
)
def diff_file_cap(t: Tables) -> DataFrame:
    return lines.select_files(lines.diff_hunks(lines.diff_rows(t.diff_lines())), 4)


@query(
    f"""WITH {_DIFF}, n AS (SELECT block, file_no, max(CASE WHEN kind = 'header' AND starts_with(line, '+++ ') THEN line END) AS path,
      coalesce(string_agg(CASE WHEN kind = 'add' THEN regexp_replace(line[2:], '\\s', '', 'g') END, chr(1) ORDER BY pos), '') AS a, coalesce(string_agg(CASE WHEN kind = 'del' THEN regexp_replace(line[2:], '\\s', '', 'g') END, chr(1) ORDER BY pos), '') AS d FROM d WHERE file_no > 0 GROUP BY ALL)
    SELECT block, CAST(file_no AS BIGINT) AS file_no, CASE WHEN ends_with(path, '/yarn.lock') THEN 'lockfile' ELSE 'whitespace-only' END AS reason FROM n WHERE ends_with(path, '/yarn.lock') OR (a <> '' AND a = d)"""
)
def diff_noise(t: Tables) -> DataFrame:
    return lines.noise_files(lines.diff_rows(t.diff_lines()))


@query(
    f"""WITH l AS ({inputs.YAML_LINES}), k AS (SELECT *, NOT regexp_matches(line, '^\\s*(?:#|$)') AS kept FROM l), i AS (SELECT *, sum(CAST(kept AS INT)) OVER (PARTITION BY block ORDER BY pos) AS i FROM k)
    SELECT block, CAST(min(pos) + 1 AS INT) AS start_line, count(*) AS line_count FROM i WHERE NOT kept GROUP BY block, i"""
)
def config_elision(t: Tables) -> DataFrame:
    return lines.omissions(lines.elide_config(t.yaml_lines()), F.col("kept"))


@query(f"SELECT block, pos, NOT regexp_matches(line, '^[#;]') AS kept FROM ({inputs.YAML_LINES}) AS l")
def ini_elision(t: Tables) -> DataFrame:
    return lines.elide_config(t.yaml_lines(), ini=True).select("block", "pos", "kept")


# ---------------------------------------------------------------- HTML, bloat


@query(
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(replace(coalesce(nullif(regexp_extract(html, '(?is)<article(?:[/ \\t\\n\\r][^>]*)?>(.*?)</article', 1), ''), nullif(regexp_extract(html, '(?is)<main(?:[/ \\t\\n\\r][^>]*)?>(.*?)</main', 1), ''),
    nullif(regexp_extract(html, '(?is)<body(?:[/ \\t\\n\\r][^>]*)?>(.*?)</body', 1), '')), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', '''')) AS main_hash FROM pages"""
)
def html_main(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(html.decoded(html.main_fragment(F.col("html"))), 256).alias("main_hash"))


@query("SELECT page_id, CAST(round((octet_length(encode(html)) - octet_length(encode(regexp_replace(html, '<[^>]*>', '', 'g')))) / CAST(octet_length(encode(html)) AS DOUBLE), 6) AS DOUBLE) AS density FROM pages")
def html_bloat(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.round(bloat.html(F.col("html")), 6).alias("density"))


@query(
    f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '\\n$', '') AS own FROM documents), x AS (SELECT doc_id, {LINES} AS l, string_split(own, chr(10)) AS o FROM d)
    SELECT doc_id, CAST(CASE WHEN len(l) < 50 THEN 0 ELSE 0.5 END AS DOUBLE) AS log, round(len(list_filter(o, lambda y: regexp_matches(y, '^\\s*(?:#|$)'))) / CAST(len(o) AS DOUBLE), 6) AS config,
    round(len(list_filter(o, lambda y: regexp_matches(y, '^[ \\t]'))) / CAST(len(o) AS DOUBLE), 6) AS code, round(greatest(0, len(list_filter(l, lambda y: regexp_matches(y, '\\S'))) - 1) / CAST(15.0 AS DOUBLE), 6) AS "table" FROM x"""
)
def bloat_estimates(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", bloat.log(c).alias("log"), F.round(bloat.config(c), 6).alias("config"), F.round(bloat.code(c), 6).alias("code"), F.round(bloat.table(c), 6).alias("table"))


@query(
    f"""WITH b AS ({_AS_TEXT.format(lines=inputs.HIT_LINES)}), s AS (SELECT block, list_filter({LINES}, lambda x: regexp_matches(x, '\\S')) AS x FROM b)
    SELECT block, round(len(list_filter(x, lambda l: regexp_matches(l, '^\\s*[^\\s:]+:\\d+:'))) / CAST(len(x) AS DOUBLE), 6) AS search FROM s"""
)
def search_bloat(t: Tables) -> DataFrame:
    return _as_text(t.hit_lines()).select("block", F.round(bloat.search(F.col("text")), 6).alias("search"))


# ---------------------------------------------------------------- whole blocks (kernels)


def _compressed(blocks: DataFrame, key: str) -> DataFrame:
    from condensa.plans.compress import compress_blocks

    r = compress_blocks(blocks)
    return r.select(
        key, F.coalesce("result.status", F.lit("unchanged")).alias("status"), "result.content_type", F.coalesce("result.tokens_before", core.token_estimate("text")).alias("tokens_before"),
        F.coalesce("result.tokens_after", core.token_estimate("text")).alias("tokens_after"), F.col("result.key").alias("stash_key"), F.sha2(F.coalesce("result.text", "text"), 256).alias("output_hash"),
    )


@query()
def compress_documents(t: Tables) -> DataFrame:
    return _compressed(t.documents.select("doc_id", "text", F.lit("thnt erble").alias("query")), "doc_id")


@query()
def compress_pages(t: Tables) -> DataFrame:
    return _compressed(t.pages.select("page_id", F.col("html").alias("text")), "page_id")


@query()
def compress_logs(t: Tables) -> DataFrame:
    return _compressed(_as_text(t.log_lines()), "block")


@query()
def compress_hits(t: Tables) -> DataFrame:
    return _compressed(_as_text(t.hit_lines()).withColumn("query", F.lit("worker")), "block")


@query()
def compress_diffs(t: Tables) -> DataFrame:
    return _compressed(_as_text(t.diff_lines()), "block")


@query()
def compress_configs(t: Tables) -> DataFrame:
    return _compressed(_as_text(t.yaml_lines()), "block")


@query()
def compress_records(t: Tables) -> DataFrame:
    """Orders of a customer as a JSON array."""
    row = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    arrays = t.orders.groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(row)), ","), F.lit("]")).alias("text"))
    return _compressed(arrays, "o_custkey")


@query()
def compress_conversations(t: Tables) -> DataFrame:
    """Requests of a conversation in which the assistant's turns stand for tool output: counters of what was shrunk."""
    from condensa.plans.compress import compress_blocks
    from condensa.sources.requests import candidates

    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    message = F.struct("turn", F.to_json(F.struct(role.alias("role"), F.col("text").alias("content"))).alias("m"))
    bodies = t.conversations.groupBy(F.col("conv_id").alias("request_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]), ",").alias("ms"))
    requests = bodies.select("request_id", F.concat(F.lit('{"model":"m","messages":['), "ms", F.lit("]}")).alias("body"))
    done = compress_blocks(candidates(requests))
    saved = F.when(F.col("result.status").isin("lossless", "lossy"), F.col("result.tokens_before") - F.col("result.tokens_after")).otherwise(0)
    return done.groupBy("request_id").agg(F.count_if(core.over_gate("text")).alias("examined"), F.count_if(F.col("result.status").isin("lossless", "lossy")).alias("compressed"), F.sum(saved).alias("tokens_saved"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: type, tokens before and after, status and key of the stash."""
    return compress_documents(Tables(spark, sf_dir)).drop("output_hash")
