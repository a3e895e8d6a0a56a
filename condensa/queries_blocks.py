"""Queries over blocks of text made from the test tables, through the kernels and the request and stash pipelines.

The oracle says in SQL, from the tables themselves, what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condensa import inputs
from condensa.functions import core
from condensa.operators import bloat, lines, ranking
from condensa.plans.compress import spread
from condensa.queries import _DIFF, _LOG_SELECT, _SECRETS, LINES, Tables, _as_text, query

NL = "chr(10)"


def each(f: Callable, schema: str, *columns: Column) -> Column:
    """What ``f`` makes of the values of each row, in Arrow batches; a struct if ``schema`` names fields."""
    kind = T._parse_datatype_string(schema)
    names = [x.name for x in kind.fields] if isinstance(kind, T.StructType) else None

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f(*r) for r in zip(*(batch if isinstance(batch, tuple) else (batch,)), strict=True)]
            yield pd.DataFrame(rows, columns=names) if names else pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame] if names else Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(*columns)


def text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def joined(df: DataFrame, by: Column, order: str, item: Column, sep: str) -> DataFrame:
    """block and body: the items of each block in order."""
    rows = df.groupBy(by.cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("block", "n", F.array_join(F.transform("x", lambda x: x["item"]), sep).alias("body"))


# ---------------------------------------------------------------- tags


@query(
    """SELECT event_id, CASE k WHEN 0 THEN 'a {{CMPR_TAG_0}} z' WHEN 1 THEN 'a <b>' || event_type || '</b> <portal>p</portal> z' WHEN 2 THEN 'a {{CMPR_TAG_0}} {{CMPR_TAG_1}} z'
      WHEN 3 THEN 'a </gone> {{CMPR_TAG_0}} ' || event_type WHEN 4 THEN '{{CMPR_TAG_ {{CMPR_TAG_0_0}}' WHEN 5 THEN 'a <w1>' || event_type || ' {{CMPR_TAG_0}}' WHEN 6 THEN '{{CMPR_TAG_0}}{{CMPR_TAG_1}} 1 < 2 > 0'
      ELSE '{{CMPR_TAG_0}} {{CMPR_TAG_1}}' END AS protected,
    CASE k WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 3 THEN 5 WHEN 5 THEN 3 ELSE 4 END AS seen, CASE k WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS html, CASE WHEN k IN (0, 4, 5) THEN 1 WHEN k IN (3, 6, 7) THEN 2 ELSE 0 END AS blocks,
    CASE k WHEN 2 THEN 2 ELSE 0 END AS self_closing, CASE k WHEN 3 THEN 1 ELSE 0 END AS orphans, k = 4 AS collision, true AS restored
    FROM (SELECT event_id, event_type, event_id % 8 AS k FROM events)"""
)
def tag_protect(t: Tables) -> DataFrame:
    from condensa.kernels import tags

    def run(x: str) -> tuple:
        p = tags.protect(x)
        return p.text, p.tags_seen, p.html_skipped, p.blocks, p.self_closing, p.orphan_closes, p.collision, tags.restore(p.text, p.wraps) == x

    kind, k = F.col("event_type"), F.col("event_id") % 8
    made = (
        F.when(k == 0, text('a <note k="x>y">in <b>', kind, "</b></note> z")).when(k == 1, text("a <b>", kind, "</b> <portal>p</portal> z")).when(k == 2, text("a <cite-x/> <q1 a=1/> z"))
        .when(k == 3, text("a </gone> <n1>x <n2>y</n2></n1> ", kind)).when(k == 4, text("{{CMPR_TAG_ <w1>", kind, "</w1>")).when(k == 5, text("a <w1>", kind, " <w2>x</w2>"))
        .when(k == 6, text("<w1>x</w1><w1>", kind, "</w1> 1 < 2 > 0")).otherwise(text("<font>x</font> <FOO>", kind, "</FOO>"))
    )
    out = "protected string, seen int, html int, blocks int, self_closing int, orphans int, collision boolean, restored boolean"
    return spread(t.events).select("event_id", each(run, out, made).alias("p")).select("event_id", "p.*")


@query(
    """SELECT event_id, 'x {{CMPR_TAG_0}} <keep>y</keep> ' || event_type AS some, '<b>a</b> {{CMPR_TAG_0}}' || event_type || '{{CMPR_TAG_1}}' AS marks, 'x  <keep>y</keep> ' || event_type AS lost FROM events"""
)
def tag_options(t: Tables) -> DataFrame:
    """Only some names; the tags without what is between; and a text that lost its placeholder."""
    from condensa.kernels import tags

    def run(a: str, b: str) -> tuple:
        some = tags.protect(a, only=frozenset(["take"]))
        return some.text, tags.protect(b, markers_only=True).text, tags.restore(some.text.replace("{{CMPR_TAG_0}}", ""), some.wraps)

    a, b = text("x <take>z</take> <keep>y</keep> ", F.col("event_type")), text("<b>a</b> <w1 q='1'>", F.col("event_type"), "</w1>")
    return spread(t.events).select("event_id", each(run, "some string, marks string, lost string", a, b).alias("p")).select("event_id", "p.*")


# ---------------------------------------------------------------- JSON


_PART_JSON = "'{\"key\":' || p_partkey || ',\"name\":\"' || p_name || '\",\"tags\":[\"' || p_brand || '\",' || p_size || ',null,true],\"in\":{\"type\":\"' || p_type || '\"}}'"


@query(f"SELECT p_partkey, CAST(json({_PART_JSON}) AS VARCHAR) AS minified, CAST(json_type(CAST({_PART_JSON} AS JSON)) AS VARCHAR) = 'OBJECT' AS found FROM part")
def json_minify(t: Tables) -> DataFrame:
    from condensa.kernels.detect import json_payload
    from condensa.kernels.jsoncrush import minified

    c = F.col
    pretty = text('{\n  "key" : ', c("p_partkey"), ',\n  "name": "', c("p_name"), '",\n  "tags": [ "', c("p_brand"), '", ', c("p_size"), ', null, true ],\n  "in": {"type": "', c("p_type"), '"}\n}\n')
    got = each(lambda x: (minified(x), isinstance(json_payload(x)[0], dict)), "minified string, found boolean", pretty)
    return spread(t.part).select("p_partkey", got.alias("m")).select("p_partkey", "m.*")


_RECORDS = """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS block, '[' || CAST(count(*) AS VARCHAR) || ']{brand:string,key:int,name:string,price:float,small:bool}' || chr(10) ||
  string_agg(p_brand || ',' || p_partkey || ',' || CASE WHEN p_partkey % 7 = 0 THEN '"' || p_name || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) ELSE p_name END || ',' || p_size || '.5,' || CASE WHEN p_size < 20 THEN 'true' ELSE 'false' END || chr(10), '' ORDER BY p_partkey) AS "table"
  FROM part GROUP BY 1"""


def _records(t: Tables) -> DataFrame:
    """block, n, text: arrays of 20 uniform records."""
    c = F.col
    name = F.when(c("p_partkey") % 7 == 0, text(c("p_name"), ', \\"x\\"')).otherwise(c("p_name"))
    row = text('{"key":', c("p_partkey"), ',"name":"', name, '","brand":"', c("p_brand"), '","price":', c("p_size"), '.5,"small":', F.when(c("p_size") < 20, "true").otherwise("false"), "}")
    return joined(t.part, F.floor(c("p_partkey") / 20), "p_partkey", row, ",").select("block", "n", text("[", c("body"), "]").alias("text"))


@query(f"WITH r AS ({_RECORDS}) SELECT block, \"table\", true AS same_shape FROM r")
def json_tables(t: Tables) -> DataFrame:
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    got = each(lambda x: (jsoncrush.reformat_json(x), jsoncrush.same_shape(loads(x))), "table string, same_shape boolean", F.col("text"))
    return _records(t).select("block", got.alias("m")).select("block", "m.*")


@query(
    f"""WITH r AS ({_RECORDS}) SELECT block, 'lossless' AS status, 'json_array' AS content_type, 'rows of ' || block || ': ' || "table" AS output FROM r"""
)
def compressed_records(t: Tables) -> DataFrame:
    """Text around an array of records, through the whole pipeline: the lossless form is taken."""
    from condensa.plans.compress import compress_blocks

    c = F.col
    blocks = _records(t).select("block", text("rows of ", c("block"), ": ", c("text")).alias("text"))
    return compress_blocks(blocks).select("block", "result.status", "result.content_type", c("result.text").alias("output"))


@query(
    """WITH r AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS block, p_partkey % 3 AS k, p_partkey, p_name, p_size, p_brand FROM part),
    g AS (SELECT block, k, '__key:kind' || k || chr(10) || CASE WHEN count(*) < 2 THEN '[1]{value:json}' || chr(10) ELSE '[' || count(*) || ']{' || CASE k WHEN 0 THEN 'a0:int,a1:string,a2:int,kind:string' WHEN 1 THEN 'b0:int,b1:string,b2:int,kind:string' ELSE 'c0:int,c1:string,c2:int,kind:string' END || '}' || chr(10) END
      || string_agg(p_partkey || ',' || p_name || ',' || p_size || ',kind' || k || chr(10), '' ORDER BY p_partkey) AS part FROM r GROUP BY block, k)
    SELECT block, '__buckets:kind' || chr(10) || string_agg(part, '' ORDER BY k) AS buckets, 'kind' AS discriminator FROM g GROUP BY block"""
)
def json_buckets(t: Tables) -> DataFrame:
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    c = F.col
    k = c("p_partkey") % 3
    letter = F.when(k == 0, "a").when(k == 1, "b").otherwise("c")
    row = text('{"kind":"kind', k, '","', letter, '0":', c("p_partkey"), ',"', letter, '1":"', c("p_name"), '","', letter, '2":', c("p_size"), "}")
    blocks = joined(t.part, F.floor(c("p_partkey") / 20), "p_partkey", row, ",")
    got = each(lambda x: (jsoncrush.Tables().buckets(loads(x)), jsoncrush.discriminator(loads(x))), "buckets string, discriminator string", text("[", c("body"), "]"))
    return blocks.select("block", got.alias("m")).select("block", "m.*")


@query(
    """WITH i AS (SELECT l_orderkey, count(*) AS n, string_agg('[' || l_linenumber || ',' || l_partkey || ',"' || l_returnflag || '"]', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows FROM lineitem GROUP BY 1)
    SELECT l_orderkey, '"' || replace('{"_compaction":"table","_schema":[{"name":"flag","type":"string"},{"name":"line","type":"int"},{"name":"part","type":"int"}],"_kept":' || n || ',"_total":' || n || ',"_rows":[' ||
    list_aggregate(list_transform(string_split(substring(rows, 2, length(rows) - 2), '],['), lambda r: '[' || string_split(r, ',')[3] || ',' || string_split(r, ',')[1] || ',' || string_split(r, ',')[2] || ']'), 'string_agg', ',') || ']}', '"', '""') || '"' AS cell FROM i WHERE n >= 2"""
)
def nested_tables(t: Tables) -> DataFrame:
    """Lines of an order, as a cell that holds a list of objects."""
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    c = F.col
    item = text('{"part":', c("l_partkey"), ',"line":', c("l_linenumber"), ',"flag":"', c("l_returnflag"), '"}')
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("item")))).alias("x")).where(F.size("x") >= 2)
    whole = text("[", F.array_join(F.transform("x", lambda x: x["item"]), ","), "]")
    return rows.select("l_orderkey", each(lambda x: jsoncrush.Tables().cell(loads(x)), "string", whole).alias("cell"))


_ORDER_ROWS = "SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS block, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_custkey FROM orders"


def _order_arrays(t: Tables) -> DataFrame:
    """block, n, text: arrays of 40 orders; some have a message, and a priority that is missing."""
    c = F.col
    row = text(
        '{"id":', c("o_orderkey"), ',"status":"', c("o_orderstatus"), '","total":', c("o_totalprice"), ',"conf":0.', c("o_custkey") % 90 + 10, ',"level":',
        F.when(c("o_orderkey") % 11 == 0, "null").otherwise(text('"', c("o_orderpriority"), '"')), F.when(c("o_orderkey") % 40 == 7, ',"note":"stage failed"').otherwise(""), "}",
    )
    return joined(t.orders, F.floor(c("o_orderkey") / 40), "o_orderkey", row, ",").select("block", "n", text("[", c("body"), "]").alias("text"))


@query(
    f"""WITH r AS ({_ORDER_ROWS}), f AS (
      SELECT block, 'total' AS field, 'numeric' AS kind, count(*) AS count, count(DISTINCT o_totalprice) AS unique_count, min(o_totalprice) AS low, max(o_totalprice) AS high, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS stdev FROM r GROUP BY 1
      UNION ALL SELECT block, 'status', 'string', count(*), count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL FROM r GROUP BY 1
      UNION ALL SELECT block, 'level', CASE WHEN count(*) FILTER (o_orderkey % 11 = 0) > count(*) FILTER (o_orderkey % 11 <> 0) THEN 'null' ELSE 'string' END, count(*), count(DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE o_orderpriority END), NULL, NULL, NULL, NULL FROM r GROUP BY 1)
    SELECT block, field, kind, count, unique_count, round(unique_count / CAST(count AS DOUBLE), 6) AS ratio, low, high, round(mean, 4) AS mean, round(stdev, 4) AS stdev FROM f"""
)
def array_fields(t: Tables) -> DataFrame:
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    def run(x: str) -> list:
        return [(s.name, s.kind, s.count, s.unique, s.ratio, s.low, s.high, s.mean, s.stdev) for s in jsoncrush.field_stats(loads(x)).values()]

    out = "array<struct<field:string,kind:string,count:bigint,unique_count:bigint,ratio:double,low:double,high:double,mean:double,stdev:double>>"
    rows = _order_arrays(t).select("block", F.explode(each(run, out, F.col("text"))).alias("f")).select("block", "f.*").where(F.col("field").isin("total", "status", "level"))
    return rows.withColumns({"ratio": F.round("ratio", 6), "mean": F.round("mean", 4), "stdev": F.round("stdev", 4)})


@query(
    f"""WITH r AS ({_ORDER_ROWS}), k AS (SELECT block, count(*) AS n, count(DISTINCT o_orderpriority) FILTER (o_orderkey % 11 <> 0) AS levels FROM r GROUP BY 1),
    v AS (SELECT block, CASE WHEN o_orderkey % 11 = 0 THEN '__none__' ELSE o_orderpriority END AS value, count(*) AS c FROM r GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY block ORDER BY c DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil(0.8 * n) AS top FROM v JOIN k USING (block)),
    l AS (SELECT *, sum(CAST(top AS INT)) OVER (PARTITION BY block) AS tops FROM w),
    s AS (SELECT block, o_orderstatus AS value, count(*) AS c FROM r GROUP BY ALL),
    y AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY block ORDER BY c DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil(0.8 * n) AS top, count(*) OVER (PARTITION BY block) AS kinds FROM s JOIN k USING (block)),
    odd AS (SELECT r.block, o_orderkey FROM r JOIN l ON l.block = r.block AND l.value = CASE WHEN o_orderkey % 11 = 0 THEN '__none__' ELSE o_orderpriority END WHERE NOT top AND tops <= 5 AND levels BETWEEN 2 AND 50
      UNION SELECT r.block, o_orderkey FROM r JOIN y ON y.block = r.block AND y.value = o_orderstatus WHERE NOT top AND kinds BETWEEN 2 AND 50
      UNION SELECT r.block, o_orderkey FROM r JOIN k USING (block) WHERE n >= 5 AND o_orderkey % 40 = 7 AND 1 < 0.2 * n)
    SELECT block, o_orderkey, o_orderkey % 40 = 7 AS error FROM odd"""
)
def array_outliers(t: Tables) -> DataFrame:
    """Rows of an array that have a rare field or a rare value; nulls are values too."""
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    def run(x: str) -> list:
        rows = loads(x)
        bad = jsoncrush.error_rows(rows)
        plain = [{k: v for k, v in r.items() if k not in ("total", "conf", "id")} for r in rows]
        return [(int(rows[i]["id"]), i in bad) for i in sorted(jsoncrush.structural_rows(plain))]

    return _order_arrays(t).select("block", F.explode(each(run, "array<struct<o_orderkey:bigint,error:boolean>>", F.col("text"))).alias("f")).select("block", "f.*")


@query(
    f"""WITH r AS ({_ORDER_ROWS}), k AS (SELECT block, max(o_totalprice) - min(o_totalprice) AS total, count(DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END) AS levels, count(DISTINCT o_orderstatus) AS states, count(*) AS n,
      (max(o_custkey % 90) - min(o_custkey % 90)) > 0 AS spread, count(*) FILTER (o_orderkey % 40 = 7) AS bad FROM r GROUP BY 1)
    SELECT block, 'object' AS class, CASE WHEN spread THEN 'conf' END AS score_field FROM k"""
)
def array_roles(t: Tables) -> DataFrame:
    """Class of an array and its score field: a number between 0 and 1, as no name says so."""
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    got = each(lambda x: (jsoncrush.classify(loads(x)), jsoncrush.score_field(jsoncrush.field_stats(loads(x)))), "class string, score_field string", F.col("text"))
    return _order_arrays(t).select("block", got.alias("m")).select("block", "m.*")


@query(
    f"""WITH r AS ({_ORDER_ROWS}), k AS (SELECT block, o_orderkey, o_orderkey % 40 = 7 AS hit FROM r) SELECT block, count(*) AS n, count(*) AS accounted, count(*) FILTER (hit) AS errors, count(*) FILTER (hit) AS errors_kept, true AS within FROM k GROUP BY 1"""
)
def crushed_arrays(t: Tables) -> DataFrame:
    """Sampled arrays: rows kept and dropped add up, no error is dropped, and the rest keeps to the budget."""
    from condensa.kernels import jsoncrush
    from condensa.kernels.base import loads

    def run(x: str) -> tuple:
        rows = loads(x)
        out = jsoncrush.crushed(rows)
        note = out[-1] if out and "_crushed" in out[-1] else None
        kept = out[:-1] if note else out
        dropped = int(note["_dropped_count"]) if note else 0
        bad = {int(rows[i]["id"]) for i in jsoncrush.error_rows(rows)}
        within = not note or (int(note["_original_count"]) == len(rows) and len(note["_dropped_sample"]) == min(3, dropped))
        return len(rows), len(kept) + dropped, len(bad), len(bad & {int(r["id"]) for r in kept}), within

    got = each(run, "n bigint, accounted bigint, errors bigint, errors_kept bigint, within boolean", F.col("text"))
    return _order_arrays(t).select("block", got.alias("m")).select("block", "m.*")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    b AS (SELECT *, CASE WHEN n <= 8 THEN n ELSE least(greatest(floor(n / 4), 3), 15) END AS k FROM e),
    s AS (SELECT *, least(k, greatest(1, floor(k * 0.3 + 0.5))) AS f, greatest(1, floor(k * 0.15 + 0.5)) AS l FROM b)
    SELECT user_id, count(*) FILTER (event_type = 'error' OR i < f OR i >= n - least(l, k - f) OR n <= 8) AS sure FROM s GROUP BY 1"""
)
def string_samples(t: Tables) -> DataFrame:
    """Of an array of strings: errors, the front and the back are all among what is kept."""
    from condensa.kernels import jsoncrush

    def run(xs) -> int:
        kept = set(jsoncrush.crush_strings(list(xs))[0])
        n = len(xs)
        _, first, last = jsoncrush.ends(n)
        must = set(range(n)) if n <= 8 else {i for i, x in enumerate(xs) if "error" in x} | set(range(first)) | set(range(n - last, n))
        return len(must & kept)

    rows = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return rows.select("user_id", each(run, "bigint", F.transform("x", lambda x: text(x["event_type"], " ", x["event_id"]))).alias("sure"))


# ---------------------------------------------------------------- tables


@query(
    """WITH p AS (SELECT p_partkey, CAST(floor(p_partkey / 25) AS BIGINT) AS block, p_name, p_brand, p_size FROM part), n AS (SELECT block, count(*) AS rows FROM p GROUP BY 1)
    SELECT block, CASE block % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'csv' WHEN 2 THEN 'tsv' END AS kind, p_partkey, CASE WHEN block % 4 = 1 THEN p_name || ', "' || p_size || '"' ELSE p_name END AS name, p_brand AS brand FROM p JOIN n USING (block) WHERE block % 4 <> 3 AND rows >= 3"""
)
def table_cells(t: Tables) -> DataFrame:
    """Markdown, comma and tab tables, parsed; those with a ragged row give nothing."""
    from condensa.kernels import tables
    from condensa.kernels.base import Skip

    def run(x: str) -> list:
        try:
            return [(int(r["key"]), r["name"], r["brand"]) for r in tables.parse_table(x)]
        except Skip:
            return []

    c = F.col
    block = F.floor(c("p_partkey") / 25)
    row = (
        F.when(block % 4 == 0, text("| ", c("p_partkey"), " | ", c("p_name"), " |  ", c("p_brand"), " |")).when(block % 4 == 2, text(c("p_partkey"), "\t", c("p_name"), "\t", c("p_brand")))
        .when((block % 4 == 3) & (c("p_partkey") % 25 == 2), text(c("p_partkey"), ",", c("p_name"))).when(block % 4 == 3, text(c("p_partkey"), ",", c("p_name"), ",", c("p_brand")))
        .otherwise(text(c("p_partkey"), ',"', c("p_name"), ', ""', c("p_size"), '""",', c("p_brand")))
    )
    blocks = joined(t.part, block, "p_partkey", row, "\n").where("n >= 3")
    k = c("block") % 4
    head = F.when(k == 0, "| key | name | brand |\n| --- | :--- | --- |\n").when(k == 2, "key\tname\tbrand\n").otherwise("key,name,brand\n")
    got = blocks.select("block", F.when(k == 0, "markdown").when(k == 1, "csv").when(k == 2, "tsv").alias("kind"), F.explode(each(run, "array<struct<p_partkey:bigint,name:string,brand:string>>", text(head, c("body")))).alias("r"))
    return got.select("block", "kind", "r.*")


@query(
    """WITH p AS (SELECT *, CAST(floor(p_partkey / 25) AS BIGINT) AS block FROM part)
    SELECT block, '[' || count(*) || ']{brand:string,key:string,name:string}' || chr(10) || string_agg(p_brand || ',' || p_partkey || ',' || p_name || chr(10), '' ORDER BY p_partkey) AS "table" FROM p GROUP BY 1 HAVING count(*) >= 5"""
)
def shrunk_tables(t: Tables) -> DataFrame:
    """Wide Markdown tables as schema-first tables of strings."""
    from condensa.kernels import tables
    from condensa.kernels.base import Context

    c = F.col
    row = text("| ", c("p_partkey"), "       | ", c("p_name"), "             | ", c("p_brand"), "        |")
    blocks = joined(t.part, F.floor(c("p_partkey") / 25), "p_partkey", row, "\n").where("n >= 5")
    return blocks.select("block", each(lambda x: tables.shrink_table(x, Context()).text, "string", text("| key | name | brand |\n| --- | --- | --- |\n", c("body"))).alias("table"))


# ---------------------------------------------------------------- logs, hits, diffs


@query(
    """WITH l AS (SELECT CAST(floor(event_id / 50) AS BIGINT) AS block, event_id % 50 AS pos, event_id, user_id FROM events), g AS (SELECT *, CASE WHEN pos BETWEEN 1 AND 29 THEN 1 WHEN pos BETWEEN 31 AND 49 THEN 2 END AS g FROM l),
    w AS (SELECT block, g, count(*) AS n, string_agg(CASE WHEN g = 1 THEN event_id || ' r' || event_id || '.1' ELSE 'page' || event_id END, chr(10) ORDER BY pos) AS body FROM g WHERE g IS NOT NULL GROUP BY ALL)
    SELECT a.block, '$ make all' || chr(10) || '[Template T1: building part <*> release <*> done] (' || a.n || ' occurrences)' || chr(10) || a.body || chr(10) || chr(10) || '[Template T2: info: <*> of the handbook] (' || b.n || ' occurrences)' || chr(10) || b.body AS text
    FROM w a JOIN w b ON a.block = b.block AND a.g = 1 AND b.g = 2"""
)
def log_templates(t: Tables) -> DataFrame:
    from condensa.kernels.loglines import templates

    c = F.col
    pos = c("event_id") % 50
    line = F.when(pos == 0, "$ make all").when(pos < 30, text("building part ", c("event_id"), " release r", c("event_id"), ".1 done")).when(pos == 30, "").otherwise(text("info: page", c("event_id"), " of the handbook"))
    return joined(t.events, F.floor(c("event_id") / 50), "event_id", line, "\n").select("block", each(templates, "string", c("body")).alias("text"))


@query(
    """WITH l AS (SELECT CAST(floor(event_id / 40) AS BIGINT) AS block, event_id % 40 AS pos FROM events)
    SELECT block, CAST(pos AS BIGINT) AS pos, CASE WHEN pos BETWEEN 5 AND 9 THEN 'python' WHEN pos BETWEEN 15 AND 18 THEN 'java' WHEN pos BETWEEN 25 AND 29 THEN 'go' END AS trace FROM l WHERE pos BETWEEN 5 AND 9 OR pos BETWEEN 15 AND 18 OR pos BETWEEN 25 AND 29"""
)
def trace_lines(t: Tables) -> DataFrame:
    """Lines of stack traces of three flavours within a log."""
    from condensa.kernels.loglines import trace_lines as found

    c = F.col
    pos = c("event_id") % 40
    fixed = {5: "Traceback (most recent call last):", 7: "    x()", 9: "ValueError: x", 15: "  at a.B.c(B.java:1)", 16: "Caused by: y", 17: "  at a.B.d(B.java:2)", 18: "  ... 3 more", 25: "panic: boom", 26: "", 27: "goroutine 1 [running]:", 28: "main.f(0x1)", 29: "\t/a.go:1 +0x1"}
    line = F.when(pos.isin(6, 8), text('  File "a.py", line ', c("event_id")))
    for k, x in fixed.items():
        line = line.when(pos == k, x)
    blocks = joined(t.events, F.floor(c("event_id") / 40), "event_id", line.otherwise(text("info: step ", c("event_id"))), "\n")
    got = blocks.select("block", F.explode(each(lambda x: [i for i, hit in enumerate(found(x.split("\n"))) if hit], "array<bigint>", c("body"))).alias("pos"))
    return got.withColumn("trace", F.when(c("pos") < 10, "python").when(c("pos") < 20, "java").otherwise("go"))


@query(
    """WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, CASE WHEN n <= 5 THEN 0 ELSE n - 5 END AS collapsed, CASE WHEN n <= 5 THEN string_agg('  at app.F.f' || event_id || '(F.java:1)', chr(10) ORDER BY i)
      ELSE string_agg(CASE WHEN i <= 5 THEN '  at app.F.f' || event_id || '(F.java:1)' END, chr(10) ORDER BY i) || chr(10) || '      [... ' || (n - 5) || ' frames collapsed]' END AS kept, n FROM l GROUP BY user_id, n"""
)
def collapsed_frames(t: Tables) -> DataFrame:
    """Frames of an application's trace: the first ones stay, the rest becomes one line."""
    from condensa.kernels.loglines import Line, collapse

    def run(xs) -> tuple:
        kept, gone = collapse([Line(i, x, trace=True) for i, x in enumerate(xs)])
        return "\n".join(x.text for x in kept), len(gone)

    rows = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("x"))
    frames = F.transform("x", lambda i: text("  at app.F.f", i, "(F.java:1)"))
    return rows.select("user_id", F.size("x").cast("bigint").alias("n"), each(run, "kept string, collapsed bigint", frames).alias("m")).select("user_id", "n", "m.*")


@query(
    f"""WITH {_LOG_SELECT}, i AS (SELECT *, sum(CAST(kept AS INT)) OVER (PARTITION BY block ORDER BY pos) AS i FROM z), o AS (SELECT block, min(pos) + 1 AS s, count(*) AS n FROM i WHERE NOT kept GROUP BY block, i)
    SELECT block, '[... ' || n || ' lines omitted from file "stash:/' || block || '", starting at line ' || s || ']' || chr(10) AS hint FROM o"""
)
def omission_hints(t: Tables) -> DataFrame:
    gaps = lines.omissions(lines.log_select(t.log_lines()), F.col("kept"))
    return gaps.select("block", lines.omission_hint(text("stash:/", F.col("block")), F.col("start_line"), F.col("line_count")).alias("hint"))


@query(
    f"""WITH h AS (SELECT block, regexp_extract(line, '^([^\\s:]+):', 1) AS file, regexp_matches(line, '^[^\\s:]+:\\d+:') AS hit FROM ({inputs.HIT_LINES}) AS l)
    SELECT block, count(*) FILTER (hit) AS matches, count(DISTINCT CASE WHEN hit THEN file END) AS files, count(*) FILTER (NOT hit) AS unparsed, count(*) AS scanned, count(*) FILTER (hit) AS accounted FROM h GROUP BY 1"""
)
def search_counters(t: Tables) -> DataFrame:
    from condensa.kernels.base import Context
    from condensa.kernels.searchhits import shrink_search

    def run(x: str) -> tuple:
        i = shrink_search(x, Context("worker")).info
        return i["matches"], i["files"], i["unparsed"], i["scanned"], i["kept"] + i["matches_dropped_in_files"] + i["matches_dropped_with_files"]

    got = each(run, "matches bigint, files bigint, unparsed bigint, scanned bigint, accounted bigint", F.col("text"))
    return _as_text(t.hit_lines()).select("block", got.alias("m")).select("block", "m.*")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'src/' || event_type || '.py' WHEN 1 THEN 'C:\\src\\' || event_type || '.py' WHEN 2 THEN 'src/a-b_' || event_type || '.py' WHEN 3 THEN 'my dir/' || event_type || '.py' END AS file,
    CASE WHEN event_id % 5 < 4 THEN user_id END AS line, CASE WHEN event_id % 5 < 4 THEN 'x: y - ' || event_id END AS content FROM events"""
)
def hit_forms(t: Tables) -> DataFrame:
    """Lines of search tools: with colons, Windows drives, context dashes and spaces in the path; and none."""
    from condensa.kernels.searchhits import parse_hit

    c = F.col
    rest = text(c("user_id"), ":x: y - ", c("event_id"))
    k = c("event_id") % 5
    line = (
        F.when(k == 0, text("src/", c("event_type"), ".py:", rest)).when(k == 1, text("C:\\src\\", c("event_type"), ".py:", rest)).when(k == 2, text("src/a-b_", c("event_type"), ".py-", c("user_id"), "-x: y - ", c("event_id")))
        .when(k == 3, text("my dir/", c("event_type"), ".py:", rest)).otherwise(text("no match of ", c("event_type")))
    )
    got = each(lambda x: parse_hit(x) or (None, None, None), "file string, line bigint, content string", line)
    return spread(t.events).select("event_id", got.alias("m")).select("event_id", "m.*")


@query(
    f"""WITH l AS ({inputs.DIFF_LINES}) SELECT block, count(*) FILTER (starts_with(line, 'diff --git ')) AS files, count(*) FILTER (starts_with(line, '@@ ')) AS hunks, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++ ')) AS additions,
    count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '--- ')) AS deletions, count(*) FILTER (starts_with(line, ' ')) AS context FROM l GROUP BY 1"""
)
def diff_counters(t: Tables) -> DataFrame:
    from condensa.kernels.diffs import reduced

    def run(x: str) -> tuple:
        i = reduced(x)[2]
        return tuple(i[k] for k in ("files", "hunks", "additions", "deletions", "context"))

    got = each(run, "files bigint, hunks bigint, additions bigint, deletions bigint, context bigint", F.col("text"))
    return _as_text(t.diff_lines()).select("block", got.alias("m")).select("block", "m.*")


# ---------------------------------------------------------------- text, pages, configuration, code


@query(
    f"""WITH l AS (SELECT doc_id, unnest({LINES}) AS line FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\\s', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS s FROM l),
    n AS (SELECT doc_id, CAST(sum(len(s)) AS BIGINT) AS n, max(list_max(list_transform(s, lambda x: length(x)))) AS longest FROM s GROUP BY 1)
    SELECT doc_id, n, CAST(longest AS BIGINT) AS longest FROM n"""
)
def text_segments(t: Tables) -> DataFrame:
    s = ranking.segments(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("bigint").alias("longest"))


@query(
    f"""WITH s AS (SELECT doc_id, i - 1 AS pos, len({LINES}) AS n, {LINES}[i] AS line FROM documents, unnest(range(1, len({LINES}) + 1)) AS t(i)),
    w AS (SELECT *, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+') AS w FROM s),
    h AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]') OR list_contains(['assert','error','exception','fail','failed','failure','fixme','todo','traceback','warning'], trim(x, '_')))) / (len(w) + 1.0) AS salient FROM w)
    SELECT doc_id, CAST(pos AS INT) AS pos, CAST(round((1.0 * (pos + 1.0) / n + 1.5 * salient) * CASE WHEN octet_length(encode(line)) < 12 THEN 0.25 ELSE 1 END, 6) AS DOUBLE) AS score FROM h"""
)
def segment_scores(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    score = ranking.segment_score(F.col("pos"), F.col("n"), F.lit(0.0), ranking.salience(ranking.tokens(F.col("line"))), F.octet_length("line"))
    return rows.select("doc_id", "pos", F.round(score, 6).alias("score"))


@query(
    f"""WITH s AS (SELECT doc_id, i - 1 AS pos, {LINES}[i] AS text FROM documents, unnest(range(1, len({LINES}) + 1)) AS t(i))
    SELECT doc_id, CAST(pos AS INT) AS pos, CAST(len({_SECRETS}) AS INT) AS n FROM s WHERE len({_SECRETS}) > 0"""
)
def pinned_segments(t: Tables) -> DataFrame:
    """Lines that extraction never leaves out, as they hold high-entropy tokens."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.size(core.secret_tokens("line")).alias("n")).where("n > 0")


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def report_words(t: Tables) -> DataFrame:
    from condensa.kernels.prose import count_words

    return spread(t.documents).select("doc_id", each(count_words, "bigint", F.col("text")).alias("words"))


@query(
    """SELECT p_partkey, '# ' || p_brand || chr(10) || chr(10) || 'Made of ' || p_name || '.' || chr(10) || chr(10) || 'Second ' || p_type || '.' || chr(10) || chr(10) || '# Again' || chr(10) || chr(10) || 'Made of ' || p_name || '.' || chr(10) || chr(10) || 'todo: ' || p_size || chr(10) || chr(10) || 'todo: ' || p_size || chr(10) AS text,
    7 AS kept, 8 AS total FROM part"""
)
def folded_blocks(t: Tables) -> DataFrame:
    """The conservative mode: a paragraph that repeats within a section goes, decisions and other sections stay."""
    from condensa.kernels.prose import fold_blocks

    def run(x: str) -> tuple:
        s = fold_blocks(x)
        return s.text, s.kept, s.total

    c = F.col
    made, todo = text("Made of ", c("p_name"), ".\n\n"), text("todo: ", c("p_size"), "\n")
    whole = text("# ", c("p_brand"), "\n\n", made, "Second ", c("p_type"), ".\n\n", made, "# Again\n\n", made, todo, "\n", todo)
    return spread(t.part).select("p_partkey", each(run, "text string, kept int, total int", whole).alias("m")).select("p_partkey", "m.*")


@query(
    """SELECT p_partkey, '# ' || p_name || ' & x' || chr(10) || chr(10) || 'a **' || p_brand || '** [l](u' || p_partkey || ')' || chr(10) || chr(10) || '- ' || p_type || chr(10) || '- `two`' || chr(10) || chr(10) || '```' || chr(10) || 'c' || chr(10) || ' d' || chr(10) || '```' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| s | ' || p_size || ' |' AS markdown, true AS smaller FROM part"""
)
def html_markdown(t: Tables) -> DataFrame:
    from condensa.kernels.base import Context
    from condensa.kernels.html_md import shrink_html

    c = F.col
    page = text(
        "<html><head><title>t</title></head><body><nav>no</nav><article class='x>y'><h1>", c("p_name"), " &amp; x</h1><script>var a = '<b>';</script><p>a <b>", c("p_brand"), "</b> <a href='u", c("p_partkey"),
        "'>l</a></p><ul><li>", c("p_type"), "</li><li><code>two</code></li></ul><pre>c\n d</pre><table><tr><th>k</th><th>v</th></tr><tr><td>s</td><td>", c("p_size"), "</td></tr></table></article><footer>no</footer></body></html>",
    )

    def run(x: str) -> tuple:
        made = shrink_html(x, Context()).text
        return made, len(made) < len(x)

    return spread(t.part).select("p_partkey", each(run, "markdown string, smaller boolean", page).alias("m")).select("p_partkey", "m.*")


_CONFIG_TEXT = "string_agg('# part ' || p_partkey || ' is of ' || p_type || ', size ' || p_size || chr(10) || 'part_' || p_partkey || ':' || chr(10) || '  name: ' || p_name || chr(10) || '  brand: ' || replace(p_brand, '#', '') || chr(10) || chr(10), '' ORDER BY p_partkey)"


@query(
    f"""WITH b AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS block, {_CONFIG_TEXT} AS text, string_agg('part_' || p_partkey || ':' || chr(10) || '  name: ' || p_name || chr(10) || '  brand: ' || replace(p_brand, '#', '') || chr(10), '' ORDER BY p_partkey) AS kept, count(*) AS n FROM part GROUP BY 1)
    SELECT block, 'lossy' AS status, 'structured_config' AS content_type, kept || '[' || 2 * n || ' comment/blank lines elided]<<stash:' || sha256(text)[1:24] || '>>' AS output, text AS retrieved FROM b"""
)
def published_configs(t: Tables) -> DataFrame:
    """Configuration through the whole pipeline: shrunk, stored, published with a marker, and found again by its key."""
    from condensa.plans.compress import compress_blocks, publish
    from condensa.plans.scratch import fresh
    from condensa.sources.stash import Stash

    c = F.col
    item = text("# part ", c("p_partkey"), " is of ", c("p_type"), ", size ", c("p_size"), "\npart_", c("p_partkey"), ":\n  name: ", c("p_name"), "\n  brand: ", F.replace("p_brand", F.lit("#"), F.lit("")), "\n\n")
    stash = Stash(t.spark, fresh(t.spark))
    done = publish(compress_blocks(joined(t.part, F.floor(c("p_partkey") / 20), "p_partkey", item, "").select("block", c("body").alias("text"))), stash)
    return stash.get(done.withColumnRenamed("stash_key", "key")).select("block", "status", "content_type", "output", c("content").alias("retrieved"))


@query(
    """WITH p AS (SELECT p_partkey, 30 + p_size % 20 AS n FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'def f' || p_partkey || '(a):' || chr(10) || list_aggregate(list_transform(range(0, 5), lambda i: '    x' || i || ' = a + ' || i || chr(10)), 'string_agg', '') || '    # ... ' || (n - 5 + 1) || ' lines omitted' || chr(10)
      ELSE 'function f' || p_partkey || '(a) {' || chr(10) || list_aggregate(list_transform(range(0, 5), lambda i: '  const x' || i || ' = a + ' || i || ';' || chr(10)), 'string_agg', '') || '  // ... ' || (n - 5 + 1) || ' lines omitted' || chr(10) || '}' || chr(10) END AS text,
    CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'javascript' END AS language, 1 AS folded FROM p"""
)
def folded_code(t: Tables) -> DataFrame:
    from condensa.kernels.code import fold

    def run(x: str, path: str) -> tuple:
        got = fold(x, path)
        return got.text, got.info["language"], got.info["bodies_folded"]

    c = F.col
    even = c("p_partkey") % 2 == 0
    body = F.transform(F.sequence(F.lit(0), 29 + c("p_size") % 20), lambda i: F.when(even, text("    x", i, " = a + ", i, "\n")).otherwise(text("  const x", i, " = a + ", i, ";\n")))
    whole = F.when(even, text("def f", c("p_partkey"), "(a):\n", F.array_join(body, ""), "    return x1\n")).otherwise(text("function f", c("p_partkey"), "(a) {\n", F.array_join(body, ""), "  return x1;\n}\n"))
    path = F.when(even, "src/A.PY").otherwise("src/a.js")
    return spread(t.part).select("p_partkey", each(run, "text string, language string, folded int", whole, path).alias("m")).select("p_partkey", "m.*")


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' WHEN 3 THEN 'java' WHEN 4 THEN 'c' ELSE 'javascript' END AS language, p_partkey % 12 < 6 AS balanced FROM part"""
)
def code_languages(t: Tables) -> DataFrame:
    """Language of a source without a path, and whether its brackets and strings are closed."""
    from condensa.kernels.code import balanced, language

    c = F.col
    k, n = c("p_partkey") % 6, c("p_size")
    whole = (
        F.when(k == 0, text("def f(a):\n    return (a + ", n, ")\n")).when(k == 1, text("fn main() {\n    let x = ", n, ";\n}\n")).when(k == 2, text("package main\n\nfunc main() {\n\tx := ", n, "\n}\n"))
        .when(k == 3, text("public class A {\n    int x = ", n, ";\n}\n")).when(k == 4, text("#include <a.h>\nint main() { return ", n, "; }\n")).otherwise(text("const x = { a: ", n, " };\n"))
    )
    broken = F.when(c("p_partkey") % 12 >= 6, F.translate(whole, "})", "")).otherwise(whole)

    def run(x: str) -> tuple:
        lang = language(x)
        return lang, balanced(x, lang)

    return spread(t.part).select("p_partkey", each(run, "language string, balanced boolean", broken).alias("m")).select("p_partkey", "m.*")


# ---------------------------------------------------------------- mixed blocks, types


@query(
    """SELECT p_partkey, s.pos, s.kind, s.first, s.last FROM part, (VALUES (0, 'plain_text', 0, 0), (1, 'json_array', 1, 4), (2, 'plain_text', 5, 5)) AS s(pos, kind, first, last)"""
)
def block_sections(t: Tables) -> DataFrame:
    from condensa.kernels.mixed import sections

    c = F.col
    whole = text("intro of ", c("p_name"), '\n[\n  {"key": ', c("p_partkey"), '},\n  {"size": ', c("p_size"), "}\n]\noutro of ", c("p_type"))
    got = each(lambda x: [(i, s.kind, s.first, s.last) for i, s in enumerate(sections(x))], "array<struct<pos:int,kind:string,first:int,last:int>>", whole)
    return spread(t.part).select("p_partkey", F.explode(got).alias("s")).select("p_partkey", "s.*")


@query(
    """WITH p AS (SELECT p_partkey, length('see ' || p_name || ' ') AS a, length('["' || repeat(p_name, 100) || '"]') AS n FROM part)
    SELECT p_partkey, CAST(a AS INT) AS start, CAST(a + n AS INT) AS stop, 'see ' || p_name || ' <' || n || '> and [1]' AS replaced FROM p JOIN part USING (p_partkey)"""
)
def json_spans(t: Tables) -> DataFrame:
    """Large JSON values within a line of text; small ones stay."""
    from condensa.kernels import mixed

    def run(x: str) -> tuple:
        (a, b), *more = mixed.json_spans(x)
        return (None, None, None) if more else (a, b, mixed.replace_spans(x, lambda part: f"<{len(part)}>")[0])

    c = F.col
    whole = text("see ", c("p_name"), ' ["', F.repeat("p_name", F.lit(100)), '"] and [1]')
    return spread(t.part).select("p_partkey", each(run, "start int, stop int, replaced string", whole).alias("m")).select("p_partkey", "m.*")


@query(
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'json_array' WHEN 1 THEN 'git_diff' WHEN 2 THEN 'html' WHEN 3 THEN 'search_results' WHEN 4 THEN 'build_output' WHEN 5 THEN 'tabular' WHEN 6 THEN 'structured_config' WHEN 7 THEN 'source_code' WHEN 8 THEN 'json_array' ELSE 'plain_text' END AS native,
    CASE p_partkey % 10 WHEN 0 THEN 'json_array' WHEN 1 THEN 'git_diff' WHEN 2 THEN 'html' WHEN 3 THEN 'search_results' WHEN 4 THEN 'build_output' WHEN 5 THEN 'tabular' WHEN 6 THEN 'structured_config' WHEN 7 THEN 'source_code' WHEN 8 THEN 'json_array' ELSE 'plain_text' END AS kernel FROM part"""
)
def block_types(t: Tables) -> DataFrame:
    """A block of each type: what the columns and what the kernel take it for."""
    from condensa.functions.detect import content_type
    from condensa.kernels.detect import content_type as kernel

    c = F.col
    k, n, name = c("p_partkey") % 10, c("p_size"), c("p_name")
    many = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), f), "\n")
    whole = (
        F.when(k == 0, text("  [", n, ', {"a": "', name, '"}]\n')).when(k == 1, text("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-", name, "\n+", n))
        .when(k == 2, text("<!DOCTYPE html>\n<html><head><title>", name, "</title></head><body><p>", n, "</p></body></html>"))
        .when(k == 3, many(lambda i: text("src/", c("p_type"), ".py:", i, ": ", name))).when(k == 4, many(lambda i: text("2024-01-01 10:00:", i + 10, " ERROR step ", n, " failed")))
        .when(k == 5, text("key,name,size\n", many(lambda i: text(i, ",", name, ",", n)))).when(k == 6, many(lambda i: text("key", i, ":\n  size: ", n)))
        .when(k == 7, text("import os\n\n", many(lambda i: text("def f", i, "(a):\n    return a + ", n)))).when(k == 8, text('{"a": ', n, ', "b": ["', name, '"]}'))
        .otherwise(many(lambda i: text("The ", name, " lies on a shelf and nobody has asked for it so far.")))
    )
    rows = spread(t.part).select("p_partkey", whole.alias("text"))
    return rows.select("p_partkey", content_type("text").alias("native"), each(kernel, "string", F.col("text")).alias("kernel"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' WHEN 3 THEN 'rust' END AS language FROM part")
def path_languages(t: Tables) -> DataFrame:
    from condensa.kernels.detect import path_language

    k = F.col("p_partkey") % 5
    path = text("src/v1.2/", F.col("p_type"), F.when(k == 0, ".py").when(k == 1, ".JAVA").when(k == 2, ".ts").when(k == 3, ".rs").otherwise(".txt"))
    return spread(t.part).select("p_partkey", each(path_language, "string", path).alias("language"))


# ---------------------------------------------------------------- requests, stash

_TURNS = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS m FROM conversations"
_CANDIDATES = f"""m AS ({_TURNS}), tools AS (SELECT conv_id, count(*) FILTER (role = 'assistant') > 0 AS tool, max(m) AS last FROM m GROUP BY 1),
z AS (SELECT conv_id, coalesce(max(CASE WHEN turn % 7 = 6 THEN m + 1 END), 0) AS floor, max(CASE WHEN role = 'user' THEN m END) AS ceiling FROM m GROUP BY 1),
c AS (SELECT conv_id, 'anthropic' AS format, m, 0 AS part, 'content' AS field, text FROM m JOIN z USING (conv_id) WHERE conv_id % 3 = 0 AND m BETWEEN floor AND ceiling AND turn % 5 <> 4
UNION ALL SELECT conv_id, 'chat_completions', m, CASE WHEN turn % 4 < 2 THEN -1 ELSE 0 END, CASE WHEN turn % 4 < 2 THEN 'content' ELSE 'text' END, text FROM m JOIN tools USING (conv_id) WHERE conv_id % 3 = 1 AND role = 'assistant' AND tool
UNION ALL SELECT conv_id, 'responses', m, CASE WHEN turn % 4 < 2 THEN -1 ELSE 0 END, CASE WHEN turn % 4 < 2 THEN 'output' ELSE 'text' END, text FROM m WHERE conv_id % 3 = 2 AND role = 'assistant')"""


def _requests(t: Tables) -> DataFrame:
    """request_id, body: a conversation in one of the three formats; the assistant's turns stand for tool output."""
    c = F.col
    quoted = lambda x: F.replace(F.to_json(F.struct(x.alias("x"))), F.lit('{"x":'), F.lit(""))
    own = F.substring(quoted(c("text")), F.lit(1), F.length(quoted(c("text"))) - 1)
    kind, tool, whole = c("conv_id") % 3, c("role") == "assistant", c("turn") % 4 < 2
    mark = F.when(c("turn") % 7 == 6, ',"cache_control":{"type":"ephemeral"}').otherwise("")
    bad = F.when(c("turn") % 5 == 4, "true").otherwise("false")
    part = lambda name: text('[{"type":"', name, '","text":', own, '},{"type":"image","n":1.0}]')
    message = (
        F.when(kind == 0, text('{"role":"', c("role"), '","content":[{"type":"tool_result","is_error":', bad, ',"content":', own, mark, '},{"type":"text","text":"q"}]}'))
        .when(kind == 1, F.when(tool, text('{"role":"tool","tool_call_id":"a","content":', F.when(whole, own).otherwise(part("text")), "}")).otherwise(text('{"role":"user","content":', own, "}")))
        .otherwise(F.when(tool, text('{"type":"function_call_output","call_id":"a","output":', F.when(whole, own).otherwise(part("input_text")), "}")).otherwise(text('{"role":"user","content":', own, "}")))
    )
    rows = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",").alias("ms"))
    return rows.select(c("conv_id").alias("request_id"), text('{"model":"m","n":1.50,"', F.when(c("conv_id") % 3 == 2, "input").otherwise("messages"), '":[', c("ms"), "]}").alias("body"))


@query(f"WITH {_CANDIDATES} SELECT conv_id AS request_id, format, CAST(m AS INT) AS msg_idx, CAST(part AS INT) AS part_idx, field, sha256(text)[1:12] AS content FROM c")
def request_candidates(t: Tables) -> DataFrame:
    from condensa.sources.requests import candidates

    return candidates(_requests(t)).select("request_id", "format", F.col("msg_idx").cast("int").alias("msg_idx"), "part_idx", "field", F.substring(F.sha2("text", 256), 1, 12).alias("content"))


@query(
    f"""WITH {_CANDIDATES}, f AS (SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN 'responses' WHEN conv_id % 3 = 1 AND tool THEN 'chat_completions' ELSE 'anthropic' END AS format, last FROM tools),
    o AS (SELECT conv_id AS request_id, format, CASE WHEN format = 'anthropic' AND conv_id % 3 = 0 THEN floor ELSE 0 END AS floor, CASE WHEN format = 'anthropic' THEN ceiling ELSE last END AS ceiling FROM f JOIN z USING (conv_id))
    SELECT request_id, format, CAST(floor AS INT) AS floor, CAST(ceiling AS INT) AS ceiling FROM o WHERE ceiling >= floor"""
)
def request_zones(t: Tables) -> DataFrame:
    from condensa.sources.requests import live_zones

    return live_zones(_requests(t)).select("request_id", "format", F.col("floor").cast("int").alias("floor"), F.col("ceiling").cast("int").alias("ceiling"))


@query(f"WITH {_CANDIDATES} SELECT conv_id AS request_id, CAST(m AS INT) AS msg_idx, field, '<' || length(text) || ' \"é\">' AS text, true AS literals FROM c")
def request_write_back(t: Tables) -> DataFrame:
    """Each candidate replaced, and read from the rebuilt bodies; number literals are still as they were."""
    from condensa.sources.requests import candidates, rebuild

    bodies = _requests(t)
    found = candidates(bodies)
    again = rebuild(bodies, found.withColumn("text", text("<", F.length("text"), ' "é">')))
    rows = candidates(again).join(again.select("request_id", "body"), "request_id")
    whole = F.col("body").contains('"n":1.50') & (F.col("body").contains('"n":1.0}') | ~F.col("body").contains('"type":"image"'))
    return rows.select("request_id", F.col("msg_idx").cast("int").alias("msg_idx"), "field", "text", whole.alias("literals"))


@query(
    """WITH k AS (SELECT sha256(text)[1:24] AS key, any_value(text) AS text, bool_or(doc_id % 3 <> 0) AS live FROM documents GROUP BY 1)
    SELECT key, live, CASE WHEN live THEN CAST(octet_length(encode(text)) AS BIGINT) END AS n_bytes, CASE WHEN live THEN regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$')[1] END AS first_line, live AS after_purge FROM k"""
)
def stash_store(t: Tables) -> DataFrame:
    """All documents through the stash, some of them long ago; read by key and by line, before and after a purge."""
    from condensa.plans.scratch import cut, fresh
    from condensa.sources.stash import Stash

    stash = Stash(t.spark, fresh(t.spark))
    rows = t.documents.select("doc_id", core.stash_key("text").alias("key"), F.col("text").alias("content"))
    long_ago = F.current_timestamp() - F.expr("interval 3 hours")
    stash.put(rows.where("doc_id % 3 = 0"), long_ago)
    for _ in range(2):  # a replay stores nothing again
        stash.put(rows.where("doc_id % 3 <> 0"))
    keys = rows.select("key").distinct()
    before = cut(stash.get(keys).join(stash.get_lines(keys, 1, 1).select("key", "slice"), "key"))
    stash.purge_expired()
    after = cut(stash.has(keys).select("key").withColumn("after_purge", F.lit(True)))
    out = before.join(after, "key", "left")
    return out.select("key", F.col("content").isNotNull().alias("live"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.col("slice.text").alias("first_line"), F.coalesce("after_purge", F.lit(False)).alias("after_purge"))


# ---------------------------------------------------------------- bloat


@query(f"WITH {_DIFF} SELECT block, CAST(round(count(*) FILTER (kind = 'context') / CAST(count(*) AS DOUBLE), 6) AS DOUBLE) AS diff FROM d WHERE kind IN ('add', 'del', 'context') GROUP BY 1")
def diff_bloat(t: Tables) -> DataFrame:
    return _as_text(t.diff_lines()).select("block", F.round(bloat.diff(F.col("text")), 6).alias("diff"))


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round(CASE WHEN n > 5 THEN n / CAST(15.0 AS DOUBLE) ELSE 0 END, 6) AS json FROM a"""
)
def json_bloat(t: Tables) -> DataFrame:
    arrays = t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("text"))
    return arrays.select("o_custkey", F.round(bloat.json(F.col("text")), 6).alias("json"))


@query(
    """SELECT p_partkey, CAST(round((octet_length(encode('Made of ' || p_name || '.')) + 2) / CAST(octet_length(encode('# ' || p_brand)) + 2 + 2 * (octet_length(encode('Made of ' || p_name || '.')) + 2) + octet_length(encode('Second ' || p_type || '.')) + 1 AS DOUBLE), 6) AS DOUBLE) AS share FROM part"""
)
def repeat_bloat(t: Tables) -> DataFrame:
    """How much the conservative mode would leave out of a text: the paragraph that repeats."""
    from condensa.kernels.prose import bloat as share

    c = F.col
    made = text("Made of ", c("p_name"), ".\n\n")
    return spread(t.part).select("p_partkey", F.round(each(share, "double", text("# ", c("p_brand"), "\n\n", made, made, "Second ", c("p_type"), ".\n")), 6).alias("share"))


@query(
    """WITH x AS (SELECT p_partkey, '# ' || p_brand || chr(10) || chr(10) AS head, repeat('Made of ' || p_name || ' and nothing else. ', 8) || chr(10) || chr(10) AS made, 'Second ' || p_type || ', as it was said.' || chr(10) AS tail FROM part)
    SELECT p_partkey, 'lossy' AS status, head || made || tail || '<<stash:' || sha256(head || made || made || made || tail)[1:24] || '>>' AS output FROM x"""
)
def conservative_texts(t: Tables) -> DataFrame:
    """Plain text through the pipeline in the conservative mode."""
    from condensa.plans.compress import compress_blocks

    c = F.col
    made = text(F.repeat(text("Made of ", c("p_name"), " and nothing else. "), F.lit(8)), "\n\n")
    blocks = t.part.select("p_partkey", text("# ", c("p_brand"), "\n\n", made, made, made, "Second ", c("p_type"), ", as it was said.\n").alias("text"))
    return compress_blocks(blocks, conservative=True).select("p_partkey", "result.status", c("result.text").alias("output"))


@query(
    f"""WITH {_LOG_SELECT}, levels AS (SELECT block, count(*) AS total, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'fail') AS fails, count(*) FILTER (level = 'warn') AS warnings FROM s GROUP BY 1), chosen AS (SELECT block, count(*) AS selected FROM z WHERE kept GROUP BY 1)
    SELECT block, total, selected, errors, fails, warnings, true AS saves FROM levels JOIN chosen USING (block) WHERE total >= 50"""
)
def log_counters(t: Tables) -> DataFrame:
    """What the log kernel reports of a block: lines, lines selected, levels, and that tokens are saved."""
    from condensa.kernels.base import Context
    from condensa.kernels.loglines import shrink_log

    def run(x: str) -> tuple:
        i = shrink_log(x, Context()).info
        return i["total"], i["selected"], i["error"], i["fail"], i["warn"], i["tokens_saved"] > 0

    long = _as_text(t.log_lines()).where(F.size(F.split("text", "\n", -1)) >= 50)
    return long.select("block", each(run, "total bigint, selected bigint, errors bigint, fails bigint, warnings bigint, saves boolean", F.col("text")).alias("m")).select("block", "m.*")
