"""Request bodies: the three formats of chat requests as rows of candidate blocks, and back.

A request row has request_id and body (JSON); query is optional. Bodies stay text: a block is put back where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condensa.kernels.base import dumps, loads

#: Text parts of an output in the responses format.
RESPONSE_PARTS = ("input_text", "output_text", "summary_text")

BLOCK = T.StructType(
    [
        T.StructField("msg_idx", T.IntegerType()), T.StructField("part_idx", T.IntegerType()),
        T.StructField("field", T.StringType()), T.StructField("text", T.StringType()),
    ]
)


def detect_format(body: Column) -> Column:
    """anthropic, chat_completions, responses or unknown."""
    has = lambda path: F.get_json_object(body, path).isNotNull()
    messages = F.get_json_object(body, "$.messages")
    roles = F.from_json(messages, "array<struct<role:string,tool_calls:string,tool_call_id:string>>")
    tool = F.exists(roles, lambda m: (m["role"] == "tool") | m["tool_calls"].isNotNull() | m["tool_call_id"].isNotNull())
    return (
        F.when(has("$.input"), "responses").when(~F.coalesce(messages.startswith("["), F.lit(False)), "unknown")
        .when(F.coalesce(tool, F.lit(False)), "chat_completions").otherwise("anthropic")
    )


def messages(requests: DataFrame) -> DataFrame:
    """request_id, format, msg_idx, role, cached (it has a cache mark), message (JSON) of every message or item."""
    kind = detect_format(F.col("body"))
    items = F.from_json(F.coalesce(F.get_json_object("body", "$.input"), F.get_json_object("body", "$.messages")), "array<string>")
    rows = requests.select("request_id", kind.alias("format"), F.posexplode(items).alias("msg_idx", "message"))
    blocks = F.from_json(F.get_json_object("message", "$.content"), "array<struct<cache_control:string>>")
    cached = F.coalesce(F.exists(blocks, lambda b: b["cache_control"].isNotNull()), F.lit(False)) & (F.col("format") == "anthropic")
    return rows.select("request_id", "format", "msg_idx", F.get_json_object("message", "$.role").alias("role"), cached.alias("cached"), "message")


def live_zones(requests: DataFrame) -> DataFrame:
    """request_id, format, floor, ceiling: the messages in which blocks may be changed; requests without any give no row."""
    by = messages(requests).groupBy("request_id", "format").agg(
        F.coalesce(F.max(F.when(F.col("cached"), F.col("msg_idx") + 1)), F.lit(0)).alias("floor"),
        F.max(F.when(F.col("role") == "user", F.col("msg_idx"))).alias("last_user"), F.max("msg_idx").alias("last"),
    )
    ceiling = F.when(F.col("format") == "anthropic", F.col("last_user")).otherwise(F.col("last"))
    return by.select("request_id", "format", "floor", ceiling.alias("ceiling")).where("ceiling >= floor")


def candidates(requests: DataFrame) -> DataFrame:
    """request_id, format, msg_idx, part_idx (-1: the message itself), field, text: tool output within the live zone."""
    rows = messages(requests).join(live_zones(requests).drop("format"), "request_id").where(F.col("msg_idx").between(F.col("floor"), F.col("ceiling")))
    # a VARIANT tells a string from an array that a string holds
    at = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    is_text = lambda v, path: F.coalesce(F.schema_of_variant(at(v, path, "variant")) == "STRING", F.lit(False))
    one = lambda i, field, text: F.struct(i.cast("int").alias("part_idx"), F.lit(field).alias("field"), text.alias("text"))
    none = F.array().cast("array<struct<part_idx:int,field:string,text:string>>")
    m = F.col("__m")

    def parts(path: str, field: str, fits) -> Column:
        placed = F.transform(at(m, path, "array<variant>"), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        good = F.filter(placed, lambda x: F.coalesce(fits(x["p"]), F.lit(False)) & is_text(x["p"], f"$.{field}"))
        return F.coalesce(F.transform(good, lambda x: one(x["i"], field, at(x["p"], f"$.{field}"))), none)

    def whole(field: str) -> Column:
        return F.when(is_text(m, f"$.{field}"), F.array(one(F.lit(-1), field, at(m, f"$.{field}")))).otherwise(none)

    kind = lambda p: at(p, "$.type")
    tool_result = lambda p: (kind(p) == "tool_result") & ~F.coalesce(at(p, "$.is_error", "boolean"), F.lit(False))
    found = (
        F.when(F.col("format") == "anthropic", parts("$.content", "content", tool_result))
        .when((F.col("format") == "chat_completions") & (F.col("role") == "tool"), F.concat(whole("content"), parts("$.content", "text", lambda p: kind(p) == "text")))
        .when((F.col("format") == "responses") & (kind(m) == "function_call_output"), F.concat(whole("output"), parts("$.output", "text", lambda p: kind(p).isin(*RESPONSE_PARTS))))
        .otherwise(none)
    )
    rows = rows.withColumn("__m", F.try_parse_json("message"))
    return rows.select("request_id", "format", "msg_idx", F.explode(found).alias("c")).select("request_id", "format", "msg_idx", "c.*")


def rebuild(requests: DataFrame, changed: DataFrame) -> DataFrame:
    """``requests`` with the texts of ``changed`` (request_id, msg_idx, part_idx, field, text) put in their places.

    Bodies without a changed block pass through byte by byte; in others only these strings differ, number literals and
    the order of keys stay.
    """
    edits = changed.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "part_idx", "field", "text"))).alias("__edits"))
    joined = requests.join(edits, "request_id", "left")

    @F.pandas_udf(T.StringType())
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, edits in batches:
            yield pd.Series([write_back(b, e) for b, e in zip(bodies, edits, strict=True)])

    body = F.when(F.col("__edits").isNotNull(), put.asNondeterministic()("body", "__edits")).otherwise(F.col("body"))
    return joined.withColumn("body", body).drop("__edits")


def write_back(body: str, edits) -> str:
    if edits is None or not len(edits):
        return body
    value = loads(body)
    items = value["input"] if "input" in value else value["messages"]
    for e in edits:
        holder = items[e["msg_idx"]]
        field = e["field"]
        if e["part_idx"] >= 0:
            holder = holder["content" if isinstance(holder.get("content"), list) else "output"][e["part_idx"]]
        holder[field] = e["text"]
    return dumps(value)
