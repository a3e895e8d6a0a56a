"""Groups of rows as schema-first tables: ``[n]{column:type,...}`` and one CSV line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def type_tag(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.FractionalType):
        return "float"
    return "json" if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else "string"


def render(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """``by`` and table: the rows of each group, which must fit in memory as a block of text does.

    Columns stand by name; a column with nulls in the group has a question mark.
    """
    names = sorted(columns)
    line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in names])
    head = F.concat_ws(",", *[F.concat(F.lit(f"{c}:{type_tag(df.schema[c].dataType)}"), F.when(F.col(f"__null_{c}") > 0, "?").otherwise("")) for c in names])
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in names],
    )
    body = F.array_join(F.transform("__rows", lambda r: F.concat(r["l"], F.lit("\n"))), "")
    return grouped.select(*by, F.concat(F.lit("["), F.col("__n").cast("string"), F.lit("]{"), head, F.lit("}\n"), body).alias("table"))


def savings(table: Column, json: Column) -> Column:
    """Share of the bytes of compact JSON that a table saves."""
    return 1 - F.octet_length(table) / F.greatest(F.octet_length(json), F.lit(1))


def opaque_kind(value: Column) -> Column:
    """Kind of a long string that is better stashed than shown, or null."""
    alphabet = F.length(F.regexp_replace(value, "[^A-Za-z0-9+/=_-]", ""))
    chars = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    base64 = ~value.rlike(r"[<>\s]") & (alphabet / F.octet_length(value) >= 0.95) & (chars >= 16)
    container = value.rlike(r"^\s*[{\[]") & F.try_parse_json(value).isNotNull()
    long = (F.octet_length(value) > 256) & ~value.contains("<<stash:") & ~container
    return F.when(long, F.when(base64, "base64").when(F.regexp_count(value, F.lit("<[A-Za-z/!]")) >= 3, "html").otherwise("string"))


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(n / 1024.0, 1)), F.lit("KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.bround(n / 1048576.0, 1)), F.lit("MB")))
    )
