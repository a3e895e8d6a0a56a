"""HTML with built-in functions: the main fragment, entities, density of tags. Markdown is the kernel's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.kernels.html_md import ENTITIES


def main_fragment(page: Column) -> Column:
    """Content of the first article, else main, else body, up to the first end tag; else null."""
    part = lambda t: F.nullif(F.regexp_extract(page, rf"(?is)<{t}(?:[/ \t\n\r][^>]*)?>(.*?)</{t}", 1), F.lit(""))
    return F.coalesce(part("article"), part("main"), part("body"))


def decoded(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tag_density(page: Column) -> Column:
    """Share of bytes that are tags."""
    rest = F.regexp_replace(page, r"<[^>]*>", "")
    return F.when(F.octet_length(page) > 0, (F.octet_length(page) - F.octet_length(rest)) / F.octet_length(page)).otherwise(F.lit(0.0))
