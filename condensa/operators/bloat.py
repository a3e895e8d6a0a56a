"""How much of a block its operator would probably remove, from 0 to more than 1; cheap, and not used to decide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.config import CRUSH, LOG, TEXT
from condensa.functions.core import let, lines, trimmed
from condensa.operators.html import tag_density
from condensa.operators.ranking import segments


def _share(xs: Column, pattern: str) -> Column:
    return F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: x.rlike(pattern))) / F.size(xs)).otherwise(F.lit(0.0))


def json(text: Column) -> Column:
    n = F.json_array_length(text)
    return F.when(n > CRUSH.min_items, n / F.lit(float(CRUSH.max_items))).otherwise(F.lit(0.0))


def log(text: Column) -> Column:
    return F.when(F.size(lines(text)) < LOG.min_lines, F.lit(0.0)).otherwise(F.lit(0.5))


def search(text: Column) -> Column:
    return _share(F.filter(lines(text), lambda x: trimmed(x) != ""), r"^\s*[^\s:]+:\d+:")


def diff(text: Column) -> Column:
    """Share of context among the lines of hunks; nothing without a diff."""
    rest = lambda xs: F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1)))
    files = rest(F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\n$", "")), r"\n(?=diff --(?:git|combined|cc) )", -1))
    hunks = F.flatten(F.transform(files, lambda f: rest(F.split(f, r"\n(?=@@+ )", -1))))
    body = F.flatten(F.transform(hunks, lambda h: rest(F.split(h, "\n", -1))))
    share = lambda xs: F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: x.startswith(" "))) / F.size(xs)).otherwise(F.lit(0.0))
    return let(body, share)


def text(block: Column) -> Column:
    return F.when(F.size(segments(block)) < TEXT.min_segments, F.lit(0.0)).otherwise(F.lit(1 - TEXT.ratio))


def html(page: Column) -> Column:
    return tag_density(page)


def _own_lines(block: Column) -> Column:
    """Lines, without an empty one after a last line feed."""
    return lines(F.regexp_replace(block, "\n$", ""))


def config(block: Column) -> Column:
    return _share(_own_lines(block), r"^\s*(?:#|$)")


def table(block: Column) -> Column:
    n = F.size(F.filter(lines(block), lambda x: trimmed(x) != ""))
    return F.greatest(F.lit(0), n - 1) / F.lit(float(CRUSH.max_items))


def code(block: Column) -> Column:
    return _share(_own_lines(block), r"^[ \t]")
