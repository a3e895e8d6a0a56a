"""Column functions of the block pipeline: sizes, tokens, keys, markers, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.config import GATES, STASH

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it stands in there, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_estimate(text: C) -> Column:
    """Tokens of a text, from its bytes."""
    return F.ceil(F.octet_length(col(text)) / F.lit(GATES.bytes_per_token) * F.lit(GATES.token_margin))


def over_gate(text: C) -> Column:
    return F.octet_length(col(text)) >= GATES.min_block_bytes


def stash_key(text: C) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, STASH.key_chars)


def marker(key: C) -> Column:
    return F.concat(F.lit("<<stash:"), col(key), F.lit(">>"))


def has_marker(text: C) -> Column:
    return col(text).rlike("<<stash:[0-9a-fA-F]{24}>>")


def valid_key(key: C) -> Column:
    return F.coalesce(col(key).rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def accepted(before: C, after: C) -> Column:
    """A lossy text is published only if it has fewer tokens."""
    return token_estimate(after) < token_estimate(before)


def trimmed(text: C) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def lines(text: C) -> Column:
    """Parts between line feeds, the empty one after a last line feed too."""
    return F.split(col(text), "\n", -1)


def whole_lines(text: C) -> Column:
    """Lines with their ends; no empty line after a last line feed."""
    return F.regexp_extract_all(col(text), F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))


def line_slice(text: C, start: int, count: int) -> Column:
    """Struct (text, start_line, line_count, total_lines, has_more) of some whole lines; null beyond the end."""
    if start < 1 or not 1 <= count <= STASH.max_slice_lines:
        raise ValueError("start is 1 or more, count from 1 to %d" % STASH.max_slice_lines)

    def cut(every: Column) -> Column:
        part = F.slice(every, start, count)
        out = F.struct(
            F.array_join(part, "").alias("text"), F.lit(start).alias("start_line"), F.size(part).alias("line_count"),
            F.size(every).alias("total_lines"), (F.size(every) > start - 1 + F.size(part)).alias("has_more"),
        )
        return F.when(F.size(every) >= start, out)

    return let(whole_lines(text), cut)


def entropy_share(token: Column) -> Column:
    """Shannon entropy of a token over that of a uniform choice of its distinct characters."""

    def share(chars: Column) -> Column:
        kinds, n = F.array_distinct(chars), F.size(chars).cast("double")

        def add(acc: Column, k: Column) -> Column:
            p = F.size(F.filter(chars, lambda c: c == k)) / n
            return acc - p * F.log2(p)

        return F.when(F.size(kinds) > 1, F.aggregate(kinds, F.lit(0.0), add) / F.log2(F.size(kinds).cast("double"))).otherwise(F.lit(0.0))

    return let(F.filter(F.split(token, ""), lambda c: c != ""), share)


def secret_tokens(text: C, least: float = 0.85) -> Column:
    """Array of the high-entropy tokens of a text, in order, repeats included."""
    found = F.regexp_extract_all(col(text), F.lit("[A-Za-z0-9+/=_-]{20,}"), F.lit(0))
    return F.filter(found, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (entropy_share(t) >= least))


def keeps_secrets(original: C, view: C) -> Column:
    """Each high-entropy token of the original is in the view as often."""
    seen = F.regexp_extract_all(col(view), F.lit("[A-Za-z0-9+/=_-]{20,}"), F.lit(0))
    often = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    pair = F.struct(secret_tokens(original).alias("own"), seen.alias("seen"))
    return let(pair, lambda p: F.forall(p["own"], lambda t: often(p["seen"], t) >= often(p["own"], t)))
