"""Importance of lines: levels, keywords, summaries, commands; as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.functions.core import C, col, let
from condensa.kernels import loglines

# Words by category, in the order in which they count; scores.
KEYWORDS = {
    "error": "error exception fail failed failure fatal crash panic abort timeout denied rejected".split(),
    "importance": "important note todo fixme hack xxx bug fix".split(),
    "security": "security auth password secret".split(),
    "warning": "warn warning".split(),
}
INDICATORS = "error fail exception traceback fatal panic crash".split()
SCORES = {"error": 0.95, "importance": 0.6, "security": 0.85, "warning": 0.75, "markdown": 0.45}
CONFIDENCE = 0.7
MARKDOWN = r"^(?:#{1,4} |\*\*|> )"
#: Tokens that may go without a look, and the share of the price of cached tokens, by plan; read, write and base price.
POLICY = {"payg": (128, 0.45), "subscription": (32, 0.25)}
CACHE_MULTIPLIERS = {"write": 1.25, "write_long": 2.0, "read": 0.1}


def word(words: list[str]) -> str:
    return r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"


def level(line: C) -> Column:
    """The most severe level whose word the line has, in one of three casings."""
    out = F.lit("unknown")
    for name, words in reversed(loglines.LEVELS):
        forms = "|".join(f"{w.upper()}|{w}|{w.capitalize()}" for w in words.split())
        out = F.when(col(line).rlike(rf"(?<![A-Za-z0-9_])(?:{forms})(?![A-Za-z0-9_])"), name).otherwise(out)
    return out


def log_format(lines: Column) -> Column:
    """The tool whose marks most of the first 100 lines have, or generic."""

    def best(xs: Column) -> Column:
        hits = [_marked(xs, marks) for marks in loglines.FORMATS.values()]
        out, top = F.lit("generic"), F.greatest(*hits)
        for name, n in reversed(list(zip(loglines.FORMATS, hits, strict=True))):
            out = F.when((n > 0) & (n == top), name).otherwise(out)
        return out

    return let(F.slice(lines, 1, 100), best)


def _marked(xs: Column, marks: list[str]) -> Column:
    pattern = "|".join(map(re.escape, marks))
    return F.size(F.filter(xs, lambda x: x.rlike(pattern)))


def level_score(name: C) -> Column:
    out = F.lit(loglines.SCORES["unknown"])
    for k, v in loglines.SCORES.items():
        out = F.when(col(name) == k, F.lit(v)).otherwise(out)
    return out


def summary(line: C) -> Column:
    return col(line).rlike("^(?:%s)" % loglines.SUMMARY.pattern)


def command_echo(line: C) -> Column:
    return col(line).rlike("^(?:%s)" % loglines._PROMPT.pattern)


def goes_on(line: C) -> Column:
    return col(line).rlike(r"(?<!\\)(?:\\\\)*\\\s*$|[`^|]\s*$|&&\s*$")


def opens_trace(line: C) -> Column:
    """Flavour of the stack trace that a line opens, or null."""
    out = F.lit(None).cast("string")
    for name, opens, _ in reversed(loglines.FLAVOURS):
        out = F.when(col(line).rlike("^(?:%s)" % opens.pattern), name).otherwise(out)
    return out


def runtime_frame(line: C) -> Column:
    return col(line).rlike("^(?:%s)" % loglines.RUNTIME.pattern)


def dedupe_key(line: C) -> Column:
    """A line in which addresses, numbers and folders after its label are masked."""
    head = F.regexp_extract(col(line), "^[^:=]*", 0)
    tail = F.substring(col(line), F.length(head) + 1, F.length(col(line)))
    tail = F.regexp_replace(tail, "0x[0-9a-fA-F]+", "ADDR")
    tail = F.regexp_replace(tail, "[0-9]+", "N")
    return F.concat(head, F.regexp_replace(tail, "/(?=[A-Za-z0-9_/]*[A-Za-z0-9_])[A-Za-z0-9_/]*/", "/PATH/"))


def keyword_category(line: C, context: str = "text") -> Column:
    """Category of a line in a context (text, diff, search or log), or null: errors first."""
    order = ["error", "importance", "security" if context == "diff" else "warning"]
    out = F.when(col(line).rlike(MARKDOWN), "markdown") if context == "text" else F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(col(line).rlike(word(KEYWORDS[name])), name).otherwise(out)
    return out


def keyword_score(line: C, context: str = "text") -> Column:
    category, out = keyword_category(line, context), F.lit(0.0)
    for k, v in SCORES.items():
        out = F.when(category == k, F.lit(v)).otherwise(out)
    return out


def has_indicator(text: C) -> Column:
    """One of the words of trouble stands anywhere in the text."""
    return F.lower(col(text)).rlike("|".join(INDICATORS))


def tiered(*scored: tuple[Column, Column]) -> Column:
    """Score of the first (score, confidence) that is sure enough, else of the surest."""
    best = F.greatest(*[F.struct(c.alias("c"), s.alias("s")) for s, c in scored]) if len(scored) > 1 else F.struct(scored[0][1].alias("c"), scored[0][0].alias("s"))
    return F.coalesce(*[F.when(c >= CONFIDENCE, s) for s, c in scored], best["s"])


def query_anchors(query: C) -> Column:
    """Quoted strings, long numbers, addresses, host names and identifiers of a query, lower-cased and distinct."""
    q = col(query)
    every = lambda p, g=0: F.regexp_extract_all(q, F.lit(p), F.lit(g))
    quoted = F.filter(F.concat(every("'([^']*)'", 1), every('"([^"]*)"', 1)), lambda x: F.length(F.trim(x)) >= 2)
    tokens = F.filter(every("[A-Za-z0-9@._-]+"), lambda t: t.rlike("^[0-9]{4,}$") | t.contains("@") | (t.contains(".") & (F.length(t) >= 4)))
    ids = every("(?i)(?<![0-9a-f-])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f-])")
    return F.array_sort(F.array_distinct(F.transform(F.concat(quoted, tokens, ids), lambda x: F.lower(x))))
