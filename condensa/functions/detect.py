"""Content type of a text block with built-in functions: each detector as a column, then the cascade.

JSON other than a whole container, quoted delimiters and a few rules for front matter need the kernel
(``condensa.kernels.detect``); tests hold the two against each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.functions.core import C, col, let, lines, trimmed
from condensa.kernels import detect as k

WORD = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
#: The log patterns, as Java regular expressions that find.
LOG_PATTERNS = (
    "(?i)" + WORD % "error|fail|failed|fatal|critical", "(?i)" + WORD % "warn|warning", "(?i)" + WORD % "info|debug|trace",
    r"^\s*\d{4}-\d{2}-\d{2}", r"^\s*\[\d{2}:\d{2}:\d{2}\]", r"^\s*(?:={3,}|-{3,})", r"^\s*(?:PASSED|FAILED|SKIPPED)",
    r"^\s*(?:npm ERR!|yarn error|cargo error)", r"Traceback \(most recent call last\)", r"^\s*at\s+[\w.$]+\(",
)


def sampled(text: C, n: int, filled: bool = True) -> Column:
    """The first ``n`` lines, without blank ones if ``filled``."""
    first = F.slice(lines(text), 1, n)
    return F.filter(first, lambda x: trimmed(x) != "") if filled else first


def matching(xs: Column, pattern: str) -> Column:
    return F.size(F.filter(xs, lambda x: x.rlike(pattern)))


def is_json(text: C) -> Column:
    """A whole JSON array or object."""
    body = trimmed(text)
    return body.rlike(r"^[{\[]") & F.try_parse_json(body).isNotNull()


def is_diff(text: C) -> Column:
    return matching(sampled(text, 500, False), "^(?:%s)" % k.DIFF_HEADER.pattern) > 0


def html_confidence(text: C) -> Column:
    def score(sample: Column) -> Column:
        doctype = sample.rlike(r"^\s*<!doctype html").cast("double")
        tag = lambda t: sample.rlike(rf"<{t}[ \t>]").cast("double")
        structural = F.regexp_count(sample, F.lit(k.STRUCTURAL.pattern))
        found = (doctype > 0) | (tag("html") > 0) | (structural >= 3)
        out = 0.5 * doctype + 0.3 * tag("html") + 0.1 * tag("head") + 0.1 * tag("body") + F.least(F.lit(0.3), 0.03 * structural)
        return F.when(found, F.least(F.lit(1.0), out)).otherwise(F.lit(0.0))

    head = F.substring(col(text).cast("binary"), 1, 3000).cast("string")
    return let(F.lower(F.make_valid_utf8(head)), score)  # the cut may fall within a character


def search_share(text: C) -> Column:
    return let(sampled(text, 100), lambda xs: F.when(F.size(xs) > 0, matching(xs, r"^[^:\s]+:\d+:") / F.size(xs)).otherwise(F.lit(0.0)))


#: Every word of the first three log patterns has one of these.
LOG_STEMS = ("error", "fail", "fatal", "critical", "warn", "info", "debug", "trace")


def log_pattern(line: Column) -> Column:
    """Number of the first log pattern of a line, or null; lines without a stem are not searched for words."""

    def first(fit: range, otherwise: Column) -> Column:
        out = otherwise
        for i in reversed(fit):
            out = F.when(line.rlike(LOG_PATTERNS[i]), F.lit(i)).otherwise(out)
        return out

    rest = first(range(3, len(LOG_PATTERNS)), F.lit(None).cast("int"))
    stems = let(F.lower(line), lambda x: reduce(Column.__or__, [x.contains(w) for w in LOG_STEMS]))
    return F.when(stems, first(range(3), rest)).otherwise(rest)


def log_confidence(text: C) -> Column:
    def score(f: Column) -> Column:
        share = F.size(f["kinds"]) / f["n"]
        out = 0.3 + 0.5 * share + 0.05 * F.size(F.filter(f["kinds"], lambda x: x < 2))
        return F.when((F.size(f["kinds"]) > 0) & (share >= 0.1), F.least(F.lit(1.0), out)).otherwise(F.lit(0.0))

    found = lambda xs: F.struct(F.filter(F.transform(xs, log_pattern), lambda x: x.isNotNull()).alias("kinds"), F.size(xs).alias("n"))
    return let(let(sampled(text, 200), found), score)


def _share(xs: Column, delimiter: str) -> Column:
    """Share of lines that have the most common number of a delimiter; 0 if that or the first one is none."""
    bare = lambda x: F.regexp_replace(x, r'"(?:[^"]|"")*(?:"|$)', "") if delimiter != '"' else x
    counts = F.transform(xs, lambda x: F.regexp_count(F.when(x.contains('"'), bare(x)).otherwise(x), F.lit("\\" + delimiter)))

    def best(cs: Column) -> Column:
        often = lambda c: F.size(F.filter(cs, lambda x: x == c))
        top = F.array_max(F.transform(F.array_distinct(cs), lambda c: F.struct(often(c).alias("n"), c.alias("c"))))
        return let(top, lambda t: F.when((F.element_at(cs, 1) > 0) & (t["c"] > 0), t["n"] / F.size(cs)).otherwise(F.lit(0.0)))

    return F.when(F.size(xs) >= 3, let(counts, best)).otherwise(F.lit(0.0))


def delimiter_share(text: C, delimiter: str) -> Column:
    return let(sampled(text, 50), lambda xs: _share(xs, delimiter))


def is_table(text: C) -> Column:
    def table(xs: Column) -> Column:
        source = matching(xs, "^(?:%s)" % k.SOURCE_LIKE.pattern)
        separator = F.exists(xs, lambda x: x.rlike(r"^\s*\|?\s*:*-{2,}:*\s*(?:\|\s*:*-{2,}:*\s*)+\|?\s*$"))
        prose = matching(xs, r"[.!?]\s*$") / F.size(xs) >= 0.5
        words = lambda d: F.aggregate(xs, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"[^\s%s]+" % d)))
        cells = lambda d: F.aggregate(xs, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit("\\" + d)) + 1)
        cut = F.lit(False)
        for d in ",\t;|":
            cut = cut | ((_share(xs, d) >= (0.7 if d == "\t" else 0.85)) & (words(d) / cells(d) <= 3.0))
        return (F.size(xs) >= 3) & (source < 2) & (separator | (~prose & cut))

    return let(sampled(text, 50), table)


def code_hits(text: C, language: str) -> Column:
    return matching(sampled(text, 100, False), r"^\s*(?:%s)" % k.CODE_LINE[language].pattern)


def code_confidence(text: C) -> Column:
    def score(xs: Column) -> Column:
        best = F.greatest(*[matching(xs, r"^\s*(?:%s)" % p.pattern) for p in k.CODE_LINE.values()])
        filled = F.greatest(F.lit(1), F.size(F.filter(xs, lambda x: trimmed(x) != "")))
        return let(best, lambda b: F.when(b >= 3, F.least(F.lit(1.0), 0.4 + 0.4 * b / filled + 0.02 * b)).otherwise(F.lit(0.0)))

    return let(sampled(text, 100, False), score)


def is_config(text: C) -> Column:
    """YAML, or sections with assignments."""

    def config(xs: Column) -> Column:
        n = F.size(xs)
        sections = matching(xs, r"""^\s*\[+\s*[\w.\-"' ]+\s*\]+\s*$""")
        assigned = matching(xs, r"^\s*[^\s\[#;=:][^\s=:]*\s*[=:]\s*\S")
        keys = matching(xs, r"""^\s*(?:- )?(?:["'][^:]*|[\p{L}\p{N}._/-]+)\s*:(?:\s|$)""")
        items = matching(xs, r"^\s*-\s") - matching(xs, r"""^\s*- (?:["'][^:]*|[\p{L}\p{N}._/-]+)\s*:(?:\s|$)""")
        marks = matching(xs, r"^\s*(?:---|\.\.\.)\s*$")
        words = F.aggregate(xs, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"\S+")))
        indents = F.size(F.array_distinct(F.transform(F.filter(xs, lambda x: x.rlike(r"^\s*(?:-\s|(?:[\p{L}\p{N}._/-]+)\s*:)")), lambda x: F.length(F.regexp_extract(x, "^( *)", 1)))))
        ini = (sections > 0) & (assigned >= 2) & ((sections + assigned) / n >= 0.6)
        yaml = (keys >= 3) & ((keys + items + marks) / n >= 0.6) & (matching(xs, r"[.!?]\s*$") / n < 0.5) & (words / n <= 8)
        return (n >= 3) & (ini | (yaml & ((indents >= 2) | (marks > 0) | (items >= 3))))

    body = F.filter(sampled(text, 200), lambda x: ~x.rlike(r"^\s*[#;]"))
    return ~trimmed(text).rlike(r"^[{<]") & let(body, config)


def content_type(text: C) -> Column:
    """The first detector that fits, in the order of the cascade; but for JSON, they look at the first 500 lines."""
    whole, text = text, F.substring_index(col(text), "\n", 500)
    is_search = let(search_share(text), lambda s: (s >= 0.3) & (0.4 + 0.6 * s >= 0.6))
    return (
        F.when(trimmed(whole) == "", k.PLAIN).when(is_json(whole), k.JSON).when(is_diff(text), k.DIFF)
        .when(html_confidence(text) >= 0.7, k.HTML).when(is_search, k.SEARCH)
        .when(log_confidence(text) >= 0.5, k.LOG).when(is_table(text), k.TABLE).when(is_config(text), k.CONFIG)
        .when(code_confidence(text) >= 0.5, k.CODE).otherwise(k.PLAIN)
    )


def path_language(path: C) -> Column:
    """Language that a file name says, or null."""
    extension = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for p in k.LANGUAGE_OF.items() for x in p]), extension)
