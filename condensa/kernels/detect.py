"""Content type of a text block: an ordered cascade of detectors over bounded samples."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

from condensa.kernels.base import loads, loads_prefix, nbytes

JSON, DIFF, HTML, SEARCH, LOG, TABLE, CONFIG, CODE, PLAIN = (
    "json_array", "git_diff", "html", "search_results", "build_output", "tabular", "structured_config", "source_code", "plain_text",
)

# Patterns and word lists that decide a content type.
DIFF_HEADER = re.compile(
    r"diff --git |diff --combined |diff --cc |--- a/|@@\s+[-+]\d+,\d+\s+[-+]\d+,\d+\s+@@|@@@+\s+(?:[-+]\d+,\d+\s+){2,}@@@+"
)
DIFF_CHANGE = re.compile(r"[+-][^+-]")
SEARCH_LINE = re.compile(r"[^:\s]+:\d+:")
STRUCTURAL = re.compile(r"<(?:div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)(?=[ \t>])")
LOG_LINE = (
    re.compile(r"(?i)(?<![\w])(?:error|fail|failed|fatal|critical)(?![\w])"),
    re.compile(r"(?i)(?<![\w])(?:warn|warning)(?![\w])"),
    re.compile(r"(?i)(?<![\w])(?:info|debug|trace)(?![\w])"),
    re.compile(r"\s*\d{4}-\d{2}-\d{2}"),
    re.compile(r"\s*\[\d{2}:\d{2}:\d{2}\]"),
    re.compile(r"\s*(?:={3,}|-{3,})"),
    re.compile(r"\s*(?:PASSED|FAILED|SKIPPED)"),
    re.compile(r"\s*(?:npm ERR!|yarn error|cargo error)"),
    re.compile(r".*Traceback \(most recent call last\)"),
    re.compile(r"\s*at\s+[\w.$]+\("),
)
CODE_LINE = {
    "python": re.compile(r"(?:def|class|import|from|async def)\s+\w|@\w|\"\"\"|if __name__\s*=="),
    "javascript": re.compile(r"(?:function|const|let|var|class|import|export)\s|async\s+function|=>\s*\{|module\.exports"),
    "typescript": re.compile(r"(?:interface|type|enum|namespace)\s+\w|:\s*(?:string|number|boolean|any|void)\b"),
    "go": re.compile(r"(?:func|type|package|import)\s|func\s*\("),
    "rust": re.compile(r"(?:fn|struct|enum|impl|mod|use|pub)\s|#\["),
    "java": re.compile(r"(?:public|private|protected)\s+(?:class|interface|enum)|@\w|package\s+[\w.]+;"),
}
EXTENSIONS = {
    "python": "py pyi", "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "go": "go", "rust": "rs", "java": "java",
    "c": "c", "cpp": "cc cpp cxx hpp hh hxx",
}
LANGUAGE_OF = {e: lang for lang, names in EXTENSIONS.items() for e in names.split()}


def blank(line: str) -> bool:
    return not line.strip()


def path_language(path: str | None) -> str | None:
    return LANGUAGE_OF.get(os.path.splitext(path or "")[1][1:].lower())


def json_payload(text: str):
    """(value, start, end, normalised) of the JSON container that the text is, or that is most of it; else None."""
    if "{" not in text and "[" not in text:
        return None
    body = text.strip()
    lead = text.index(body[0])
    try:
        value = loads(body)
        return (value, lead, lead + len(body), False) if isinstance(value, (dict, list)) else None
    except ValueError:
        pass
    if body[0] == "{":
        values, at = [], 0
        try:
            while at < len(body):
                value, at = loads_prefix(body, at)
                if not isinstance(value, dict):
                    raise ValueError
                values.append(value)
                while at < len(body) and body[at] in " \t\r\n":
                    at += 1
            if len(values) > 1:
                return values, lead, lead + len(body), True
        except ValueError:
            pass
    opener = re.search(r"[{\[]", body)
    if not opener:
        return None
    start = opener.start()
    try:
        value, end = loads_prefix(body, start)
    except ValueError:
        return None
    if nbytes(body[start:end]) < nbytes(body) * 3 // 5:
        return None
    return value, lead + start, lead + end, True


def is_json(text: str) -> bool:
    return json_payload(text) is not None


def is_diff(text: str) -> bool:
    if "diff --" not in text and "--- a/" not in text and "@@" not in text:
        return False
    return any(DIFF_HEADER.match(x) for x in text.split("\n", 500)[:500])


def html_confidence(text: str) -> float:
    if "<" not in text:
        return 0.0
    sample = text[:3000].encode("utf-8", "surrogatepass")[:3000].decode("utf-8", "ignore").lower()
    doctype = bool(re.match(r"\s*<!doctype html", sample))
    tag = {t: bool(re.search(rf"<{t}[ \t>]", sample)) for t in ("html", "head", "body")}
    structural = len(STRUCTURAL.findall(sample))
    if not doctype and not tag["html"] and structural < 3:
        return 0.0
    return min(1.0, 0.5 * doctype + 0.3 * tag["html"] + 0.1 * tag["head"] + 0.1 * tag["body"] + min(0.3, 0.03 * structural))


def is_search(text: str) -> bool:
    if ":" not in text:
        return False
    lines = [x for x in text.split("\n", 100)[:100] if not blank(x)]
    hits = sum(bool(SEARCH_LINE.match(x)) for x in lines)
    return bool(hits) and hits / len(lines) >= 0.3 and 0.4 + 0.6 * hits / len(lines) >= 0.6


_LOG_WORDS = tuple("error fail fatal critical warn info debug trace".split())
_LOG_WORD = re.compile(f"(?i){'|'.join(_LOG_WORDS)}")
#: What a line begins with if it has a log pattern but no word and no traceback.
_LOG_START = re.compile(r"\s*(?:\d{4}-|\[\d|===|---|PASSED|FAILED|SKIPPED|npm |yarn |cargo |at\s)")


def _log_word(line: str) -> bool:
    if not line.isascii():
        return bool(_LOG_WORD.search(line))
    low = line.lower()
    return any(w in low for w in _LOG_WORDS)


@lru_cache(maxsize=4096)
def log_pattern(line: str) -> int | None:
    """Number of the first log pattern that a line has."""
    first = 0 if _log_word(line) else 3  # most lines have none of the words
    if first and not _LOG_START.match(line):  # nor the word Traceback, which has one of them
        return None
    return next((i for i, p in enumerate(LOG_LINE[first:], first) if (p.search if i < 3 else p.match)(line)), None)


_CODE_LINE = re.compile("|".join(p.pattern for p in CODE_LINE.values()))


@lru_cache(maxsize=4096)
def code_languages(line: str) -> tuple[str, ...]:
    if not _CODE_LINE.match(line):
        return ()
    return tuple(lang for lang, p in CODE_LINE.items() if p.match(line))


def is_log(text: str) -> bool:
    lines = [x for x in text.split("\n", 200)[:200] if not blank(x)]
    kinds = [k for k in map(log_pattern, lines) if k is not None]
    if not kinds or len(kinds) / len(lines) < 0.1:
        return False
    return 0.3 + 0.5 * len(kinds) / len(lines) + 0.05 * sum(k < 2 for k in kinds) >= 0.5


SOURCE_LIKE = re.compile(r"\s*(?:fn |let |const |function |use |pub |class |import |#include)|.*=>|.*\{$|\s*\}$")


def sentence(line: str) -> bool:
    return line.rstrip().endswith((".", "!", "?"))


def separator_row(line: str) -> bool:
    if "--" not in line:
        return False
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    cells = [c for c in cells if c]
    return len(cells) >= 2 and all(re.fullmatch(r":*-{2,}:*", c) for c in cells)


def delimiter_count(line: str, delimiter: str) -> int:
    return (re.sub(r'"(?:[^"]|"")*(?:"|$)', "", line) if '"' in line else line).count(delimiter)


def _in_parts(text: str, size: int = 100) -> Iterator[list[str]]:
    """Lines of a text, some at a time."""
    while True:
        *lines, text = text.split("\n", size)
        yield lines if len(lines) == size else [*lines, text]
        if len(lines) < size:
            return


def table_format(text: str) -> str | None:
    """``markdown``, a delimiter, or None."""
    lines = list(islice((x for part in _in_parts(text) for x in part if not blank(x)), 50))
    if len(lines) < 3 or sum(bool(SOURCE_LIKE.match(x)) for x in lines) >= 2:
        return None
    for above, below in zip(lines, lines[1:]) if "|" in text else ():
        if "|" in above and separator_row(below) and len(above.strip().strip("|").split("|")) >= 2:
            return "markdown"
    best = None
    for d in ",\t;|":
        if not delimiter_count(lines[0], d):
            continue
        counts = [delimiter_count(x, d) for x in lines]
        common, often = max(Counter(counts).items(), key=lambda x: (x[1], x[0]))
        share = often / len(lines)
        if common == 0 or share < (0.7 if d == "\t" else 0.85):
            continue
        cells = [c for x in lines for c in x.split(d)]
        if sum(sentence(x) for x in lines) / len(lines) >= 0.5 or sum(len(c.split()) for c in cells) / len(cells) > 3:
            continue
        score = int(share * 1000) + common
        if best is None or score > best[0]:
            best = (score, d)
    return best and best[1]


def _assignment(line: str) -> str | None:
    s = line.strip()
    if s[:1] in ("[", "#", ";"):
        return None
    for sep in "=:":
        key, found, value = s.partition(sep)
        if found and key.strip() and value.strip() and not re.search(r"\s", key.strip()):
            return sep
    return None


def yaml_key(line: str) -> bool:
    if ":" not in line:
        return False
    s = line.lstrip().removeprefix("- ")
    key, found, tail = s.partition(":")
    key = key.strip()
    return bool(found and key) and (not tail or tail[0].isspace()) and (key[0] in "\"'" or all(c.isalnum() or c in ".-_/" for c in key))


def yaml_item(line: str) -> bool:
    return bool(re.match(r"\s*-\s", line))


_SECTION = re.compile(r"\[+\s*[\w.\-\"' ]+?\s*\]+")


def config_flavor(text: str) -> str | None:
    """``yaml``, ``toml``, ``ini`` or None."""
    if text.lstrip()[:1] in ("", "{", "<"):
        return None
    lines = text.split("\n", 200)[:200]
    filled = [x for x in lines if not blank(x)]
    body = [x for x in filled if x.lstrip()[0] not in "#;"]
    if len(filled) < 3 or len(body) < 3:
        return None
    sections = sum(bool(_SECTION.fullmatch(x.strip())) for x in body if "[" in x)
    if sections:
        found = [s for s in map(_assignment, body) if s]
        if len(found) >= 2 and (sections + len(found)) / len(body) >= 0.6:
            return "ini" if any(x[0] == ";" for x in filled) or ":" in found else "toml"
    if lines[0].strip() == "---":
        close = next((i for i, x in enumerate(lines[1:60], 1) if x.strip() in ("---", "...")), None)
        tail = [x for x in lines[close + 1 :] if not blank(x)] if close else []
        if tail and sum(yaml_key(x) or yaml_item(x) for x in tail) / len(tail) < 0.3:
            return None
    keys = sum(map(yaml_key, body))
    if keys < 3:
        return None
    items, marks = sum(yaml_item(x) and not yaml_key(x) for x in body), sum(x.strip() in ("---", "...") for x in body)
    if (keys + items + marks) / len(body) < 0.6:
        return None
    if sum(sentence(x) for x in body) / len(body) >= 0.5 or sum(len(x.split()) for x in body) / len(body) > 8:
        return None
    indents = {len(x) - len(x.lstrip(" ")) for x in body if yaml_key(x) or yaml_item(x)}
    return "yaml" if len(indents) >= 2 or marks or items >= 3 else None


def code_language(text: str) -> tuple[str, float] | None:
    lines = [x.lstrip() for x in text.split("\n", 100)[:100]]
    hits: Counter[str] = Counter()
    for x in lines:
        if found := code_languages(x):
            hits.update(found)
    if not hits or max(hits.values()) < 3:
        return None
    lang, best = max(hits.items(), key=lambda x: x[1])  # of equals, the one that scored first
    filled = max(1, sum(not blank(x) for x in lines))
    return lang, min(1.0, 0.4 + 0.4 * best / filled + 0.02 * best)


def is_code(text: str) -> bool:
    found = code_language(text)
    return found is not None and found[1] >= 0.5


#: Order decides.
CASCADE = (
    (JSON, is_json), (DIFF, is_diff), (HTML, lambda t: html_confidence(t) >= 0.7), (SEARCH, is_search), (LOG, is_log),
    (TABLE, lambda t: table_format(t) is not None), (CONFIG, lambda t: config_flavor(t) is not None), (CODE, is_code),
)


def content_type(text: str) -> str:
    if blank(text):
        return PLAIN
    return next((kind for kind, found in CASCADE if found(text)), PLAIN)
