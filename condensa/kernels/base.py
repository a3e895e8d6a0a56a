"""What every kernel needs: keys, markers, token estimates, JSON that keeps its literals, gap rendering."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from condensa.config import GATES, STASH

MARKER = re.compile(r"<<stash:[0-9a-fA-F]{24}>>")


class Skip(Exception):
    """The operator has nothing to gain on this input."""


@dataclass
class Shrunk:
    """What a kernel returns: the text, ranges left out (first line from 1, lines), values to stash for markers in it."""

    text: str
    omissions: list[tuple[int, int]] = field(default_factory=list)
    deferred: list[tuple[str, str]] = field(default_factory=list)
    info: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Context:
    query: str = ""
    source_path: str | None = None
    #: Path of the stashed original; with it, kernels leave hints of the lines left out.
    stash_path: str | None = None
    line_offset: int = 0
    #: Plain text: leave out exact repeats only; else keep this share of the bytes (the default of the extraction).
    conservative: bool = False
    ratio: float | None = None


def nbytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def tokens(text: str) -> int:
    return math.ceil(nbytes(text) / GATES.bytes_per_token * GATES.token_margin)


def stash_key(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[: STASH.key_chars]


def marker(key: str) -> str:
    return f"<<stash:{key}>>"


class Num(str):
    """A JSON number as it was written."""

    __slots__ = ()

    @property
    def value(self) -> float:
        return float(self)

    @property
    def whole(self) -> bool:
        return bool(re.fullmatch(r"-?\d+", self)) and -(2**63) <= int(self) < 2**64


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=Num, parse_int=Num, parse_constant=_no_constant)


def loads(text: str):
    """Parse JSON; numbers keep their literals. Raises ValueError."""
    try:
        return _DECODER.decode(text)
    except RecursionError as e:
        raise ValueError("too deep") from e


def loads_prefix(text: str, at: int = 0):
    """First JSON value from ``at`` on, and where it ends."""
    try:
        return _DECODER.raw_decode(text, at)
    except RecursionError as e:
        raise ValueError("too deep") from e


def dumps(value) -> str:
    """Compact JSON in the order of the input."""
    if isinstance(value, Num):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)


def canonical(value) -> str:
    """JSON with sorted keys, for comparing contents."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return dumps(value)


def usable_path(path: str | None) -> bool:
    return bool(path) and "\r" not in path and "\n" not in path


def hint(path: str, first: int, count: int, offset: int = 0) -> str:
    return f"{count} lines omitted from file {json.dumps(path, ensure_ascii=False)}, starting at line {first + offset}"


def with_gaps(text: str, kept: set[int], path: str, offset: int = 0) -> Shrunk:
    """Kept lines, and a hint for each gap that is longer than its hint."""
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    out, gaps, i = [], [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and j not in kept:
            j += 1
        if j > i:
            note = f"[... {hint(path, i + 1, j - i, offset)}]\n"
            gap = "".join(lines[i:j])
            if nbytes(note) < nbytes(gap):
                out.append(note)
                gaps.append((i + 1, j - i))
            else:
                out.append(gap)
            i = j
        else:
            out.append(lines[i])
            i += 1
    return Shrunk("".join(out), gaps)


def rust_lines(text: str) -> list[str]:
    """Lines without their ends; no empty line after a last newline, no carriage return before a newline."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
        return [p.removesuffix("\r") for p in parts]
    return [p.removesuffix("\r") for p in parts[:-1]] + parts[-1:]
