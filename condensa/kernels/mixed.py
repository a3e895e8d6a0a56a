"""Blocks of several kinds: cut into sections of one kind, and JSON within text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from condensa.kernels.base import loads_prefix, nbytes
from condensa.kernels.detect import JSON, content_type

LEAST_SPAN, LOOKS_AT = 512, 500


@dataclass
class Section:
    text: str
    kind: str
    first: int
    last: int


def _json_at(text: str, at: int) -> int | None:
    """End of the JSON container that starts at an offset.

    Tried on a part of the text that grows, so that a bracket that opens nothing costs little, wherever it stands.
    """
    size = 4096
    while True:
        part = text[at : at + size]
        try:
            value, end = loads_prefix(part)
            return at + end if isinstance(value, (dict, list)) else None
        except json.JSONDecodeError as e:
            cut_off = e.msg.startswith("Unterminated string") or e.pos >= len(part) - 16
            if at + size >= len(text) or not cut_off:
                return None
        except ValueError:
            return None
        size *= 4


def sections(text: str) -> list[Section]:
    """JSON values at the start of a line, and runs of lines between them whose kind does not change."""
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    out, i, n = [], 0, len(lines)
    opens = [x.lstrip()[:1] in ("[", "{") and x.strip() != "" for x in lines]
    while i < n:
        if opens[i]:
            at = starts[i] + len(lines[i]) - len(lines[i].lstrip())
            end = _json_at(text, at)
            if end is not None:
                last = i + text.count("\n", at, end)
                out.append(Section(text[at:end], JSON, i, last))
                i = last + 1
                continue
        kind, j, seen = content_type(lines[i]), i + 1, i + 1
        inner = None
        while j < n and not opens[j]:
            if j - i <= LOOKS_AT:
                if lines[j].strip():
                    if content_type("\n".join(lines[i : j + 1])) != kind:
                        break
                    seen = j + 1
            else:
                # no detector but that of JSON looks beyond so many lines, and it looks at the first container only
                if inner is None:
                    first = _OPENER.search(text, starts[i])
                    end = _json_at(text, first.start()) if first else None
                    inner = (end, nbytes(text[first.start() : end])) if end else (0, 0)
                    size = sum(nbytes(x) + 1 for x in lines[i:j])
                end, own = inner
                size += nbytes(lines[j]) + 1
                if lines[j].strip() and (0 < end <= starts[j + 1] and own >= (size - 1) * 3 // 5) != (kind == JSON):
                    break
            j += 1
        body = "\n".join(lines[i:j])
        out.append(Section(body, kind if seen == j else content_type(body), i, j - 1))
        i = j
    return out


_OPENER = re.compile(r"[{\[]")


def json_spans(text: str) -> list[tuple[int, int]]:
    """Outermost JSON containers of some size, wherever they start."""
    out, at = [], 0
    while (m := _OPENER.search(text, at)) is not None:
        end = _json_at(text, m.start())
        if end is not None and nbytes(text[m.start() : end]) >= LEAST_SPAN:
            out.append((m.start(), end))
            at = end
        else:
            at = m.start() + 1
    return out


def replace_spans(text: str, shrink: Callable[[str], str | None]) -> tuple[str, bool]:
    parts, last, any_ = [], 0, False
    for a, b in json_spans(text):
        got = shrink(text[a:b])
        parts += [text[last:a], text[a:b] if got is None else got]
        last, any_ = b, any_ or got is not None
    return "".join([*parts, text[last:]]), any_


