"""Delimited and Markdown tables: parsed strictly, then crushed as records."""

from __future__ import annotations

import re

from condensa.kernels.base import Context, Shrunk, Skip, dumps, nbytes, rust_lines
from condensa.kernels.detect import separator_row, table_format
from condensa.kernels.jsoncrush import shrink_json


def parse_delimited(text: str, delimiter: str) -> list[list[str]]:
    """Rows of trimmed cells; quoted cells may hold delimiters and line ends; blank rows are left out."""
    d = re.escape(delimiter)
    cell = re.compile(rf"[^\S\n]*\"((?:[^\"]|\"\")*)\"([^{d}\n]*)|([^{d}\n]*)")
    rows: list[list[str]] = []
    row: list[str] = []
    at = 0
    while at <= len(text):
        m = cell.match(text, at)
        if m[1] is None and m[3].lstrip().startswith('"'):
            raise Skip  # a quote that does not end
        row.append((m[1].replace('""', '"') + m[2] if m[1] is not None else m[3]).strip())
        at = m.end()
        if at >= len(text) or text[at] == "\n":
            if any(row):
                rows.append(row)
            row = []
        at += 1
    return rows


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def parse_markdown(text: str) -> list[list[str]]:
    lines = [x for x in rust_lines(text) if x.strip()]
    at = next((i for i, (a, b) in enumerate(zip(lines, lines[1:])) if "|" in a and separator_row(b)), None)
    if at is None or any("\\|" in x for x in lines[at:]):
        raise Skip
    return [_cells(lines[at]), *map(_cells, lines[at + 2 :])]


def parse_table(text: str) -> list[dict[str, str]]:
    kind = table_format(text)
    if kind is None:
        raise Skip
    head, *rows = (parse_markdown(text) if kind == "markdown" else parse_delimited(text, kind)) or [[]]
    if len(head) < 2 or not rows or not all(head) or len(set(head)) < len(head) or any(len(r) != len(head) for r in rows):
        raise Skip
    return [dict(zip(head, r, strict=True)) for r in rows]


def shrink_table(text: str, ctx: Context) -> Shrunk:
    rows = parse_table(text)
    got = shrink_json(dumps(rows), ctx)
    if nbytes(got.text) >= nbytes(text):
        raise Skip
    return got


