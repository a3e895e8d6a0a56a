"""Custom tags are taken out before a block is shrunk, and put back afterwards."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Element names of HTML, which are never protected.
HTML_NAMES = frozenset(
    """a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup
    data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head
    header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol
    optgroup option output p param picture portal pre progress q rp rt ruby s samp script search section select slot small source span
    strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr math""".split()
)
TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)((?:\s+(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?)(/?)>")
#: What stands for a tag: a salt of digits and underscores, and a number.
PLACEHOLDER = re.compile(r"\{\{CMPR_TAG_[0-9_]*[0-9]\}\}")


@dataclass
class Protected:
    text: str
    wraps: dict[str, str] = field(default_factory=dict)
    tags_seen: int = 0
    html_skipped: int = 0
    blocks: int = 0
    self_closing: int = 0
    orphan_closes: int = 0
    collision: bool = False


def protect(text: str, only: frozenset[str] | None = None, markers_only: bool = False) -> Protected:
    """Replace each outermost custom tag with all that it holds by a placeholder.

    ``only``: protect these names alone. ``markers_only``: replace the opening and closing tags, not what is between.
    """
    out = Protected(text)
    if "<" not in text:
        return out
    salt, tries = "", 0
    while f"{{{{CMPR_TAG_{salt}" in text and tries < 16:
        salt, tries, out.collision = f"{tries}_", tries + 1, True
    stack: list[tuple[str, int, int]] = []
    spans: list[tuple[int, int]] = []
    for m in TAG.finditer(text):
        closing, name, attrs, slash = m.groups()
        out.tags_seen += 1
        if name.lower() in HTML_NAMES or (only is not None and name not in only):
            out.html_skipped += 1
            continue
        if slash or attrs.rstrip().endswith("/"):
            out.self_closing += 1
            spans.append(m.span())
        elif not closing:
            stack.append((name, *m.span()))
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is None:
                out.orphan_closes += 1
                continue
            _, start, end = stack[at]
            del stack[at:]
            out.blocks += 1
            spans += [(start, end), m.span()] if markers_only else [(start, m.end())]
    merged: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not merged or s >= merged[-1][1]:
            merged.append((s, e))
    parts, last = [], 0
    for n, (s, e) in enumerate(merged):
        name = f"{{{{CMPR_TAG_{salt}{n}}}}}"
        out.wraps[name] = text[s:e]
        parts += [text[last:s], name]
        last = e
    out.text = "".join([*parts, text[last:]])
    return out


def restore(text: str, wraps: dict[str, str]) -> str:
    """Put the wraps back; those whose placeholder is gone are gone with it."""
    if not wraps:
        return text
    return PLACEHOLDER.sub(lambda m: wraps.get(m[0], m[0]), text)
