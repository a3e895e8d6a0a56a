"""HTML pages: the main fragment as Markdown."""

from __future__ import annotations

import re

from condensa.kernels.base import Context, Shrunk, Skip, nbytes

# Elements that are left out whole, entities in the order in which they are replaced.
NOISE = frozenset("script style nav header footer aside form noscript svg canvas template".split())
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+)|(<)", re.S)
HEADINGS = {f"h{i}": i for i in range(1, 7)}


def main_fragment(page: str) -> str:
    """Content of the first article, else main, else body, up to the first end tag; else the page."""
    for tag in ("article", "main", "body"):
        m = re.search(rf"(?is)<{tag}(?=[>/ \t\n\r])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(.*?)</{tag}", page)
        if m:
            return m[1]
    return page


def decoded(text: str) -> str:
    for name, char in ENTITIES:
        text = text.replace(name, char)
    return text


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"(?i)(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", tag)
    return m and decoded(next(x for x in m.groups() if x is not None))


class Writer:
    def __init__(self) -> None:
        self.out = ""

    def breaks(self, n: int) -> None:
        self.out = self.out.rstrip(" ")
        have = len(self.out) - len(self.out.rstrip("\n"))
        self.out += "\n" * max(0, n - have)

    def text(self, raw: str, pre: bool) -> None:
        raw = decoded(raw)
        if pre:
            self.out += raw.strip()
            return
        words = " ".join(raw.split())
        if words:
            self.out += ("" if self.out[-1:] in ("", " ", "\n", "[", "*", "`") else " ") + words
        if raw[-1:].isspace() and self.out[-1:] not in ("", " ", "\n"):
            self.out += " "


def markdown(fragment: str, tables: bool = True, links: bool = True, images: bool = False) -> str:
    w, skipped, open_links, pre = Writer(), [], [], False
    for m in PIECE.finditer(fragment):
        tag, text, lone = m.groups()
        if lone:
            break
        if text is not None:
            if not skipped:
                w.text(text, pre)
            continue
        if tag is None:
            continue
        tag = tag.strip()
        closing = tag.startswith("/")
        name = re.match(r"/*\s*([A-Za-z0-9-]*)", tag)[1].lower()
        if not name:
            continue
        if name in NOISE:
            if closing:
                if skipped[-1:] == [name]:
                    skipped.pop()
            elif not tag.endswith("/"):
                skipped.append(name)
            continue
        if skipped:
            continue
        if name in ("strong", "b"):
            w.out += "**"
        elif name in ("em", "i"):
            w.out += "*"
        elif name == "code":
            w.out += "" if pre else "`"
        elif name == "pre":
            if closing:
                w.out += "\n```\n"
                w.breaks(2)
            else:
                w.breaks(2)
                w.out += "```\n"
            pre = not closing
        elif name == "a":
            if closing:
                href = open_links.pop() if open_links else None
                w.out += f"]({href})" if href is not None else ""
            else:
                open_links.append(attribute(tag, "href") if links else None)
                w.out += "[" if open_links[-1] is not None else ""
        elif name in HEADINGS:
            w.breaks(2)
            w.out += "" if closing else "#" * HEADINGS[name] + " "
        elif name in ("p", "blockquote", "section", "div") or (closing and name in ("ul", "ol", "table")):
            w.breaks(2)
        elif name == "li":
            w.breaks(1)
            w.out += "" if closing else "- "
        elif name == "br" and not closing:
            w.breaks(1)
        elif name == "tr":
            if closing or tables:
                w.breaks(1)
            w.out += "|" if tables and not closing else ""
        elif name in ("td", "th") and tables:
            w.out += " |" if closing else " "
        elif name == "img" and images and not closing and attribute(tag, "alt") is not None:
            w.out += f"![{attribute(tag, 'alt')}]({attribute(tag, 'src') or ''})"
    return w.out.strip()


def shrink_html(text: str, ctx: Context) -> Shrunk:
    made = markdown(main_fragment(text))
    if not made.strip() or nbytes(made) >= nbytes(text):
        raise Skip
    return Shrunk(made)
