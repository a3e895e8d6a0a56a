"""Source code: bodies of long functions keep their first whole statements; signatures, types and imports stay.

Python is parsed; the brace languages are scanned for strings, comments and brackets. Where the scan is in doubt, the
code is left as it is.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from dataclasses import dataclass

from condensa.config import CODE, CodeConfig
from condensa.kernels.base import Context, Shrunk, Skip, hint, tokens, usable_path
from condensa.kernels.detect import path_language

BRACES = frozenset("javascript typescript go rust java c cpp".split())
#: Languages in which a line end can end a statement.
LINE_ENDS = frozenset("javascript typescript go".split())
_CONTAINER = re.compile(r"(?:^|[\s;])(?:class|interface|impl|trait|mod|namespace|struct|union|enum|module|extern)\b[^()=]*$|\bextern\s+\"C\"\s*$")
_SCANNED = re.compile(r"\b(?:class|impl|trait|mod|namespace|interface|module)\b")
_CONTROL = re.compile(r"^(?:\}\s*)?(?:if|for|while|switch|match|catch|else|do|try|loop|unsafe|select|return|with|synchronized)\b")
_FUNCTION = re.compile(r"\)[^;{}=]*$|=>\s*$|\)\s*(?:->|:)[^;{}]*$")


def language(code: str) -> str | None:
    """Guess from typical words, in this order."""
    has = lambda *ws: any(w in code for w in ws)
    if re.search(r"(?m)^package ", code) and has("func "):
        return "go"
    if has("fn ", "let mut ", "impl "):
        return "rust"
    if has("def ") and not has("function "):
        return "python"
    if has("public class ", "System.out.println"):
        return "java"
    if has("#include <"):
        return "cpp" if has("std::", "class ") else "c"
    if has("interface ", ": string", ": number"):
        return "typescript"
    return "javascript" if has("function ", "const ", "=>") else None


@dataclass
class Function:
    """Rows, from 0: of all, of the body's brackets or first and last row, of its statements, of its docstring."""

    start: int
    end: int
    body_start: int
    body_end: int
    statements: list[tuple[int, int]]
    docstring: tuple[int, int] | None = None


def python_functions(tree: ast.Module) -> list[Function]:
    out: list[Function] = []

    def visit(nodes: list[ast.stmt]) -> None:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body, doc = list(n.body), None
                if isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
                    doc = (body[0].lineno - 1, body[0].end_lineno - 1)
                    body = body[1:]
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
                rows = [(min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", []))]) - 1, s.end_lineno - 1) for s in body]
                out.append(Function(first, n.end_lineno - 1, n.body[0].lineno - 1, n.end_lineno - 1, rows, doc))
            elif isinstance(n, ast.ClassDef):
                visit(n.body)
            else:
                for part in ("body", "orelse", "finalbody"):
                    visit([s for s in getattr(n, part, []) if isinstance(s, ast.stmt)])

    visit(tree.body)
    return out


def blanked(code: str, lang: str) -> str | None:
    """The code with strings and comments as spaces; None if one does not end."""
    quote = {"rust": r"'(?:\\.[^']*|[^\\'])'", "go": r"'(?:\\.|[^'\\\n])*'|`[^`]*`"}.get(lang, r"'(?:\\.|[^'\\\n])*'")
    if lang in ("javascript", "typescript"):
        quote += r"|`(?:\\.|[^`\\])*`"
    if lang == "rust":
        quote = r"r(#*)\".*?\"\1|" + quote
    if lang == "java":
        quote = r"\"\"\".*?\"\"\"|" + quote
    pattern = re.compile(rf"//[^\n]*|/\*.*?\*/|{quote}|\"(?:\\.|[^\"\\])*\"", re.S)
    out = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    return None if "/*" in out or '"' in out or "`" in out else out


def parsed(code: str, lang: str) -> ast.Module | str | None:
    """The tree of Python, or the blanked text of other code; None if something in it is not closed."""
    if lang == "python":
        try:
            return ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return None
    plain = blanked(code, lang)
    return plain if plain is not None and _closed(plain) else None


def balanced(code: str, lang: str) -> bool:
    return parsed(code, lang) is not None


def _closed(plain: str) -> bool:
    stack, pair = [], {")": "(", "]": "[", "}": "{"}
    for c in re.findall(r"[()\[\]{}]", plain):
        if c in pair:
            if not stack or stack.pop() != pair[c]:
                return False
        else:
            stack.append(c)
    return not stack


def _match(plain: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


_AFTER_BRACE = re.compile(r"\s*(?:else\b|catch\b|finally\b|while\b|[;,).?]|\()")
_AFTER_LINE = re.compile(r"\s*[.)\]}+*/&|?:]")
_STOP, _FILLED = re.compile(r"[()\[\]{};\n]"), re.compile(r"\S")


def _statements(plain: str, start: int, end: int, lang: str) -> list[tuple[int, int]]:
    """Offsets of the first and last character of each statement between two offsets."""
    out, first, depth, last = [], None, 0, ""
    since = before = start
    for m in _STOP.finditer(plain, start, end):
        i, c = m.start(), m[0]
        if first is None:
            filled = _FILLED.search(plain, since, i + 1)
            first, since = filled and filled.start(), i + 1
        if gap := plain[before:i].rstrip():
            last = gap[-1]
        before = i
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        done = False
        if depth == 0 and first is not None:
            if c == ";":
                done = True
            elif c == "}":
                done = not _AFTER_BRACE.match(plain, i + 1, end) and not re.search(r"=>?\s*$|=\s*\w*\s*$", plain[first : plain.rfind("{", first, i)])
            elif c == "\n" and lang in LINE_ENDS:
                done = last not in ",+-*/=&|([{.?:<>" and not _AFTER_LINE.match(plain, i + 1, end)
        if done:
            out.append((first, i if c != "\n" else i - 1))
            first, since = None, i + 1
    if first is None and (filled := _FILLED.search(plain, since, end)):
        first = filled.start()
    if first is not None and plain[first:end].strip():
        out.append((first, start + len(plain[start:end].rstrip()) - 1))
    return out


def brace_functions(plain: str, lang: str) -> list[Function]:
    """Of code as ``parsed`` gives it."""
    ends = [m.start() for m in re.finditer("\n", plain)]
    row = lambda at: bisect_left(ends, at)
    out: list[Function] = []

    def visit(at: int, end: int) -> None:
        since = at
        while (m := re.compile(r"[;{}]").search(plain, at, end)) is not None:
            at = m.start()
            if plain[at] != "{":
                at += 1
                since = at
                continue
            head = plain[since:at].strip()
            close = _match(plain, at)
            if _CONTAINER.search(head) and not re.search(r"\)\s*$", head):
                if _SCANNED.search(head):
                    visit(at + 1, close)
            elif _FUNCTION.search(head) and not _CONTROL.match(head):
                began = since + len(plain[since:at]) - len(plain[since:at].lstrip())
                rows = [(row(a), row(b)) for a, b in _statements(plain, at + 1, close, lang)]
                out.append(Function(row(began), row(close), row(at), row(close), rows))
            at = close + 1
            since = at

    visit(0, len(plain))
    return out


def _short_docstring(lines: list[str], start: int, end: int) -> str:
    first = lines[start]
    if start == end:
        return first
    m = re.match(r"(\s*)(r?(\"\"\"|'''))(.*)", first)
    if not m:
        return first
    text = m[4].strip().removesuffix(m[3]).strip() or lines[start + 1].strip().removesuffix(m[3]).strip()
    return f"{m[1]}{m[2]}{text}{m[3]}" if text else first


def fold(code: str, path: str | None = None, ctx: Context = Context(), config: CodeConfig = CODE) -> Shrunk:
    before = tokens(code)
    if not code.strip() or before < config.min_tokens:
        raise Skip
    lang = path_language(path) or language(code)
    known = parsed(code, lang) if lang else None
    if known is None:
        raise Skip
    found = python_functions(known) if lang == "python" else brace_functions(known, lang)
    lines = code.split("\n")
    if code.endswith("\n"):
        lines.pop()
    out: list[str] = []
    gaps: list[tuple[int, int]] = []
    mark = "#" if lang == "python" else "//"
    at = folded = 0

    def left_out(first: int, last: int, indent: str) -> None:
        n = last - first + 1
        note = hint(ctx.stash_path, first + 1, n, ctx.line_offset) if usable_path(ctx.stash_path) else f"{n} lines omitted"
        out.append(f"{indent}{mark} ... {note}")
        gaps.append((first + 1, n))

    indent_of = lambda i: re.match(r"\s*", lines[i])[0]
    for f in sorted(found, key=lambda f: (f.start, f.end)):
        if f.start < at:
            continue
        out += lines[at : f.start]
        at = f.end + 1
        if f.end - f.start + 1 <= config.body_lines + 2:
            out += lines[f.start : at]
            continue
        keep_to, used = (f.body_start - 1 if lang == "python" else f.body_start), 0
        for a, b in f.statements:
            if used and used + b - a + 1 > config.body_lines:
                break
            keep_to, used = max(keep_to, b), used + b - a + 1
        closing = f.body_end if lang != "python" else f.end + 1
        seen = len(gaps)
        if f.docstring:
            a, b = f.docstring
            out += [*lines[f.start : a], _short_docstring(lines, a, b)]
            if b > a:
                left_out(a, b, indent_of(a))
            keep_to = max(keep_to, b)
            out += lines[b + 1 : min(keep_to, f.end) + 1]
        else:
            out += lines[f.start : min(keep_to, f.end) + 1]
        first, last = keep_to + 1, min(closing - 1, f.end)
        if last >= first:
            left_out(first, last, indent_of(first))
        out += lines[max(closing, keep_to + 1) : f.end + 1]
        folded += len(gaps) > seen
    out += lines[at:]
    made = "\n".join(out) + "\n"
    after = tokens(made)
    if not folded or not balanced(made, lang) or after / before < config.min_ratio or after >= before:
        raise Skip
    return Shrunk(made, gaps, info={"language": lang, "tokens_before": before, "tokens_after": after, "bodies_folded": folded})


def shrink_code(text: str, ctx: Context) -> Shrunk:
    return fold(text, ctx.source_path, ctx)
