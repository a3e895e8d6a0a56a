"""Plain text: segments, relevance, salience, extractive selection, and conservative folding of repeated blocks."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from condensa.config import TEXT, TextConfig
from condensa.kernels.base import Context, Shrunk, Skip, nbytes, usable_path, with_gaps
from condensa.kernels.loglines import command_echo
from condensa.kernels.secret_tokens import has_secret

#: Scripts without spaces between words, words that make a segment salient, labels of decisions.
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0002fa1f"
SALIENT = frozenset("error exception failed failure fail warning traceback assert todo fixme".split())
DECISIONS = ("结论", "决定", "决策", "注意", "风险", "待办", "conclusion", "decision", "warning", "todo")
HARD_CUT, SOFT_CUT, SOFT_FROM = 40, 60, 20

_CJK = re.compile(f"[{CJK}]")
_TOKEN = re.compile(f"[{CJK}]|(?:(?![{CJK}])\\w)+")
_WORD = re.compile(r"\w+")
_CUT = re.compile(r"(?<=[.!?])\s|(?<=[。！？])")
_DIGIT = re.compile(r"\d")
_WIDE = re.compile("[\u3000\uff01-\uff5e]")
_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}


def segments(text: str) -> list[str]:
    """Sentences of each line: cut after . ! ? before white space, and after full-width ends; long CJK runs are cut."""
    out = []
    for line in text.split("\n"):
        for piece in _CUT.split(line.strip()):
            piece = piece.strip()
            if not piece:
                continue
            if len(piece) <= SOFT_CUT or piece.isascii() or not _CJK.search(piece):
                out.append(piece)
                continue
            run = ""
            for c in piece:
                run += c
                if len(run) >= HARD_CUT or (len(run) >= SOFT_FROM and (c.isspace() or c in "、，；：·…")):
                    out.append(run.strip())
                    run = ""
            out.append(run.strip())
    return [x for x in out if x]


def words(text: str) -> list[str]:
    if text.isascii():
        return _WORD.findall(text.lower())
    text = (text.translate(_FOLD) if _WIDE.search(text) else text).lower()
    return (_TOKEN if _CJK.search(text) else _WORD).findall(text)


def count_words(text: str) -> int:
    return len(words(text)) if not text.isascii() and _CJK.search(text) else len(text.split())


def relevance(docs: list[list[str]], query: str, config: TextConfig = TEXT) -> list[float]:
    """BM25 of each segment for the distinct words of the query, over its largest value."""
    asked = set(words(query))
    n = len(docs)
    if not n or not asked:
        return [0.0] * n
    df = Counter(w for d in docs for w in asked.intersection(d))
    idf = {w: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in asked}
    mean = max(1.0, sum(map(len, docs)) / n)
    out = []
    for d in docs:
        hits = [w for w in d if w in asked]
        tf = Counter(hits) if hits else {}
        out.append(sum(idf[w] * f * (config.k1 + 1) / (f + config.k1 * (1 - config.b + config.b * len(d) / mean)) for w, f in sorted(tf.items())))
    top = max(out)
    return [x / top for x in out] if top > 0 else out


def relevance_alone(query: str, document: str, config: TextConfig = TEXT) -> float:
    """BM25 of one document that is the whole corpus; words of the query count as often as they stand in it."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    own = Counter(cut(document))
    n = sum(own.values())
    out = 0.0
    for w in cut(query):
        if own[w]:
            # one document, which has the word: its frequency in the corpus is 1, and its length is the mean
            out += math.log(0.5 / 1.5 + 1) * own[w] * (config.k1 + 1) / (own[w] + config.k1 * (1 - config.b + config.b * n / max(1.0, n)))
    return out


def rank(query: str, documents: list[str]) -> list[int]:
    """Documents by relevance, the first of equals first."""
    return sorted(range(len(documents)), key=lambda i: -relevance_alone(query, documents[i]))


@lru_cache(maxsize=65536)
def salient(word: str) -> bool:
    return bool(_DIGIT.search(word)) or word.strip("_") in SALIENT


def shingles(tokens: list[str], k: int = 3) -> set[tuple[str, ...]]:
    if len(tokens) >= k:
        return set(zip(*(tokens[i:] for i in range(k))))
    sizes = range(1, len(tokens) + 1)
    return {tuple(tokens[i : i + n]) for n in sizes for i in range(len(tokens) - n + 1)}


@dataclass
class Selection:
    text: str
    kept: int
    total: int
    lines: list[int]
    tokens_before: int = 0
    tokens_after: int = 0


def extract(text: str, query: str = "", ratio: float | None = None, config: TextConfig = TEXT, max_tokens: int | None = None) -> Selection:
    """Best segments up to a share of the bytes; those with secrets stay, those that the kept ones cover go."""
    ratio = min(1.0, max(0.05, config.ratio if ratio is None else ratio))
    placed = [(i, s) for i, line in enumerate(text.split("\n")) for s in segments(line)]
    n = len(placed)
    if n < config.min_segments:
        return Selection(text, n, n, list(range(len(text.splitlines()))))
    texts = [s for _, s in placed]
    docs = [words(s) for s in texts]
    sizes = [nbytes(s) for s in texts]
    near = relevance(docs, query, config)
    target = max(1, int(sum(sizes) * ratio))

    def score(i: int) -> float:
        share = sum(map(salient, docs[i])) / (len(docs[i]) + 1)
        out = config.recency * (i + 1) / n + config.relevance * near[i] + config.salience * share
        return out * 0.25 if sizes[i] < config.short_bytes else out

    kept = {i for i in range(n) if has_secret(texts[i])}
    seen = set().union(*(shingles(docs[i]) for i in kept))
    used, used_tokens = sum(sizes[i] for i in kept), sum(len(docs[i]) for i in kept)
    for i in sorted(range(n), key=lambda i: (-score(i), i)):
        if i in kept:
            continue
        if used >= target or (max_tokens is not None and used_tokens >= max_tokens):
            break
        own = shingles(docs[i])
        if own and len(own & seen) / len(own) >= config.near_dup:
            continue
        kept.add(i)
        seen |= own
        used += sizes[i]
        used_tokens += len(docs[i])
    if not kept:
        return Selection(text, n, n, list(range(len(text.splitlines()))))
    order = sorted(kept)
    return Selection("\n".join(texts[i] for i in order), len(kept), n, [placed[i][0] for i in order])


def _fence(line: str) -> tuple[str, int] | None:
    m = re.match(r"\s*(`{3,}|~{3,})", line)
    return m and (m[1][0], len(m[1]))


def _heading(line: str) -> bool:
    s = line.strip()
    return bool(re.match(r"#{1,6}\s", s)) or s.endswith((":", "："))


def _underline(line: str) -> bool:
    return bool(re.fullmatch(r"\s*(?:={3,}|-{3,})\s*", line))


def _speaker(line: str) -> str | None:
    m = re.match(r"([\w \-]{1,32})[:：](?![/\\])", line)
    return m and m[1]


def fold_blocks(text: str) -> Selection:
    """Drop paragraphs, list items and turns that repeat exactly within a section; headings, code and decisions stay."""
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    n, i = len(lines), 0
    keep, seen = [True] * n, set()
    total = kept = 0
    while i < n:
        if not lines[i].strip():
            i += 1
            continue
        start, fence = i, _fence(lines[i])
        heading = not fence and (_heading(lines[i]) or (i + 1 < n and _underline(lines[i + 1])))
        i += 1
        if fence:
            while i < n:
                body = lines[i].strip()
                i += 1
                if set(body) == {fence[0]} and len(body) >= fence[1]:
                    break
        elif heading:
            i += i < n and _underline(lines[i])
            seen = set()
        else:
            who = _speaker(lines[start])
            while i < n and lines[i].strip():
                line = lines[i]
                if _heading(line) or _fence(line) or (i + 1 < n and _underline(lines[i + 1])):
                    break
                if line[0] not in " \t" and (re.match(r"(?:[-*+]|\d+[.)]) ", line) or (_speaker(line) and _speaker(line) != who)):
                    break
                i += 1
        end = i
        while i < n and not lines[i].strip():
            i += 1
        block = "".join(lines[start:end])
        decided = any(re.match(f"\\s*(?:{'|'.join(DECISIONS)})[:：]", x.lower()) or command_echo(x) for x in lines[start:end])
        total += 1
        key = block.rstrip("\r\n")
        if heading or fence or decided or has_secret(block) or key not in seen:
            if not (heading or fence or decided):
                seen.add(key)
            kept += 1
        else:
            keep[start:i] = [False] * (i - start)
    return Selection("".join(x for x, k in zip(lines, keep) if k), kept, total, [j for j, k in enumerate(keep) if k])


def bloat(text: str) -> float:
    """Share of the bytes that the conservative mode would leave out."""
    return 1 - nbytes(fold_blocks(text).text) / max(1, nbytes(text)) if text else 0.0


def shrink_text(text: str, ctx: Context, conservative: bool = False, ratio: float | None = None, config: TextConfig = TEXT) -> Shrunk:
    conservative, ratio = conservative or ctx.conservative, ctx.ratio if ratio is None else ratio
    got = fold_blocks(text) if conservative else extract(text, ctx.query, ratio, config)
    if got.kept >= got.total or got.text == text:
        raise Skip
    if conservative and usable_path(ctx.stash_path):
        return with_gaps(text, set(got.lines), ctx.stash_path, ctx.line_offset)
    return Shrunk(got.text, info={"kept": got.kept, "total": got.total, "tokens_before": count_words(text), "tokens_after": count_words(got.text)})
