"""Search results: ``file:line:content`` lines, scored and capped by file and in total."""

from __future__ import annotations

import re
from dataclasses import dataclass

from condensa.config import SEARCH, SearchConfig
from condensa.kernels.base import Context, Shrunk, Skip, nbytes, rust_lines, stash_key, usable_path, with_gaps

# Words that raise the score of a match.
ERRORS = "error exception fatal critical crash panic failed failure".split()
WARNINGS = "warning warn deprecated caution".split()
_CJK_RUN = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]{2,}")
_EXTENSION = re.compile(r"\.(?=[A-Za-z0-9]{1,8}(?![A-Za-z0-9]))[0-9]*[A-Za-z]")


def any_word(text: str, words: list[str]) -> bool:
    """One of the words, or its plural, stands in the lower-cased text between other characters than letters and digits."""
    return bool(re.search(r"(?<![a-z0-9])(?:" + "|".join(words) + r")s?(?![a-z0-9])", text, re.A))


def bigrams(text: str) -> set[str]:
    return {run[i : i + 2] for run in _CJK_RUN.findall(text) for i in range(len(run) - 1)}


def _extension(path: str) -> bool:
    return bool(_EXTENSION.search(re.split(r"[/\\]", path)[-1]))


def _more_path(rest: str) -> bool:
    word = (rest.split() or [""])[0]
    return "/" in word or "\\" in word or bool(_EXTENSION.search(word))


def parse_hit(line: str) -> tuple[str, int, str] | None:
    """Path, line number and content; with colons, with dashes (context lines), or with either after a path with spaces."""
    skip = 2 if re.match(r"[A-Za-z]:[\\/]", line) else 0
    for sep, loose in ((":", False), ("-", False), ("[:-]", True)):
        close = "[:-]" if loose else sep
        first = None
        for m in re.compile(rf"(?<![:-]){sep}(\d+){close}").finditer(line, skip):
            at = m.start()
            if not loose and re.search(r"\s", line[:at], re.A):
                break
            if at == 0:
                first = None
                break
            first = first or m
            if sep != "-" or _extension(line[:at]) or not _more_path(line[m.end() :]):
                return line[:at], int(m[1]), line[m.end() :]
        if first:
            return line[: first.start()], int(first[1]), line[first.end() :]
    return None


@dataclass
class Hit:
    file: str
    line: int
    text: str
    at: int
    score: float = 0.0


def parse(text: str) -> tuple[dict[str, list[Hit]], list[int]]:
    """Hits by file, and the lines that are none."""
    files: dict[str, list[Hit]] = {}
    other = []
    for i, x in enumerate(rust_lines(text)):
        got = parse_hit(x.strip()) if x.strip() else None
        if got:
            files.setdefault(got[0], []).append(Hit(*got, i))
        else:
            other.append(i)
    return dict(sorted(files.items())), other


def score(hits: list[Hit], query: str, keywords: tuple[str, ...] = ()) -> None:
    asked = query.lower()
    wanted = {w for w in asked.split() if len(w) > 2} | bigrams(asked)
    for h in hits:
        low = h.text.lower()
        s = 0.3 * sum(w in low for w in wanted) + 0.4 * sum(k.lower() in low for k in keywords)
        s += 0.5 if any_word(low, ERRORS) else 0.4 if any_word(low, WARNINGS) else 0.0
        h.score = min(1.0, round(s, 6))


def select(files: dict[str, list[Hit]], config: SearchConfig = SEARCH) -> dict[str, list[Hit]]:
    ranked = sorted(files.items(), key=lambda f: (-round(sum(h.score for h in f[1]), 6), f[0]))[: config.files]
    left = min(sum(len(h) for _, h in ranked), config.total)
    out = {}
    for file, hits in ranked:
        if left <= 0:
            break
        order = [hits[0], hits[-1], *sorted(hits, key=lambda h: (-h.score, h.line))]
        distinct: dict[tuple[int, str], Hit] = {}
        for h in order:
            distinct.setdefault((h.line, h.text), h)
        take = sorted(list(distinct.values())[: min(config.per_file, left)], key=lambda h: h.line)
        out[file] = take
        left -= len(take)
    return dict(sorted(out.items()))


def shrink_search(text: str, ctx: Context, config: SearchConfig = SEARCH, grouped: bool = False) -> Shrunk:
    files, other = parse(text)
    if not files:
        raise Skip
    for hits in files.values():
        score(hits, ctx.query)
    chosen = select(files, config)
    if usable_path(ctx.stash_path):
        return with_gaps(text, {h.at for hits in chosen.values() for h in hits} | set(other), ctx.stash_path, ctx.line_offset)
    out: list[str] = []
    for file, hits in chosen.items():
        if grouped:
            out += [*[""] * bool(out), file, *(f"{h.line}:{h.text}" for h in hits)]
        else:
            out += [f"{file}:{h.line}:{h.text}" for h in hits]
        left = len(files[file]) - len(hits)
        if left > 0:
            out.append(f"[... and {left} more matches{'' if grouped else f' in {file}'}]")
    made = "\n".join(out)
    n, m = sum(map(len, files.values())), sum(map(len, chosen.values()))
    if n >= config.min_matches and nbytes(made) / max(1, nbytes(text)) < config.marker_below:
        made += f"\n[{n} matches compressed to {m}. Retrieve more: hash={stash_key(text)}]"
    gone = {f: len(h) for f, h in files.items() if f not in chosen}
    info = {"matches": n, "kept": m, "files": len(files), "files_dropped": len(gone), "unparsed": len(other), "scanned": n + len(other)}
    info["matches_dropped_in_files"] = sum(len(files[f]) - len(h) for f, h in chosen.items())
    return Shrunk(made, info=info | {"matches_dropped_with_files": sum(gone.values()), "tokens_saved": max(0, nbytes(text) - nbytes(made)) // 4})
