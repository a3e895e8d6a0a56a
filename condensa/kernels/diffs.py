"""Unified diffs: noise first, then the heaviest files, the best hunks and little context."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from condensa.config import DIFF, DiffConfig
from condensa.kernels.base import Context, Shrunk, Skip, nbytes, rust_lines, stash_key, usable_path, with_gaps
from condensa.kernels.searchhits import any_word, bigrams

# Lock files, words by priority, headers.
LOCKFILES = "Cargo.lock package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock Gemfile.lock go.sum composer.lock".split()
PRIORITY = (
    "error exception failed failure fatal critical crash panic".split(),
    "important note todo fixme hack xxx bug fix".split(),
    "security auth password secret token".split(),
)
FILE_HEADER = re.compile(r"diff --git a/.* b/|diff --combined |diff --cc ")
HUNK_HEADER = re.compile(r"(@{2,4}) (?=[^@]*-\d)(?=[^@]*\+\d)[-+]\d+(?:,\d+)?(?: [-+]\d+(?:,\d+)?)* \1")
_LOCK = re.compile(r"(?:^|.*[/\\])(?:" + "|".join(map(re.escape, LOCKFILES)) + r")$")


@dataclass
class Hunk:
    header: str
    at: int
    lines: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    score: float = 0.0

    def count(self, sign: str) -> int:
        return sum(x[:1] == sign and x[:3] != sign * 3 for x in self.lines)

    @property
    def first_line(self) -> int:
        m = re.search(r"\+(\d+)", self.header)
        return int(m[1]) if m else 0


@dataclass
class File:
    header: str
    places: list[int]
    old: str = ""
    new: str = ""
    renames: list[str] = field(default_factory=list)
    mode: str = ""
    binary: bool = False
    hunks: list[Hunk] = field(default_factory=list)

    def count(self, sign: str) -> int:
        return sum(h.count(sign) for h in self.hunks)


def parse(lines: list[str]) -> tuple[list[str], list[File]]:
    """Lines before the first file, and the files."""
    before: list[str] = []
    files: list[File] = []
    for i, x in enumerate(lines):
        if FILE_HEADER.match(x):
            files.append(File(x, [i]))
            continue
        if not files:
            before.append(x)
            continue
        f = files[-1]
        opens = bool(HUNK_HEADER.match(x))
        if not f.hunks and not opens:
            f.places.append(i)
        if m := re.match(r"(new|deleted) file mode", x):
            f.mode = m[1] if f.mode != "new" else f.mode
        elif re.match(r"rename |similarity |copy |dissimilarity ", x):
            f.renames.append(x)
        elif re.match(r"Binary files .* differ$", x):
            f.binary = True
        elif re.match(r"--- (?:a/.|/dev/null$)", x):
            f.old = x
        elif re.match(r"\+\+\+ (?:b/.|/dev/null$)", x):
            f.new = x
        elif opens:
            f.hunks.append(Hunk(x, i))
        elif f.hunks:
            f.hunks[-1].lines.append(x)
            f.hunks[-1].places.append(i)
    return before, files


def score(hunk: Hunk, query: str) -> float:
    low, asked = "\n".join(hunk.lines).lower(), query.lower()
    s = min(0.3, 0.03 * (hunk.count("+") + hunk.count("-")))
    s += 0.2 * sum(len(w) > 2 and w in low for w in asked.split()) + 0.2 * sum(b in low for b in bigrams(asked))
    return min(1.0, s + 0.3 * any(any_word(low, g) for g in PRIORITY))


def best_hunks(hunks: list[Hunk], most: int) -> list[Hunk]:
    if len(hunks) <= most:
        return hunks
    middle = sorted(hunks[1:-1], key=lambda h: -h.score)[: most - 2]
    return sorted([hunks[0], *middle, hunks[-1]], key=lambda h: h.first_line)


def near_changes(hunk: Hunk, context: int) -> Hunk:
    """The lines within ``context`` of a change, and notes on line ends; of a hunk without changes its first lines."""
    changed = [i for i, x in enumerate(hunk.lines) if x[:1] in ("+", "-")]
    if not changed:
        keep = list(range(min(context, len(hunk.lines))))
    else:
        near = {i for c in changed for i in range(c - context, c + context + 1)}
        keep = [i for i, x in enumerate(hunk.lines) if i in near or x[:1] == "\\"]
    return Hunk(hunk.header, hunk.at, [hunk.lines[i] for i in keep], [hunk.places[i] for i in keep], hunk.score)


def _context(hunk: Hunk) -> int:
    return sum(x[:1] in ("", " ") for x in hunk.lines)


def noise_free(text: str, config: DiffConfig = DIFF) -> str | None:
    """Bodies of lock files and of files in which only white space changed become a note, if they are half of the diff."""
    lines = rust_lines(text)
    if len(lines) < config.noise_min_lines:
        return None
    prelude, parts = [], []
    for x in lines:
        if x.startswith("diff --git "):
            parts.append(([x], []))
        elif not parts:
            prelude.append(x)
        elif parts[-1][1] or x.startswith("@@"):
            parts[-1][1].append(x)
        else:
            parts[-1][0].append(x)
    if not parts:
        return None

    def reason(head: list[str], body: list[str]) -> str | None:
        path = next((x[4:].removeprefix("b/") for x in head if x.startswith("+++ ")), head[0].rpartition(" b/")[2])
        if _LOCK.match(path):
            return "lockfile"
        sides = [[re.sub(r"\s", "", x[1:], flags=re.A) for x in body if x[:1] == s and x[:3] != s * 3] for s in "+-"]
        return "whitespace-only" if sides[0] and sides[0] == sides[1] else None

    size = lambda body: sum(nbytes(x) + 1 for x in body)
    why = [reason(*p) for p in parts]
    total = sum(size(b) for _, b in parts)
    if not total or sum(size(b) for (_, b), w in zip(parts, why, strict=True) if w) / total < config.noise_share:
        return None
    out = list(prelude)
    for (head, body), w in zip(parts, why, strict=True):
        out += head + ([f"[diff_noise: {w} hunks dropped ({len(body)} lines)]"] if w else body)
    made = "\n".join(out) + ("\n" if text.endswith("\n") else "")
    return made if any(why) and nbytes(made) < nbytes(text) else None


def reduced(text: str, query: str = "", config: DiffConfig = DIFF, note: bool = True) -> tuple[str, list[int], dict]:
    """The diff with fewer files, hunks and context lines; the lines of the input that it keeps; counters."""
    lines = text.split("\n")
    before, files = parse(lines) if len(lines) >= config.min_lines else ([], [])
    if not files:
        return text, list(range(len(lines))), {"files": 0}
    for f in files:
        for h in f.hunks:
            h.score = score(h, query)
    every = files
    if len(files) > config.files:
        files = sorted(files, key=lambda f: -(f.count("+") + f.count("-")))[: config.files]
    out, kept, dropped = list(before), list(range(len(before))), 0
    largest, context_kept, per_file = {"kept": 0, "dropped": 0}, 0, {}
    added, deleted = sum(f.count("+") for f in files), sum(f.count("-") for f in files)
    for f in files:
        best = best_hunks(f.hunks, config.hunks)
        hunks = [near_changes(h, config.context) for h in best]
        dropped += len(f.hunks) - len(hunks)
        if len(best) < len(f.hunks):
            per_file[f"{f.old} -> {f.new}"] = len(f.hunks) - len(best)
            largest["dropped"] = max(largest["dropped"], *(len(h.lines) for h in f.hunks if h not in best))
        largest["kept"] = max([largest["kept"], *(len(h.lines) for h in hunks)])
        context_kept += sum(map(_context, hunks))
        kept += f.places
        out += [f.header, *f.renames, *[f"{f.mode} file mode 100644"] * bool(f.mode)]
        if f.binary:
            out.append("Binary files differ")
        else:
            out += [x for x in (f.old, f.new) if x]
        for h in hunks:
            if not f.binary:
                out += [h.header, *h.lines]
            kept += [h.at, *h.places]
    parts = [f"{len(files)} files changed", f"+{added} -{deleted} lines", *[f"{dropped} hunks omitted"] * bool(dropped)]
    out.append(f"[{', '.join(parts)}]")
    n = len(out)
    made = "\n".join(out)
    if note and n < len(lines) * config.marker_below:
        made += f"\n[{len(lines)} lines compressed to {n}. Retrieve full diff: hash={stash_key(text)}]"
    context = sum(_context(h) for f in every for h in f.hunks)
    info = {
        "input_lines": len(lines), "output_lines": n, "ratio": n / len(lines), "files": len(every), "files_kept": len(files),
        "files_dropped": [f"{f.old} -> {f.new}" for f in every if f not in files], "hunks": sum(len(f.hunks) for f in every),
        "hunks_kept": sum(len(f.hunks) for f in files) - dropped, "hunks_dropped": dropped, "hunks_dropped_per_file": per_file,
        "context": context, "context_kept": context_kept, "context_trimmed": max(0, context - context_kept), "largest_kept": largest["kept"],
        "largest_dropped": largest["dropped"], "modes_normalised": sum(bool(f.mode) for f in files), "binaries_simplified": sum(f.binary for f in files),
        "marked": note and n < len(lines) * config.marker_below, "additions": added, "deletions": deleted,
    }
    return made, kept, info


def shrink_diff(text: str, ctx: Context, config: DiffConfig = DIFF) -> Shrunk:
    quiet = noise_free(text, config)
    base = quiet or text
    made, kept, info = reduced(base, ctx.query, config, note=quiet is None)
    if nbytes(made) >= nbytes(base):
        made = base
    if quiet is None and usable_path(ctx.stash_path):
        hinted = with_gaps(text, set(kept), ctx.stash_path, ctx.line_offset)
        if nbytes(hinted.text) < nbytes(made):
            return hinted
    if made == text:
        raise Skip
    return Shrunk(made, info=info)
