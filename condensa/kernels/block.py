"""One block from end to end: lossless form, lossy form, and whether it is accepted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from condensa.config import GATES
from condensa.kernels import tags
from condensa.kernels.base import MARKER, Context, Shrunk, Skip, marker, nbytes, stash_key, tokens
from condensa.kernels.code import shrink_code
from condensa.kernels.config_files import shrink_config
from condensa.kernels.detect import CODE, CONFIG, DIFF, HTML, JSON, LOG, PLAIN, SEARCH, TABLE, content_type, path_language
from condensa.kernels.diffs import shrink_diff
from condensa.kernels.html_md import shrink_html
from condensa.kernels.jsoncrush import reformat_json, shrink_json
from condensa.kernels.loglines import shrink_log, templates
from condensa.kernels.mixed import replace_spans, sections
from condensa.kernels.prose import shrink_text
from condensa.kernels.secret_tokens import keeps_secrets
from condensa.kernels.searchhits import shrink_search
from condensa.kernels.tables import shrink_table

LOSSY: dict[str, Callable[[str, Context], Shrunk]] = {
    JSON: shrink_json, DIFF: shrink_diff, HTML: shrink_html, SEARCH: shrink_search, LOG: shrink_log,
    TABLE: shrink_table, CONFIG: shrink_config, CODE: shrink_code, PLAIN: shrink_text,
}
LOSSLESS: dict[str, tuple[Callable[[str], str], float]] = {JSON: (reformat_json, GATES.json_max_ratio), LOG: (templates, GATES.log_max_ratio)}


@dataclass
class Outcome:
    """status: unchanged, lossless, lossy or reverted. ``stash``: (key, content) that must be stored before publishing."""

    text: str
    status: str = "unchanged"
    content_type: str = PLAIN
    tokens_before: int = 0
    tokens_after: int = 0
    key: str | None = None
    stash: list[tuple[str, str]] = field(default_factory=list)


def _try(kind: str, text: str, ctx: Context) -> Shrunk | None:
    """The shrunk text, if it is shorter."""
    try:
        got = LOSSY[kind](text, ctx)
    except Skip:
        return None
    return got if nbytes(got.text) < nbytes(text) else None


def shrink_mixed(text: str, ctx: Context) -> Shrunk | None:
    """Each section by its kind, JSON within text where it stands; None if nothing is gained."""
    inner = replace(ctx, stash_path=None, source_path=None)
    deferred: list[tuple[str, str]] = []

    def span(part: str) -> str | None:
        got = _try(content_type(part), part, inner)
        deferred.extend(got.deferred if got else [])
        return got and got.text

    found = sections(text)
    if len(found) <= 1:
        out, changed = replace_spans(text, span)
        return Shrunk(out, deferred=deferred) if changed else None
    lines, parts, changed = text.split("\n"), [], False
    for s in found:
        whole = s.text == "\n".join(lines[s.first : s.last + 1])
        own = replace(ctx, source_path=None, stash_path=ctx.stash_path if whole else None, line_offset=ctx.line_offset + s.first)
        got = _try(s.kind, s.text, own)
        if got:
            deferred += got.deferred
            parts.append(got.text)
        else:
            parts.append(s.text)
        changed = changed or got is not None
    out = parts[0]
    for p in parts[1:]:
        out += ("" if out.endswith("\n") else "\n") + p
    return Shrunk(out, deferred=deferred) if changed and nbytes(out) < nbytes(text) else None


def shrink_block(text: str, query: str = "", source_path: str | None = None, stash_dir: str | None = None, min_bytes: int = GATES.min_block_bytes, conservative: bool = False, ratio: float | None = None) -> Outcome:
    """Shrink one block; what comes back is never more tokens than went in, and keeps every secret.

    ``stash_dir``: where stashed originals can be read as files; then line hints name them. ``conservative`` and ``ratio``:
    how plain text is shortened.
    """
    before = tokens(text)
    out = Outcome(text, tokens_before=before, tokens_after=before)
    if nbytes(text) < min_bytes or MARKER.search(text):
        return out
    known = path_language(source_path)
    out.content_type = CODE if known else content_type(text)
    source = out.content_type == CODE
    guarded = tags.protect(text)
    current, most, reformed = guarded.text, 1.0, False
    types = {} if known else {text: out.content_type}

    def type_of(x: str) -> str:
        return types[x] if x in types else types.setdefault(x, content_type(x))

    lossless = LOSSLESS.get(type_of(current))
    if lossless:
        most = lossless[1]
        try:
            got = lossless[0](current)
            reformed = nbytes(got) < nbytes(current)
            current = got if reformed else current
        except Skip:
            pass

    def keep_lossless(otherwise: str) -> Outcome:
        whole = tags.restore(current, guarded.wraps)
        if not reformed or nbytes(whole) >= nbytes(text):
            return replace(out, status=otherwise)
        return replace(out, text=whole, status="lossless", tokens_after=tokens(whole))

    if reformed and tokens(current) / max(1, before) <= most and (done := keep_lossless("unchanged")).status == "lossless":
        return done
    key = stash_key(text)
    path = f"{stash_dir.rstrip('/')}/{key}" if stash_dir else None
    source_text = guarded.text if path and guarded.text == text else current
    same = source_text == text
    ctx = Context(query or "", source_path if same else None, path if same else None, conservative=conservative, ratio=ratio)
    kind = CODE if same and known else type_of(source_text)
    got = shrink_mixed(source_text, ctx) if kind == PLAIN else None
    if got is None:
        try:
            got = LOSSY[kind](source_text, ctx)
        except Skip:
            return keep_lossless("unchanged")
    made = tags.restore(got.text, guarded.wraps)
    if not made or made == text:
        return keep_lossless("unchanged")
    if guarded.text != text and got.deferred:
        return keep_lossless("reverted")
    view = "\n".join([made, *(content for k, content in got.deferred if marker(k) in made)])
    final = made + marker(key)
    after = tokens(final)
    if not keeps_secrets(text, view, source) or after >= before:
        return keep_lossless("reverted")
    return replace(out, text=final, status="lossy", tokens_after=after, key=key, stash=list(dict([(key, text), *got.deferred]).items()))
