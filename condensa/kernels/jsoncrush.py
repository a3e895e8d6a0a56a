"""JSON arrays: schema-first tables, statistics of fields, and sampling that keeps what stands out."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from condensa.config import CRUSH, CrushConfig
from condensa.kernels.base import Context, Num, Shrunk, Skip, canonical, dumps, loads, marker, nbytes, stash_key
from condensa.kernels.detect import PLAIN, content_type, json_payload

#: Words that mark a record as an error, names of score fields.
ERROR_WORDS = "error exception failed failure critical fatal crash panic abort timeout denied rejected".split()
SCORE_NAMES = "score rating priority confidence relevance rank".split()
CORE_SHARE, CORE_RATIO, MOST_BUCKETS, BUCKET_SHARE = 0.8, 0.6, 8, 0.7
NEST_DEPTH, CRUSH_DEPTH, MOST_CHILDREN = 8, 50, 6
_ERROR = re.compile("|".join(ERROR_WORDS))


# ---------------------------------------------------------------- tables


def type_tag(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, Num):
        return "int" if v.whole else "float"
    return "string" if isinstance(v, str) else "json"


@dataclass
class Column:
    name: str
    parent: str
    child: str | None
    tag: str
    nullable: bool

    def of(self, row: dict):
        """The cell, or None; a missing child of a nested object is None too."""
        v = row.get(self.parent)
        if self.child is None:
            return v
        return v.get(self.child) if isinstance(v, dict) else None


def frequencies(rows: list[dict]) -> Counter[str]:
    return Counter(k for r in rows for k in r)


def _children(rows: list[dict], key: str) -> list[str] | None:
    """Keys of a nested object that is alike in all rows that have it."""
    shapes = {tuple(sorted(r[key])) if isinstance(r[key], dict) else () for r in rows if key in r}
    shape = shapes.pop() if len(shapes) == 1 else ()
    return list(shape) if 0 < len(shape) <= MOST_CHILDREN else None


def columns(rows: list[dict], flatten: bool) -> list[Column]:
    """Columns by frequency, then name; uniform nested objects as one column for each key."""
    out = []
    for key, _ in sorted(frequencies(rows).items(), key=lambda x: (-x[1], x[0].encode())):
        for child in (_children(rows, key) if flatten else None) or [None]:
            c = Column(key if child is None else f"{key}.{child}", key, child, "string", False)
            cells = [c.of(r) for r in rows]
            tags = {type_tag(v) for v in cells if v is not None}
            c.nullable = any(v is None for v in cells)
            c.tag = "string" if not tags else tags.pop() if len(tags) == 1 else "json"
            out.append(c)
    return out


def csv_cell(text: str) -> str:
    return quoted(text) if re.search(r'[,"\n\r]', text) else text


def quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _container(text: str):
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        v = loads(text)
    except ValueError:
        return None
    return v if isinstance(v, (dict, list)) else None


def opaque_kind(text: str) -> str | None:
    """Kind of a long string that is better stashed than shown."""
    if nbytes(text) <= 256 or "<<stash:" in text or _container(text) is not None:
        return None
    if not re.search(r"[<>\s]", text) and len(re.findall(r"[A-Za-z0-9+/=_-]", text)) / nbytes(text) >= 0.95 and len(set(text)) >= 16:
        return "base64"
    return "html" if len(re.findall(r"<(?=[A-Za-z/!])", text)) >= 3 else "string"


def human_size(n: int) -> str:
    return f"{n}B" if n < 1024 else f"{n / 1024:.1f}KB" if n < 1024**2 else f"{n / 1024**2:.1f}MB"


@dataclass
class Tables:
    """Renders tables; with ``offload``, long opaque strings become markers whose values are collected."""

    offload: bool = False
    deferred: list[tuple[str, str]] = field(default_factory=list)

    def _opaque(self, text: str) -> str | None:
        kind = opaque_kind(text) if self.offload else None
        if kind is None:
            return None
        self.deferred.append((stash_key(text), text))
        return f"{marker(stash_key(text))}[{kind},{human_size(nbytes(text))}]"

    def nested(self, rows: list, depth: int = 0):
        """A list of objects as a table within JSON, or None."""
        if depth >= NEST_DEPTH or len(rows) < 2 or not all(isinstance(r, dict) for r in rows):
            return None
        cols = columns(rows, True)
        if not cols:
            return None
        schema = [{"name": c.name, "type": c.tag} | ({"nullable": True} if c.nullable else {}) for c in cols]
        n = Num(len(rows))
        return {"_compaction": "table", "_schema": schema, "_kept": n, "_total": n, "_rows": [[self._inner(c.of(r), depth + 1) for c in cols] for r in rows]}

    def _inner(self, v, depth: int):
        if isinstance(v, str) and not isinstance(v, Num):
            parsed = _container(v)
            if parsed is None:
                return self._opaque(v) or v
            v = parsed
        if isinstance(v, list):
            return self.nested(v, depth) or v
        return v

    def cell(self, v) -> str:
        if v is None:
            return ""
        if isinstance(v, Num) or isinstance(v, bool):
            return dumps(v)
        if isinstance(v, str):
            parsed = _container(v)
            if parsed is None:
                return self._opaque(v) or csv_cell(v)
            v = parsed
        elif isinstance(v, dict):
            return quoted(dumps(v))
        return quoted(dumps((self.nested(v) if isinstance(v, list) else None) or v))

    def table(self, rows: list[dict], flatten: bool) -> str | None:
        cols = columns(rows, flatten)
        if not cols:
            return None
        head = ",".join(f"{c.name}:{c.tag}{'?' * c.nullable}" for c in cols)
        body = "".join(",".join(self.cell(c.of(r)) for c in cols) + "\n" for r in rows)
        return f"[{len(rows)}]{{{head}}}\n{body}"

    def buckets(self, rows: list[dict]) -> str | None:
        """Rows of several shapes, split by the field that tells them apart."""
        freq = frequencies(rows)
        core = sum(n >= math.ceil(len(rows) * CORE_SHARE) for n in freq.values())
        if not freq or core / len(freq) >= CORE_RATIO:
            return None
        by = discriminator(rows)
        if by is None:
            return None
        groups: dict[str, list[dict]] = {}
        for r in rows:
            groups.setdefault(r[by], []).append(r)
        out = f"__buckets:{by}\n"
        for key in sorted(groups, key=str.encode):
            own = groups[key]
            part = f"[{len(own)}]{{value:json}}\n" + "".join(quoted(dumps(r)) + "\n" for r in own) if len(own) < 2 else self.table(own, True)
            if part is None:
                return None
            out += f"__key:{csv_cell(key)}\n{part}"
        return out


def discriminator(rows: list[dict]) -> str | None:
    """A string field of all rows with 2 to 8 values, not nearly one for each row; of several, that with most values."""
    best = None
    for key, n in sorted(frequencies(rows).items(), key=lambda x: x[0].encode()):
        values = [r.get(key) for r in rows]
        if n < len(rows) or not all(isinstance(v, str) and not isinstance(v, Num) for v in values):
            continue
        kinds = len(set(values))
        if 2 <= kinds <= MOST_BUCKETS and kinds / len(rows) <= BUCKET_SHARE and (best is None or kinds > best[1]):
            best = (key, kinds)
    return best and best[0]


def same_shape(rows: list[dict]) -> bool:
    """Equal plain keys, no nulls, one type for each key: a table of these rows loses nothing."""
    keys = set(rows[0])
    if not keys or not all(re.fullmatch(r"[\w.-]+", k) for k in keys):
        return False
    tags = {k: type_tag(rows[0][k]) for k in keys}
    return all(set(r) == keys and all(v is not None and type_tag(v) == tags[k] for k, v in r.items()) for r in rows)


def as_table(rows: list, lossless: bool, offload: bool = False, config: CrushConfig = CRUSH) -> tuple[str, list] | None:
    """The rows as a table if that saves enough; with the values that its markers stand for."""
    if len(rows) < config.min_items or not all(isinstance(r, dict) for r in rows) or (lossless and not same_shape(rows)):
        return None
    t = Tables(offload and not lossless)
    out = t.table(rows, False) if lossless else t.buckets(rows)
    if out is None and not lossless:
        t = Tables(offload)
        out = t.table(rows, True)
    if out is None or 1 - nbytes(out) / max(1, nbytes(dumps(rows))) < config.min_savings:
        return None
    return out, t.deferred


def minified(text: str) -> str:
    """Compact JSON, never longer than the input."""
    try:
        out = dumps(loads(text.strip()))
    except ValueError:
        raise Skip from None
    return out if nbytes(out) < nbytes(text) else text


def reformat_json(text: str, config: CrushConfig = CRUSH) -> str:
    """The lossless forms: a table of uniform rows, with the text around it; else compact JSON if a fifth is saved."""
    payload = json_payload(text)
    if payload is None:
        raise Skip
    value, start, end, _ = payload
    got = as_table(value, True, config=config) if isinstance(value, list) else None
    if got:
        return text[:start] + got[0] + text[end:]
    out = minified(text)
    if nbytes(out) > 0.8 * nbytes(text):
        raise Skip
    return out


# ---------------------------------------------------------------- statistics


def number(v) -> float | None:
    x = v.value if isinstance(v, Num) else None
    return x if x is not None and math.isfinite(x) else None


def mean(xs: list[float]) -> float | None:
    return sum(xs) / len(xs) if xs else None


def stdev(xs: list[float]) -> float | None:
    """Of a sample."""
    if len(xs) < 2:
        return None
    m = mean(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))


def percentile(xs: list[float], q: float) -> float:
    """Linear between neighbours."""
    s = sorted(xs)
    at = (len(s) - 1) * q
    lo = math.floor(at)
    hi = min(lo + 1, len(s) - 1)
    return s[lo] + (s[hi] - s[lo]) * (at - lo)


def shown(v) -> str:
    return v if isinstance(v, str) else canonical(v)


def _kind(v) -> str:
    if isinstance(v, Num):
        return "numeric"
    return {str: "string", bool: "boolean", dict: "object", list: "array", type(None): "null"}[type(v)]


@dataclass
class FieldStats:
    name: str
    kind: str
    count: int
    unique: int
    ratio: float
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    stdev: float | None = None
    changes: list[int] = field(default_factory=list)


def field_stats(rows: list[dict], config: CrushConfig = CRUSH) -> dict[str, FieldStats]:
    out = {}
    for name in sorted(frequencies(rows), key=str.encode):
        cells = [(i, r[name]) for i, r in enumerate(rows) if name in r]
        kinds = Counter(_kind(v) for _, v in cells)
        kind = min(kinds, key=lambda k: (-kinds[k], k))
        unique = len({shown(v) for _, v in cells})
        s = out[name] = FieldStats(name, kind, len(cells), unique, unique / len(cells))
        xs = [(i, x) for i, v in cells if (x := number(v)) is not None]
        if kind == "numeric" and xs:
            values = [x for _, x in xs]
            s.low, s.high, s.mean, s.stdev = min(values), max(values), mean(values), stdev(values)
            if len(kinds) == 1 and len(rows) > 10:
                steps = [b - a for a, b in zip(values, values[1:])]
                m, d = mean(steps), stdev(steps)
                if d:
                    s.changes = [xs[k + 1][0] for k, x in enumerate(steps) if abs(x - m) > config.sigmas * d]
    return out


def outliers(rows: list[dict], stats: dict[str, FieldStats], config: CrushConfig = CRUSH) -> set[int]:
    """Rows with a number far from the mean of its field."""
    return {
        i
        for s in stats.values()
        if s.kind == "numeric" and s.stdev
        for i, r in enumerate(rows)
        if (x := number(r.get(s.name))) is not None and abs(x - s.mean) > config.sigmas * s.stdev
    }


def error_rows(rows: list) -> set[int]:
    return {i for i, r in enumerate(rows) if isinstance(r, dict) and _ERROR.search(dumps(r).lower())}


#: How a null is counted among the values of a field: fixed value.
NONE_VALUE = "__none__"


def rare_status_rows(rows: list[dict], config: CrushConfig = CRUSH) -> set[int]:
    """Rows with a value beyond the few that cover most rows, in fields that most rows have.

    A null is a value like others, but for the number of values that a field may have.
    """
    n, out = len(rows), set()
    for name, f in frequencies(rows).items():
        if f < config.rare_cover * n:
            continue
        values = {i: NONE_VALUE if r[name] is None else shown(r[name]) for i, r in enumerate(rows) if name in r}
        if not 2 <= len({shown(r[name]) for r in rows if r.get(name) is not None}) <= config.rare_most_values:
            continue
        counts = Counter(values.values())
        need, top = math.ceil(config.rare_cover * len(values)), set()
        for v, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if need <= 0:
                break
            top.add(v)
            need -= c
        if len(top) <= config.rare_top:
            out |= {i for i, v in values.items() if v not in top}
    return out


def structural_rows(rows: list[dict], config: CrushConfig = CRUSH) -> set[int]:
    """Rows that have a field which few rows have, or a rare value."""
    n = len(rows)
    if n < config.min_items:
        return set()
    rare = {k for k, c in frequencies(rows).items() if c < config.structural_share * n}
    return {i for i, r in enumerate(rows) if rare & set(r)} | rare_status_rows(rows, config)


def score_field(stats: dict[str, FieldStats]) -> str | None:
    best = None
    for s in stats.values():
        if s.kind != "numeric" or s.low is None:
            continue
        named = any(w in s.name.lower() for w in SCORE_NAMES)
        if (named or (0 <= s.low and s.high <= 1 and s.unique > 1)) and (best is None or s.high - s.low > best[1]):
            best = (s.name, s.high - s.low)
    return best and best[0]


def message_field(stats: dict[str, FieldStats]) -> str | None:
    """String field with most values, many for its rows; of equals the last by name."""
    found = [s for s in stats.values() if s.kind == "string" and s.ratio > 0.3]
    return max(enumerate(found), key=lambda x: (x[1].unique, x[0]))[1].name if found else None


def strategy(rows: list[dict], stats: dict[str, FieldStats], config: CrushConfig = CRUSH) -> str:
    scored = score_field(stats)
    if not (scored or any(s.ratio < config.near_constant for s in stats.values()) or error_rows(rows) or outliers(rows, stats, config)):
        return "skip"
    if scored:
        return "top_n"
    if any(s.changes for s in stats.values()):
        return "time_series"
    if message_field(stats) and any(s.kind == "string" and s.ratio <= 0.3 and s.count >= 5 for s in stats.values()):
        return "cluster"
    return "smart_sample"


# ---------------------------------------------------------------- queries


def query_anchors(query: str) -> set[str]:
    """Quoted strings, long numbers, addresses, host names and identifiers of a query, lower-cased."""
    out = {m[2].lower() for m in re.finditer(r"(['\"])(.*?)\1", query, re.S) if len(m[2].strip()) >= 2}
    for t in re.findall(r"[A-Za-z0-9@._-]+", query):
        if re.fullmatch(r"\d{4,}", t) or "@" in t or ("." in t and len(t) >= 4):
            out.add(t.lower())
    for t in query.lower().split():
        t = re.sub(r"^[^0-9a-f-]+|[^0-9a-f-]+$", "", t)
        if len(t) == 36 and t.count("-") == 4:
            out.add(t)
    return out


def anchored(rows: list, query: str) -> set[int]:
    wanted = query_anchors(query)
    return {i for i, r in enumerate(rows) if any(a in dumps(r).lower() for a in wanted)} if wanted else set()


# ---------------------------------------------------------------- sampling


def budget(n: int, config: CrushConfig = CRUSH) -> int:
    return n if n <= 8 else min(max(n // 4, 3), max(3, config.max_items))


class Contents(list):
    """Canonical contents of the rows, to tell copies."""

    def __init__(self, rows: list):
        super().__init__(map(canonical, rows))


def spread(contents: Contents, most: int) -> set[int]:
    """Distinct rows from the front, the back and all over."""
    n = len(contents)
    if n <= most:
        return set(range(n))
    front, back = max(1, int(most * 0.45)), max(1, int(most * 0.25))
    out, seen = set(), set()
    for start, end, slots in ((0, min(2 * front, n // 3), front), (max(n - 2 * back, 2 * n // 3), n, back), (0, n, most - front - back)):
        taken = 0
        if slots > 0 and end > start:
            for i in range(start, end, max(1, (end - start - 1) // slots)):
                if taken < slots and contents[i] not in seen:
                    seen.add(contents[i])
                    out.add(i)
                    taken += 1
    return out


def first_copies(keep: set[int], contents: Contents) -> set[int]:
    return set({contents[i]: i for i in sorted(keep, reverse=True)}.values())


def filled(keep: set[int], contents: Contents, most: int) -> set[int]:
    """Distinct rows at even distances, up to the budget."""
    free = [i for i in range(len(contents)) if i not in keep]
    need = most - len(keep)
    if need <= 0 or not free:
        return keep
    out, seen, step = set(keep), {contents[i] for i in keep}, max(1, len(free) // (need + 1))
    for i in (i for offset in range(step) for i in free[offset::step]):
        if len(out) - len(keep) >= need:
            break
        if contents[i] not in seen:
            seen.add(contents[i])
            out.add(i)
    return out


def within_budget(keep: set[int], contents: Contents, critical: set[int], most: int) -> set[int]:
    """Copies once; up to the budget if there is room; else critical rows, first and last rows, then in order."""
    n = len(contents)
    now = filled(first_copies(keep, contents), contents, most)
    if len(now) <= most:
        return now
    out = set(critical)
    for i in [*range(min(3, n)), *range(max(0, n - 2), n), *sorted(now - out)]:
        if len(out) >= most:
            break
        out.add(i)
    return out


def plan(rows: list[dict], query: str, config: CrushConfig = CRUSH) -> tuple[str, set[int]]:
    """Name of the strategy and the rows to keep."""
    n = len(rows)
    stats = field_stats(rows, config)
    kind = strategy(rows, stats, config)
    if kind == "skip":
        return "skip:unique_entities_no_signal", set(range(n))
    k, contents = budget(n, config), Contents(rows)
    odd = error_rows(rows) | structural_rows(rows, config)
    hits = anchored(rows, query) if query else set()
    if kind == "top_n":
        by = score_field(stats)
        ranked = sorted(range(n), key=lambda i: -(number(rows[i].get(by)) or 0.0))
        return f"top_n({by})", first_copies(set(ranked[: max(0, k - 3)]) | odd | hits, contents)
    keep = spread(contents, k) | odd | hits
    name = kind
    around = {"smart_sample": 1, "time_series": 2}.get(kind)
    if around is not None:
        keep |= {c + d for s in stats.values() for c in s.changes for d in range(-around, around + 1) if 0 <= c + d < n}
    if kind == "smart_sample":
        keep |= outliers(rows, stats, config)
    if kind == "cluster":
        by = message_field(stats)
        name = f"cluster({by})"
        seen: Counter[str] = Counter()
        for i, r in enumerate(rows):
            v = r.get(by)
            head = (v if isinstance(v, str) else "")[:50]
            seen[head] += 1
            if seen[head] <= 2:
                keep.add(i)
    return name, within_budget(keep, contents, odd | hits | outliers(rows, stats, config), k)


def ends(n: int, config: CrushConfig = CRUSH) -> tuple[int, int, int]:
    """Budget, and how many of it from the front and the back."""
    k = budget(n, config)
    share = lambda x: max(1, math.floor(k * x + 0.5))
    first = min(k, share(config.first_share))
    return k, first, min(share(config.last_share), k - first)


def _with_ends(keep: set[int], n: int, config: CrushConfig, new=lambda i: True) -> set[int]:
    """Add front and back, then rows at even distances that are ``new``."""
    k, first, last = ends(n, config)
    keep |= set(range(min(first, n))) | set(range(max(0, n - last), n))
    need = k - len(keep)
    if need > 0:
        for i in range(0, n, max(1, (n - 1) // (need + 1))):
            if len(keep) >= k + need:
                break
            if i not in keep and new(i):
                keep.add(i)
    return keep


def crush_strings(items: list[str], config: CrushConfig = CRUSH) -> tuple[list[int], str]:
    n = len(items)
    if n <= 8:
        return list(range(n)), "string:passthrough"
    sizes = [float(len(s)) for s in items]
    m, d = mean(sizes), stdev(sizes)
    keep = {i for i, s in enumerate(items) if _ERROR.search(s.lower()) or (d and abs(sizes[i] - m) > config.sigmas * d)}
    k, first, last = ends(n, config)
    keep |= set(range(min(first, n))) | set(range(max(0, n - last), n))
    seen = {items[i] for i in keep}

    def new(i: int) -> bool:
        if items[i] in seen:
            return False
        seen.add(items[i])
        return True

    keep = _with_ends(keep, n, config, new)
    return sorted(keep), f"string:adaptive({n}->{len(keep)})"


def crush_numbers(items: list, config: CrushConfig = CRUSH) -> tuple[list[int], str]:
    n = len(items)
    xs = [number(v) for v in items]
    finite = [x for x in xs if x is not None]
    if n <= 8 or not finite:
        return list(range(n)), "number:passthrough" if n <= 8 else "number:no_finite"
    m, d = mean(finite), stdev(finite) or 0.0
    keep = {i for i, x in enumerate(xs) if d and x is not None and abs(x - m) > config.sigmas * d}
    if n > 10 and d:
        for i in range(5, n - 5):
            left, right = (mean([x for x in xs[a:b] if x is not None]) for a, b in ((i - 5, i), (i, i + 5)))
            if left is not None and right is not None and abs(left - right) > 2 * d:
                keep.add(i)
    keep = _with_ends(keep, n, config)
    return sorted(keep), f"number:adaptive({n}->{len(keep)},mean={m:.4f},p25={percentile(finite, 0.25):.4f},p75={percentile(finite, 0.75):.4f})"


def crush_mixed(items: list, query: str, config: CrushConfig = CRUSH) -> tuple[list[int], str]:
    n = len(items)
    if n <= 8:
        return list(range(n)), "mixed:passthrough"
    names = {"object": "dict", "string": "str", "numeric": "num"}
    groups: dict[str, list[int]] = {}
    for i, v in enumerate(items):
        groups.setdefault(_kind(v), []).append(i)
    keep, parts = set(), []
    for kind, at in groups.items():
        own = [items[i] for i in at]
        if len(at) < config.min_items or kind not in names:
            keep |= set(at)
            continue
        if kind == "object":
            chosen = sorted(plan(own, query, config)[1]) if len(own) > budget(len(own), config) else list(range(len(own)))
        else:
            chosen = (crush_strings if kind == "string" else crush_numbers)(own, config)[0]
        kept = {canonical(own[i]) for i in chosen}
        keep |= {i for i in at if canonical(items[i]) in kept}
        parts.append(f"{names[kind]}:{len(at)}->{len(chosen)}")
    return sorted(keep), f"mixed:adaptive({n}->{len(keep)},{','.join(parts)})"


def sentinel(name: str, n: int, dropped: list[dict], config: CrushConfig = CRUSH) -> dict:
    """What stands for the rows left out: counts, a sample, and the values of fields with few."""
    out = {"_crushed": name, "_original_count": Num(n), "_dropped_count": Num(len(dropped)), "_dropped_sample": dropped[: config.dropped_sample]}
    summary = {}
    for key, f in sorted(frequencies(dropped).items(), key=lambda x: x[0].encode()):
        counts = Counter(shown(r[key]) for r in dropped if r.get(key) is not None)
        if f == len(dropped) and 0 < len(counts) <= 10:
            total = sum(counts.values())
            summary[key] = {v: f"{counts[v]}/{total}" for v in sorted(counts, key=str.encode)}
    if summary:
        out["_dropped_field_summary"] = summary
    return out


def _prose(text: str, query: str) -> str | None:
    from condensa.config import TextConfig
    from condensa.kernels.prose import shrink_text

    if nbytes(text) < 256 or content_type(text) != PLAIN:
        return None
    try:
        got = shrink_text(text, Context(query), ratio=0.4, config=TextConfig(min_segments=4)).text
    except Skip:
        return None
    return got if nbytes(got) < nbytes(text) else None


def classify(items: list) -> str:
    kinds = {_kind(v) for v in items}
    return kinds.pop() if len(kinds) == 1 else "mixed" if kinds else "empty"


def crushed(v, query: str = "", config: CrushConfig = CRUSH, depth: int = 0):
    """The value with its arrays sampled and its long texts shortened, at any depth."""
    if depth >= CRUSH_DEPTH:
        return v
    if isinstance(v, dict):
        return {k: crushed(x, query, config, depth + 1) for k, x in v.items()}
    if isinstance(v, str) and not isinstance(v, Num):
        return _prose(v, query) or v
    if not isinstance(v, list):
        return v
    n, kind = len(v), classify(v)
    if n >= config.min_items:
        if kind == "object":
            if n <= budget(n, config):
                return v
            name, keep = plan(v, query, config)
            gone = [r for i, r in enumerate(v) if i not in keep]
            return [r for i, r in enumerate(v) if i in keep] + ([sentinel(name, n, gone, config)] if gone else [])
        if kind in ("string", "numeric", "mixed", "null"):
            keep = crush_strings(v, config)[0] if kind == "string" else crush_numbers(v, config)[0] if kind == "numeric" else crush_mixed(v, query, config)[0]
            return [v[i] for i in keep]
    return [crushed(x, query, config, depth + 1) for x in v]


def shrink_json(text: str, ctx: Context, config: CrushConfig = CRUSH) -> Shrunk:
    """A table if that saves enough, else the sampled value; text around the JSON stays."""
    payload = json_payload(text)
    if payload is None:
        raise Skip
    value, start, end, normal = payload
    got = as_table(value, False, True, config) if isinstance(value, list) else None
    out, deferred = got or (dumps(crushed(value, ctx.query, config)), [])
    if not normal and out == text[start:end]:
        raise Skip
    return Shrunk(text[:start] + out + text[end:], deferred=deferred)
