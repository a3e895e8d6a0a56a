"""Secret scans: fixed patterns, and stretches of long tokens that a character model takes for random.

Two first-order Markov models, one of random strings and one of ordinary identifiers, are trained from labelled
samples. What the fixed patterns leave of a text is cut into runs of token characters; in each run, stretches of
successive characters whose log-likelihood ratio adds up to enough are secrets, so a random key that is glued to an
ordinary path is found without the path. All of it is DataFrame code: the model is a table of one ratio for each pair
of characters (bounded by the alphabet), and goes into the plan as an array.

Texts that hold neither an assignment nor a long run are passed over by two regular expressions. In the others the work
grows with the length of the text and the number of matches, not with their product: positions are added up in runs,
and pieces of a text are taken from parts of bounded size.

Offsets are code points, ends exclusive. Defined results: null texts are empty and hold nothing; repeated rows each
give a row; without samples of a class its model is uniform. Other columns stay as they are, but for one that has the
name asked for the spans, which is replaced; names that begin with ``__secret_`` are kept for this module.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm.common import lean

#: Kinds in their order, patterns, the group that has the value, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Shorter runs would be dropped anyway; matches of the others are the same.
_QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Every assignment that counts has this, and every other span a run of token characters.
_ASSIGNED = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
_RUN = r"[A-Za-z0-9+/=_-]{%d}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
CANDIDATE = r"[A-Za-z0-9+/=_-]{%d,}"


@dataclass(frozen=True)
class MarkovConfig:
    #: Runs of fewer characters are not judged, and of longer ones no stretches of fewer.
    least_length: int = 20
    least_stretch: int = 16
    #: Ratio of the likelihoods, as a natural logarithm, from which a stretch is a secret; for each pair of characters.
    per_pair: float = 0.6
    total: float = 18.0
    #: A stretch ends where its sum falls by so much below its largest value.
    drop: float = 12.0
    #: Added to each count.
    smoothing: float = 0.5
    #: Weight of a uniform model in that of ordinary identifiers, so that a pair which no sample has proves little.
    unseen: float = 0.03
    #: Samples of ordinary words come from this many documents at most (those of smallest hash of the id).
    sample_docs: int = 500
    #: And are so many distinct words at most (those of smallest hash).
    sample_words: int = 4000


def labelled_samples(docs: DataFrame, config: MarkovConfig = MarkovConfig()) -> DataFrame:
    """(value, random): identifiers made of the words of some documents; and random strings from digests of them.

    Words are taken alone, and with their neighbours in the order of their hashes as snake, kebab and camel case, as
    paths and with numbers.
    """
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample_docs).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ids first: texts of the sample only are moved
    words = some.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,40}"), F.lit(0))).alias("w")).distinct()
    words = words.orderBy(F.xxhash64("w"), "w").limit(config.sample_words)
    ordered = words.agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("w").alias("h"), "w"))).alias("ws"))  # of bounded size

    def made(x: Column, i: Column) -> Column:
        word = lambda k: F.coalesce(F.try_element_at("ws", i + 1 + k)["w"], x["w"])
        a, b, c = word(0), word(1), word(2)
        n = F.pmod(x["h"], F.lit(1000)).cast("string")
        raw = F.regexp_replace(F.base64(F.unhex(F.sha2(F.reverse(a), 256))), "=", "")
        plain = (a, F.concat(a, b, c), F.concat_ws("_", a, b, n), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c, n), F.concat(a, F.initcap(b), F.initcap(c)), F.upper(F.concat_ws("_", a, b)))
        drawn = (F.substring(F.sha2(a, 256), 1, 40), raw, F.translate(raw, "+/", "-_"), F.upper(F.regexp_replace(raw, "[+/]", "")))
        return F.array(*[F.struct(v.alias("value"), F.lit(random).alias("random")) for random, vs in ((False, plain), (True, drawn)) for v in vs])

    return ordered.select(F.explode(F.flatten(F.transform("ws", made))).alias("s")).select("s.value", "s.random")


def train(samples: DataFrame, config: MarkovConfig = MarkovConfig()) -> list[float]:
    """Log-likelihood ratio of each pair of characters, in the order of the alphabet, from (value, random)."""
    n = len(ALPHABET)
    chars = F.filter(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = samples.select("random", chars.alias("c")).where(F.size("c") > 1)
    pairs = pairs.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count_if("random").alias("hit"), F.count_if(~F.col("random")).alias("miss"))
    rows = {(r["a"], r["b"]): (r["hit"], r["miss"]) for r in counts.collect()}  # at most n * n rows
    from math import log

    out, s = [], config.smoothing
    for a in ALPHABET:
        own = [rows.get((a, b), (0, 0)) for b in ALPHABET]
        hit, miss = (sum(x[k] for x in own) + n * s for k in (0, 1))
        out += [log((h + s) / hit) - log((1 - config.unseen) * (m + s) / miss + config.unseen / n) for h, m in own]
    return out


#: Items of a text are gone through in runs of so many, so that the work grows with their number, not with its square.
RUN = 256
#: A stretch is widened by so many letters and digits at most to either side.
NEAR = 64
#: Long texts are taken apart in pieces of so many characters.
PIECE = 4096

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it stands in there, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, start: Column, step, kind: str) -> Column:
    """What ``step(state, item)`` -> (new state, made) makes of each item of a non-empty array, in order, as one array."""
    one = lambda acc, x: (lambda s, m: F.struct(s.alias("state"), F.concat(acc["out"], F.array(m)).alias("out")))(*step(acc["state"], x))
    empty = F.array().cast(f"array<{kind}>")

    def run(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))
    return F.aggregate(runs, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), run, lambda acc: F.flatten(acc["out"]))


def _placed(text: Column, pattern: str, kind: int, value: int, least: int) -> Column:
    """Array of (start, kind, end, value) of the matches of a pattern whose value is long enough."""
    quick = _QUICK.get(BASE[kind][0] if kind < len(BASE) else "", pattern)
    every = lambda g: F.regexp_extract_all(text, F.lit(quick), F.lit(g))
    gaps = F.split(text, quick, -1)
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), every(0).alias("hit"), *[every(value).alias("value")] * (value > 0)), lambda x: x["hit"].isNotNull())
    of = (lambda x: x["value"]) if value else (lambda x: x["hit"])

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), of(x).alias("value"))

    spans = _let(parts, lambda p: F.when(F.size(p) > 0, _scan(p, F.lit(0), step, _SPANS[6:-1])).otherwise(F.array().cast(_SPANS)))
    found = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(quick), found).otherwise(F.array().cast(_SPANS))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Characters from ``a`` to ``b`` (exclusive) of a text in pieces; takes as long as they and one piece are."""
    div = lambda x: F.floor(x / PIECE).cast("int")
    first, last = div(a), div(b - 1)
    one = F.element_at(pieces, first + 1).substr(a - first * PIECE + 1, b - a)
    head, tail = F.element_at(pieces, first + 1).substr(a - first * PIECE + 1, F.lit(PIECE)), F.element_at(pieces, last + 1).substr(F.lit(1), b - last * PIECE)
    return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(F.concat(head, F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), tail))


def _without(text: Column, spans: Column, instead) -> Column:
    """``text`` with what non-empty ``spans``, in order of their starts, cover replaced.

    ``instead(fresh, size)`` is put in place of a span; ``fresh``: it begins where no earlier one reaches; ``size``: of
    the characters that only it covers.
    """

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = F.greatest(at, x["end"])
        fresh = (at == 0) | (x["start"] >= at)
        return end, F.struct(at.alias("a"), F.greatest(at, x["start"]).alias("b"), fresh.alias("fresh"), (end - F.greatest(at, x["start"])).alias("size"))

    def joined(pieces: Column, steps: Column) -> Column:
        head = F.array_join(F.transform(steps, lambda x: F.concat(_between(pieces, x["a"], x["b"]), instead(x["fresh"], x["size"]))), "")
        end = F.element_at(steps, -1)
        return F.concat(head, _between(pieces, end["b"] + end["size"], F.length(text)))

    steps = _scan(spans, F.lit(0), step, "struct<a:int,b:int,fresh:boolean,size:int>")
    return _let(_pieces(text), lambda pieces: _let(steps, lambda s: joined(pieces, s)))


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token; characters outside of the alphabet do not occur in tokens."""
    model = F.array(*[F.lit(x) for x in table])
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(_codes(value), start, lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + _pair(model, acc["last"], c)).alias("sum")), lambda acc: acc["sum"])


def _codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pair(model: Column, last: Column, c: Column) -> Column:
    return F.when((last > 0) & (c > 0), F.element_at(model, (last - 1) * len(ALPHABET) + c)).otherwise(F.lit(0.0))


def stretches(value: Column, table: list[float], config: MarkovConfig = MarkovConfig()) -> Column:
    """Array of (start, end) of the stretches of a token that the model takes for random.

    A stretch begins where the sum of the ratios is not positive, or has fallen by ``drop`` below its largest value; it
    reaches to that largest value.
    """
    c = config
    model = F.array(*[F.lit(x) for x in table])
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("last"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), none.alias("out"))

    def closed(s: Column) -> Column:
        size = s["end"] - s["start"]
        good = (s["best"] >= c.total) & (size >= c.least_stretch) & (s["best"] >= c.per_pair * (size - 1))
        return F.when(good, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, code: Column) -> Column:
        def moved(total: Column) -> Column:
            anew, more = (total <= 0) | (total <= s["best"] - c.drop), total > s["best"]
            fields = {
                "last": code, "at": s["at"] + 1, "start": F.when(anew, s["at"]).otherwise(s["start"]), "sum": F.when(anew, 0.0).otherwise(total),
                "best": F.when(anew, 0.0).when(more, total).otherwise(s["best"]), "end": F.when(anew | more, s["at"] + 1).otherwise(s["end"]),
                "out": F.when(anew, closed(s)).otherwise(s["out"]),
            }
            return F.struct(*[v.alias(k) for k, v in fields.items()])

        return _let(s["sum"] + _pair(model, s["last"], code), moved)

    return F.aggregate(_pieces(value), state, lambda s, piece: F.aggregate(_codes(piece), s, step), closed)


def find_secrets(docs: DataFrame, table: list[float], config: MarkovConfig = MarkovConfig(), name: str = "secret_spans") -> DataFrame:
    """``docs`` with the column ``name``: array of (start, kind, end, value), by start and kind; kind 3 is the model's."""
    docs = lean(docs)
    c, text, none = config, F.coalesce(F.col("text"), F.lit("")), F.array().cast(_SPANS)
    run = text.rlike(_RUN % min(c.least_length, 20))  # access and hex spans have 20 characters at least
    out = docs.withColumn("__secret_run", run)
    placed = [_placed(text, p, k, g, n) for k, (_, p, g, n) in enumerate(BASE)]
    base = F.array_sort(F.concat(F.when(text.rlike(_ASSIGNED), placed[0]).otherwise(none), *[F.when(F.col("__secret_run"), x).otherwise(none) for x in placed[1:]]))
    out = out.withColumn("__secret_base", base)
    blank = _without(text, F.col("__secret_base"), lambda _, size: F.repeat(F.lit(" "), size))
    out = out.withColumn("__secret_rest", F.when(F.col("__secret_run"), F.when(F.size("__secret_base") > 0, blank).otherwise(text)))
    runs = _placed(F.col("__secret_rest"), CANDIDATE % c.least_length, len(BASE), 0, c.least_length)

    def judged(x: Column) -> Column:
        def part(y: Column, pieces: Column) -> Column:
            # to the ends of the letters and digits around it, if they are near
            left = F.length(F.regexp_extract(_between(pieces, F.greatest(F.lit(0), y["start"] - NEAR), y["start"]), "[A-Za-z0-9]*$", 0))
            right = F.length(F.regexp_extract(_between(pieces, y["end"], F.least(F.length(x["value"]), y["end"] + NEAR)), "^[A-Za-z0-9]*", 0))
            a, b = y["start"] - left, y["end"] + right
            return F.struct((x["start"] + a).alias("start"), F.lit(len(BASE)).alias("kind"), (x["start"] + b).alias("end"), _between(pieces, a, b).alias("value"))

        found = stretches(x["value"], table, c)
        return _let(found, lambda ys: F.when(F.size(ys) > 0, _let(_pieces(x["value"]), lambda p: F.transform(ys, lambda y: part(y, p)))).otherwise(none))

    out = out.withColumn("__secret_new", F.when(F.col("__secret_run"), F.flatten(F.transform(runs, judged))).otherwise(none))
    spans = F.when(F.size("__secret_new") > 0, F.array_sort(F.concat("__secret_base", "__secret_new"))).otherwise(F.col("__secret_base"))
    return out.withColumn(name, spans).drop("__secret_run", "__secret_base", "__secret_rest", "__secret_new")


def kind_name(x: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[0]) for k in BASE], F.lit("markov")), x["kind"] + 1)


def digest_columns(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of what ``find_secrets`` returned."""
    said = lambda x: F.concat_ws(":", kind_name(x), x["start"], x["end"])
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    return docs.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_markov"),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", said), ",").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", spans: str = "secret_spans") -> DataFrame:
    """``docs`` with each span of the column ``spans`` in ``text`` replaced by ``mark``; overlapping spans by one mark."""
    done = _without(F.col("text"), F.col(spans), lambda fresh, _: F.when(fresh, F.lit(mark)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text")))
