from __future__ import annotations

import json

import pandas as pd
import pytest
from inputs_made import SIZES, hits
from pyspark.sql import functions as F

from condensa import api
from condensa.functions import core, detect, signals
from condensa.kernels import base, block, diffs, loglines, prose, secret_tokens
from condensa.kernels import detect as k
from condensa.operators import bloat, lines, ranking, schema_csv, stats
from condensa.plans.compress import compress_blocks, compress_requests, publish
from condensa.sources import requests
from condensa.sources.stash import Stash
from condensa.streaming.stream import stream_blocks, stream_requests


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


TEXTS = [v[0] for v in SIZES.values()] + ["", " ", "42", "<!DOCTYPE html><html><body><p>x</p></body></html>", "a: 1\nb: 2\nc:\n  - x", "Ünïcode 日本語。" * 40]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_native_and_kernel_agree(spark, texts):
    got = texts.select(
        "id", core.token_estimate("text"), core.stash_key("text"), F.size(core.secret_tokens("text")), detect.html_confidence("text"), ranking.tokens(F.col("text")).alias("w"), ranking.segments(F.col("text")).alias("s")
    ).collect()
    for i, tokens, key, secrets, html, words, segments in got:
        t = TEXTS[i]
        assert (tokens, key) == (base.tokens(t), base.stash_key(t)) and words == prose.words(t)
        assert secrets == sum(secret_tokens.secret_tokens(t).values()) and abs(html - k.html_confidence(t)) < 1e-9
        if not any(len(s) > prose.SOFT_CUT and prose._CJK.search(s) for s in segments):
            assert segments == prose.segments(t)


def test_native_types(spark, texts):
    got = dict(texts.select("id", detect.content_type("text")).collect())
    for i, t in enumerate(TEXTS):
        # the kernel also finds JSON within other text
        if not (k.json_payload(t) and not t.strip().startswith(("[", "{"))):
            assert got[i] == k.content_type(t), t[:80]


def test_lines_agree_with_the_kernel(spark):
    text = "\n".join(["$ make", *[f"ERROR at 0xf{i} in /a/b/{i}" if i % 9 == 0 else f"warning: item {i} in /var/x/{i}" if i % 7 == 0 else f"INFO step {i}" for i in range(220)], "=== end"])
    df = lines.explode_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    own = {x.at for x in loglines.select(loglines.parse(text.split("\n")))}
    assert {r.pos for r in lines.log_select(df).where("kept").collect()} == own
    assert [r.k for r in df.orderBy("pos").select(signals.dedupe_key("line").alias("k")).collect()] == list(map(loglines.dedupe_key, text.split("\n")))


def test_diff_agrees_with_the_kernel(spark):
    text = SIZES["diff"][0]
    df = lines.explode_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert {r.pos for r in lines.diff_context(lines.diff_rows(df)).where("kept").collect()} == set(diffs.reduced(text)[1])


def test_slices(spark):
    df = spark.createDataFrame([("a\r\nb\n\nc",), ("x\n",), ("",)], "text string")
    got = df.select(core.line_slice("text", 1, 2).alias("s")).collect()
    assert [(r.s.text, r.s.total_lines, r.s.has_more) if r.s else None for r in got] == [("a\r\nb\n", 4, True), ("x\n", 1, False), None]
    with pytest.raises(ValueError):
        core.line_slice("text", 0, 1)


def test_statistics_on_edges(spark):
    empty = spark.createDataFrame([], "g string, o int, x double")
    for f in (stats.sigma_outliers(empty, "g", "x"), stats.change_points(empty, "g", "o", "x"), stats.rare_values(empty, "g", "x"), stats.top_n(empty, "g", "x", "o", 2)):
        assert f.count() == 0
    same = spark.createDataFrame([("a", i, 1.0) for i in range(20)], "g string, o int, x double")
    assert stats.sigma_outliers(same, "g", "x").count() == 0 and stats.window_jumps(same, "g", "o", "x").count() == 0


def test_schema_table(spark):
    df = spark.createDataFrame([(1, 2, "x,y"), (1, 1, None)], "g int, o int, s string")
    assert schema_csv.render(df, ["g"], "o", ["o", "s"]).first()["table"] == '[2]{o:int,s:string?}\n1,\n2,"x,y"\n'


def test_signals(spark):
    df = spark.createDataFrame([("an Error here",), ("# title",), ("fix it",), ("plain",), ("auth token",)], "line string")
    assert [r[0] for r in df.select(signals.keyword_category("line")).collect()] == ["error", "markdown", "importance", None, None]
    assert [r[0] for r in df.select(signals.keyword_category("line", "diff")).collect()][4] == "security"
    assert df.select(signals.tiered((F.lit(0.2), F.lit(0.1)), (F.lit(0.9), F.lit(0.8)))).first()[0] == 0.9
    assert df.select(bloat.json(F.lit("[1,2,3,4,5,6]"))).first()[0] == pytest.approx(0.4)


LONG = SIZES["issues"][0]
BODIES = {
    "anthropic": {
        "anthropic_version": "x",
        "messages": [
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "0", "content": LONG, "cache_control": {"type": "ephemeral"}}]},
            {"role": "assistant", "content": [{"type": "text", "text": LONG}]},
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": LONG}, {"type": "tool_result", "tool_use_id": "2", "is_error": True, "content": LONG}, {"type": "text", "text": "q"}]},
        ],
    },
    "chat_completions": {"model": "m", "messages": [{"role": "user", "content": LONG}, {"role": "tool", "tool_call_id": "a", "content": LONG}, {"role": "tool", "tool_call_id": "b", "content": [{"type": "text", "text": LONG}]}]},
    "responses": {"model": "m", "input": [{"role": "user", "content": "x"}, {"type": "function_call_output", "call_id": "c", "output": LONG}, {"type": "function_call_output", "call_id": "d", "output": [{"type": "input_text", "text": LONG}]}]},
    "unknown": {"other": 1.50},
    "responses ": {"input": "just text"},
}


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in BODIES.items()], "request_id string, body string")


def test_formats_and_candidates(spark, bodies):
    assert all(r.request_id.strip() == r.f for r in bodies.select("request_id", requests.detect_format(F.col("body")).alias("f")).collect())
    found = [(r.request_id, r.msg_idx, r.part_idx, r.field) for r in requests.candidates(bodies).collect()]
    assert sorted(found) == [
        ("anthropic", 2, 0, "content"), ("chat_completions", 1, -1, "content"), ("chat_completions", 2, 0, "text"),
        ("responses", 1, -1, "output"), ("responses", 2, 0, "text"),
    ]


def test_requests_are_shrunk_in_place(spark, bodies, tmp_path):
    out, counts = compress_requests(bodies, Stash(spark, str(tmp_path / "s")))
    got = {r.request_id: r.body for r in out.collect()}
    assert got["unknown"] == json.dumps(BODIES["unknown"]) and got["responses "] == json.dumps(BODIES["responses "])
    a, before = json.loads(got["anthropic"])["messages"], BODIES["anthropic"]["messages"]
    assert a[0] == before[0] and a[1] == before[1] and a[2]["content"][1:] == before[2]["content"][1:]
    assert a[2]["content"][0]["content"].startswith("[180]{")
    assert {r.request_id: r.compressed for r in counts.collect()} == {"anthropic": 1, "chat_completions": 2, "responses": 2}


def test_publish_and_retrieve(spark, texts, tmp_path):
    stash = Stash(spark, str(tmp_path / "s"))
    out = publish(compress_blocks(texts), stash).collect()
    for r in out:
        want = block.shrink_block(TEXTS[r.id])
        assert (r.output, r.status) == (want.text, want.status)
        if r.status == "lossy":
            assert stash.retrieve(r.stash_key) == TEXTS[r.id]
    later = F.current_timestamp() + F.expr("interval 2 hours")
    key = next(r.stash_key for r in out if r.stash_key)
    assert stash.retrieve(key, later) is None and stash.purge_expired(later) >= 1 and stash.retrieve(key) is None
    assert stash.purge_expired(later) == 0


def test_a_broken_stash_changes_nothing_lossy(spark, texts, tmp_path):
    class Broken(Stash):
        def put(self, rows, now=None):
            raise OSError("no space")

    for r in publish(compress_blocks(texts), Broken(spark, str(tmp_path / "b"))).collect():
        assert r.status != "lossy" and (r.status == "lossless" or r.output == r.text)


def test_a_forgetful_stash_changes_nothing_lossy(spark, texts, tmp_path):
    class Forgets(Stash):
        def put(self, rows, now=None):
            super().put(rows.limit(0), now)

    assert not {r.status for r in publish(compress_blocks(texts), Forgets(spark, str(tmp_path / "f"))).collect()} & {"lossy"}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    stash = Stash(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a" * 24, "x"), ("b" * 24, "y"), ("a" * 24, "x")], "key string, content string")
    for _ in range(3):
        stash.put(rows)
    assert stash.table().count() == 2
    later = F.current_timestamp() + F.expr("interval 20 minutes")  # beyond half of the time to live: stored anew
    stash.put(rows.limit(1), later)
    assert stash.table().count() == 3 and stash.live(later).count() == 2
    assert {r.key for r in stash.has(spark.createDataFrame([("b" * 24,), ("c" * 24,)], "key string")).collect()} == {"b" * 24}


def test_a_purge_that_fails_loses_nothing_live(spark, tmp_path, monkeypatch):
    stash, ago = Stash(spark, str(tmp_path / "s")), lambda m: F.current_timestamp() - F.expr(f"interval {m} minutes")
    for k, minutes in enumerate((300, 200, 100, 20, 1)):
        stash.put(spark.createDataFrame([(f"{k}" * 24, str(k))], "key string, content string"), ago(minutes))

    class Breaks:
        def __init__(self, fs):
            self.fs, self.left = fs, 1

        def delete(self, *a):
            if not self.left:
                raise OSError("lost")
            self.left -= 1
            return self.fs.delete(*a)

    place = stash._place
    with monkeypatch.context() as m:
        m.setattr(Stash, "_place", lambda self: (lambda p, fs: (p, Breaks(fs)))(*place()))
        m.setattr(Stash, "exists", lambda self: True)
        with pytest.raises(OSError):
            stash.purge_expired()
    live = lambda: {r.key[0] for r in stash.live().collect()}
    assert live() == {"3", "4"} and stash.table().count() == 4
    assert stash.purge_expired() == 2 and live() == {"3", "4"} and stash.purge_expired() == 0


def test_line_hints_lead_to_the_lines(spark, tmp_path):
    import re

    e, text = api.Condenser.create(spark, str(tmp_path / "s")), hits()
    row = e.text(text, "price")
    found = re.findall(r'(\d+) lines omitted from file "([^"]+)", starting at line (\d+)', row["output"])
    assert row["status"] == "lossy" and found and {name for _, name, _ in found} == {e.stash.file_path(row["stash_key"])}
    for count, name, start in found[:3]:
        lines = text.split("\n")[int(start) - 1 : int(start) - 1 + int(count)]
        assert e.retrieve_lines(name, int(start), int(count)).text.rstrip("\n") == "\n".join(lines)
    assert e.retrieve(found[0][1]) == text
    assert "omitted from file" not in api.Condenser.create(spark, str(tmp_path / "s"), hints=False).text(text, "price")["output"]


def test_rare_values_count_nulls_and_containers(spark):
    import json

    from condensa.kernels import jsoncrush

    for odd in (None, {"k": 1}, [2]):
        mixed = [{"s": "ok", "i": i} for i in range(36)] + [{"s": odd, "i": 90 + i} for i in range(4)]
        plain = jsoncrush.rare_status_rows(base.loads(json.dumps(mixed)))
        assert plain == (set() if odd is None else set(range(36, 40)))  # with a null alone there is one value only
    both = [{"s": "ok"}] * 36 + [{"s": None}] * 3 + [{"s": "no"}]
    assert jsoncrush.rare_status_rows(base.loads(json.dumps(both))) == {36, 37, 38, 39}
    df = spark.createDataFrame([("g", x["s"]) for x in both] + [("h", "ok")] * 9 + [("h", None)], "g string, s string")
    assert rows(stats.rare_values(df, "g", "s")) == [("g", "__none__", 3), ("g", "no", 1)]


def test_clusters_whose_names_collide_stay_apart(spark):
    heads = ["message 43683", "message 116758"]  # both are cluster dca35a58
    df = spark.createDataFrame([(i, "g", m) for i, m in enumerate([heads[0]] * 3 + [heads[1]] * 3 + ["", "", "", None, None, None])], "id int, g string, m string")
    got = {r.id: r.cluster for r in stats.cluster_sample(df, "g", "m", "id").collect()}
    assert sorted(got) == [0, 1, 3, 4, 6, 7, 9, 10] and {got[i] for i in (0, 1, 3, 4)} == {"dca35a58"} and got[9] is None is not got[6]


def test_bad_keys_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="24 hex"):
        Stash(spark, str(tmp_path / "k")).put(spark.createDataFrame([("../x", "y")], "key string, content string"))


def test_one_python_node(spark, texts):
    plan = compress_blocks(texts).where("result.status = 'lossy'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batches_of_the_kernel_are_bounded(spark, texts):
    """However large the blocks are; a size that the session has set stays."""
    from condensa.plans.compress import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    one, other = spark.newSession(), spark.newSession()
    compress_blocks(one.createDataFrame(texts.collect(), texts.schema))
    sizes = one.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), F.lit(20_000)).alias("t")).mapInPandas(lambda it: (pd.DataFrame({"n": [x.t.str.len().sum()]}) for x in it), "n long")
    assert sizes.agg(F.max("n")).first()[0] <= 5 << 20
    other.conf.set(key, "1234567")
    small_batches(other)
    assert other.conf.get(key) == "1234567"


def test_layout_does_not_matter(spark, texts):
    a = rows(compress_blocks(texts.repartition(1)).select("id", "result.text"))
    assert a == rows(compress_blocks(texts.repartition(8)).select("id", "result.text"))


def test_streams(spark, texts, bodies, tmp_path):
    src = str(tmp_path / "in")
    texts.write.parquet(src)
    q = stream_blocks(spark.readStream.schema(texts.schema).parquet(src), Stash(spark, str(tmp_path / "s")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(TEXTS) and got.where("status = 'lossless'").count() > 0
    src = str(tmp_path / "rin")
    bodies.write.parquet(src)
    q = stream_requests(spark.readStream.schema(bodies.schema).parquet(src), Stash(spark, str(tmp_path / "s2")), str(tmp_path / "rout"), str(tmp_path / "rcp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "rout")).count() == len(BODIES)


def test_api(spark, tmp_path):
    e = api.Condenser.create(spark, str(tmp_path / "s"))
    r = e.text(SIZES["diff"][0], "timeout")
    assert r["status"] == "lossy" and e.retrieve(r["stash_key"]) == SIZES["diff"][0]
    assert e.retrieve_lines(r["stash_key"], 1, 1).text.startswith("diff --git")
    body, counts = e.request(json.dumps(BODIES["responses"]))
    assert counts["compressed"] == 2 and "[180]{" in body
    api.register(spark)
    assert spark.sql("select condensa_tokens('abcd'), length(condensa_key('x')), condensa_type('[1]')").first() == (2, 24, "json_array")
