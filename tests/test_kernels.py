from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inputs_made import JAVASCRIPT, PYTHON, SIZES, hits

from condensa.kernels import base, block, code, config_files, detect, diffs, html_md, jsoncrush, loglines, mixed, prose, searchhits, secret_tokens, tables, tags
from condensa.kernels.base import Context, Skip


@pytest.mark.parametrize("name", SIZES)
def test_recorded_sizes(name):
    text, query, hints, before, after, saved, status = SIZES[name]
    out = block.shrink_block(text, query, stash_dir="/tmp/stash" if hints else None)
    assert (base.nbytes(text), base.nbytes(out.text), out.tokens_before - out.tokens_after, out.status) == (before, after, saved, status)


@pytest.mark.parametrize("name", SIZES)
def test_invariants(name):
    text, query, *_ = SIZES[name]
    out = block.shrink_block(text, query)
    assert out.tokens_after < out.tokens_before
    assert block.shrink_block(text, query) == out
    if out.status == "lossy":
        assert out.text.endswith(base.marker(out.key)) and dict(out.stash)[out.key] == text
        assert block.shrink_block(out.text).text == out.text  # what is marked stays as it is
    assert secret_tokens.keeps_secrets(text, out.text)


def hinted_back(out: base.Shrunk, text: str) -> str:
    """Put the lines that hints name back in."""
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)

    def lines_of(m):
        return "".join(lines[int(m[2]) - 1 : int(m[2]) - 1 + int(m[1])])

    return re.sub(r'\[\.\.\. (\d+) lines omitted from file "/s/x", starting at line (\d+)\]\n', lines_of, out.text)


LONG_HUNK = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,401 +1,401 @@\n" + "".join(f" context line number {i}\n" for i in range(200)) + "-old\n+new\n" + "".join(f" context line number {i}\n" for i in range(200))


@pytest.mark.parametrize("shrink,text", [(searchhits.shrink_search, hits()), (lambda t, c: base.with_gaps(t, set(diffs.reduced(t)[1]), c.stash_path), LONG_HUNK), (loglines.shrink_log, "\n".join(f"ERROR {i}" if i % 40 == 0 else f"some line of noise {i}" for i in range(200)))])
def test_hints_give_the_original_back(shrink, text):
    out = shrink(text, Context("", None, "/s/x"))
    assert out.omissions and hinted_back(out, text) == text


def test_types():
    cases = {
        "json_array": SIZES["issues"][0], "git_diff": SIZES["diff"][0], "search_results": hits(), "build_output": SIZES["build_log"][0],
        "tabular": SIZES["table"][0], "structured_config": SIZES["config"][0], "source_code": PYTHON, "plain_text": SIZES["prose"][0],
        "html": "<!DOCTYPE html><html><head></head><body><div>x</div></body></html>",
    }
    assert {k: detect.content_type(v) for k, v in cases.items()} == {k: k for k in cases}
    assert detect.content_type(" \n ") == "plain_text" and detect.content_type("42") == "plain_text"
    assert detect.content_type("[owner]\nname = x\nage = 3\n[db]\nport = 1\nhost = y") == "structured_config"
    assert detect.path_language("a/b/Order.java") == "java" and detect.path_language("x.h") is None


def test_json_keeps_literals_and_order():
    text = '[{"z":1.0,"a":1e5,"m":"\\u00e9\\n"},true,null]'
    assert base.dumps(base.loads(text)) == '[{"z":1.0,"a":1e5,"m":"é\\n"},true,null]'
    with pytest.raises(ValueError):
        base.loads("[NaN]")


def test_tables_of_records():
    rows = base.loads(json.dumps([{"b": i, "a": "x,y" if i else 'q"', "n": None if i == 1 else {"k": i, "j": 2}} for i in range(3)]))
    out = jsoncrush.Tables().table(rows, True)
    assert out.splitlines()[0] == "[3]{a:string,b:int,n:json?}"
    flat = base.loads(json.dumps([{"n": {"k": i, "j": "s"}} for i in range(2)]))
    assert jsoncrush.Tables().table(flat, True) == "[2]{n.j:string,n.k:int}\ns,0\ns,1\n"
    assert jsoncrush.discriminator(base.loads(json.dumps([{"t": "a" if i % 2 else "b", "u": "c"} for i in range(6)]))) == "t"
    assert jsoncrush.opaque_kind("ab1" * 200) is not None and jsoncrush.human_size(1280) == "1.2KB"


def test_statistics():
    rows = base.loads(json.dumps([{"v": 5 if i != 7 else 500, "s": "ok" if i != 3 else "odd", "w": i} for i in range(40)]))
    stats = jsoncrush.field_stats(rows)
    assert jsoncrush.outliers(rows, stats) == {7}
    assert 3 in jsoncrush.rare_status_rows(rows)
    assert stats["v"].changes == [7, 8]
    assert jsoncrush.percentile([1, 2, 3, 4], 0.25) == 1.75
    assert [jsoncrush.budget(n) for n in (3, 8, 9, 40, 400)] == [3, 8, 3, 10, 15]
    assert jsoncrush.query_anchors("see 'Order Id' 12345 a@b.c host.name 12") == {"order id", "12345", "a@b.c", "host.name"}


def test_crush_keeps_what_stands_out():
    rows = [{"id": i, "status": "ok", "msg": "fine"} for i in range(100)]
    rows[41]["msg"] = "fatal crash"
    text = json.dumps({"items": rows}) + " " * 10
    out = jsoncrush.shrink_json(text, Context())
    assert "fatal crash" in out.text and "_dropped_count" in out.text


def test_logs():
    assert loglines.level("x ERROR y") == "error" and loglines.level("errors") == "unknown" and loglines.level("Warn: a") == "warn"
    for line in ("$ cargo build", "# make", "++ npm test", "> vite build", "PS C:\\r> npm t", "C:\\r>cargo b", "d@h:~/a$ npm t", "\x1b[32m$ cargo c"):
        assert loglines.command_echo(line), line
    for line in ("Compiling x", "error: x > y", "cost $ 20", "#", "---"):
        assert not loglines.command_echo(line), line
    assert loglines.protected(["head", "n", "$ a \\", "  b \\", "  c", "n"]) == {0, 2, 3, 4}
    assert loglines.dedupe_key("warn 1: at 0xff12 took 33 in /a/b/c") == "warn 1: at ADDR took N in /PATH/c"
    assert loglines.fold_repeats("a\na\nb") == "a  [x2]\nb"
    trace = ["Traceback (most recent call last):", '  File "a.py", line 1', "    x()", "ValueError: x", "done"]
    assert loglines.trace_lines(trace) == [True, True, True, True, False]
    java = ["Exception in thread", "  at a.B.c(B.java:1)", "Caused by: x", "  ... 3 more", "next"]
    assert loglines.trace_lines(java) == [False, True, True, True, False]
    go = ["panic: boom", "", "goroutine 1 [running]:", "main.f(0x1)", "\t/a.go:1 +0x1", "exit"]
    assert loglines.trace_lines(go) == [True] * 5 + [False]


def test_counters():
    assert loglines.log_format(["npm ERR! x", "npm WARN y", "PASS z"]) == "npm" and loglines.log_format(["x"]) == "generic"
    text = "\n".join(["make: start", *[f"warning: item {i} is odd" for i in range(60)], "Traceback (most recent call last):", *[f'  File "/usr/lib/python3/x{i}.py", line {i}' for i in range(30)], "ValueError: x", "end"])
    info = loglines.shrink_log(text, Context()).info
    assert info["warnings_deduped"] == 59 and info["traces_seen"] == info["traces_kept"] == 1 and info["frames_collapsed"] > 0 and info["format"] == "cargo"
    info = searchhits.shrink_search(hits(), Context()).info
    assert info["kept"] + info["matches_dropped_in_files"] + info["matches_dropped_with_files"] == info["matches"] == 143
    info = diffs.reduced(SIZES["diff"][0])[2]
    assert (info["files"], info["hunks"], info["hunks_kept"], info["context_kept"] + info["context_trimmed"]) == (5, 15, 15, info["context"])
    assert prose.rank("pump seal", ["the gauge", "a pump and its seal", "pump"]) == [1, 2, 0]


def test_search_lines():
    assert searchhits.parse_hit("src/a.py:12:x:y") == ("src/a.py", 12, "x:y")
    assert searchhits.parse_hit("C:\\a\\b.py:3:z") == ("C:\\a\\b.py", 3, "z")
    assert searchhits.parse_hit("src/a-b.py-7-context") == ("src/a-b.py", 7, "context")
    assert searchhits.parse_hit("no match here") is None
    assert searchhits.any_word("two errors", ["error"]) and not searchhits.any_word("terror", ["error"])


def test_diff_noise():
    body = "".join(f"+line {i}\n" for i in range(60))
    text = f"diff --git a/yarn.lock b/yarn.lock\n--- a/yarn.lock\n+++ b/yarn.lock\n@@ -1,2 +1,60 @@\n{body}"
    assert "[diff_noise: lockfile hunks dropped (61 lines)]" in diffs.noise_free(text)


def test_text():
    assert prose.segments("One. Two! 好。坏") == ["One.", "Two!", "好。", "坏"]
    assert prose.words("Ａb 漢字 x_1") == ["ab", "漢", "字", "x_1"]
    assert prose.relevance([["a", "b"], ["c"]], "a")[0] == 1.0
    folded = prose.fold_blocks("# A\n\nsame\n\nsame\n\n# B\n\nsame\n")
    assert folded.text == "# A\n\nsame\n\n# B\n\nsame\n"
    assert "todo: keep" in prose.fold_blocks("todo: keep\n\ntodo: keep\n").text


def test_html():
    page = "<html><body><article><h1>T &amp; x</h1><p>a <b>b</b> <a href='u'>l</a></p><nav>no</nav><ul><li>i</li></ul><pre>c\n d</pre></article></body></html>"
    assert html_md.markdown(html_md.main_fragment(page)) == "# T & x\n\na **b** [l](u)\n\n- i\n\n```\nc\n d\n```"


def test_tables_and_configs():
    assert tables.parse_delimited('a,b\n"x, ""y""",2\n\n', ",") == [["a", "b"], ['x, "y"', "2"]]
    with pytest.raises(Skip):
        tables.parse_delimited('a,b\n"x,2\n', ",")
    with pytest.raises(Skip):
        config_files.shrink_config("a: |\n  # text\nb: 1\nc: 2\nd:\n  e: 1\n# c\n", Context())


def test_code():
    out = code.fold(PYTHON, "a.py")
    assert '    """First line."""\n    # ... 4 lines omitted\n' in out.text and "    x4 = a + 4\n    # ... 26 lines omitted\n" in out.text
    js = code.fold(JAVASCRIPT, "a.js").text
    assert "  const x4 = a * 4;\n  // ... 36 lines omitted\n}\n" in js and "    this.y4 = z + 4;\n    // ... 15 lines omitted\n  }\n}\n" in js
    assert [code.language(x) for x in ("package main\nfunc main() {}", "fn main() {}", "def f():", "public class A {}", "#include <a>", "const x = 1")] == ["go", "rust", "python", "java", "c", "javascript"]
    with pytest.raises(Skip):
        code.fold("function f() {\n" + "  x = '{';\n" * 60, "a.js")  # never closes
    for lang, text in {"go": "package a\n\nfunc f(x int) int {\n" + "".join(f"\ty{i} := x + {i}\n" for i in range(40)) + "\treturn 1\n}\n", "rust": "impl A {\n    fn f(&self) -> u32 {\n" + "".join(f"        let y{i} = {i};\n" for i in range(40)) + "        1\n    }\n}\n", "java": "public class A {\n    int f(int x) {\n" + "".join(f"        int y{i} = {i};\n" for i in range(40)) + "        return 1;\n    }\n}\n"}.items():
        assert "lines omitted" in code.fold(text).text, lang


def test_tags():
    text = 'x <note a="b>c">in <b>y</b> <note>z</note></note> t <cite-x/> </gone>'
    p = tags.protect(text)
    assert p.text == "x {{CMPR_TAG_0}} t {{CMPR_TAG_1}} </gone>" and tags.restore(p.text, p.wraps) == text
    assert p.orphan_closes == 1 and tags.restore("lost", p.wraps) == "lost"
    assert tags.protect("{{CMPR_TAG_ <q1>x</q1>").collision


def test_secrets():
    for good in ("sk-ant-api03-9Xq2aBcDeFgH12345", "0123456789abcdef0123456789abcdef01234567", "credential=ghp_16C7e42F292c6912E7710c838347Ae178B4a"):
        assert secret_tokens.has_secret(good)
    assert not secret_tokens.has_secret("erberbeeinheitkeiter") and not secret_tokens.secret_tokens("calculateMonthlyInvoiceTotalV2ForOrder", True)
    text = "function f() {\n" + "  a = 1;\n" * 40 + '  k = "ghp_16C7e42F292c6912E7710c838347Ae178B4a";\n' + "  b = 2;\n" * 40 + "}\n"
    assert block.shrink_block(text, source_path="a.js").status == "reverted"


def test_sections():
    text = "intro line\n" + json.dumps([1, 2]) + "\noutro"
    assert [(s.kind, s.first, s.last) for s in mixed.sections(text)] == [("plain_text", 0, 0), ("json_array", 1, 1), ("plain_text", 2, 2)]
    span = json.dumps([{"a": i} for i in range(100)])
    assert mixed.json_spans("x " + span + " y") == [(2, 2 + len(span))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a b c", "ERROR x", "", "{", '{"a": 1}', "- y", "k: v", "src/a.py:3:z", "<x>t</x>", "日本語。", "f(x) {", "}", "+ q", "@@ -1,2 +1,2 @@", "| a | b |", "|---|---|"]), max_size=120), st.integers(0, 5))
def test_any_text_is_safe(lines, seed):
    random.Random(seed).shuffle(lines)
    text = "\n".join(lines)
    out = block.shrink_block(text, "x y", min_bytes=1)
    assert out.tokens_after <= out.tokens_before and out.status in ("unchanged", "lossless", "lossy", "reverted")
    if out.status in ("unchanged", "reverted"):
        assert out.text == text


@pytest.mark.parametrize("kind", ["function", "functions", "tags", "brackets"])
def test_long_blocks_take_time_in_proportion(kind):
    import time

    text = {
        "function": "function f(a) {\n" + "".join(f"  const x{i} = a * {i};\n" for i in range(42_000)) + "  return 1;\n}\n",
        "functions": "".join(f"function f{i}(a) {{\n" + "".join(f"  const x{j} = a;\n" for j in range(12)) + "}\n" for i in range(4_300)),
        "tags": "".join(f"<note>{i}</note> x " for i in range(50_000)),
        "brackets": "\n".join(f"the [pump] of shift {i} {{is}} out of order" for i in range(25_000)),
    }[kind]
    start = time.time()
    out = block.shrink_block(text, "pump", "a.js" if kind[:8] == "function" else None)
    assert out.tokens_after <= out.tokens_before and time.time() - start < 15


def test_types_are_found_once(monkeypatch):
    from collections import Counter

    seen = Counter()
    for module in (block, mixed):
        monkeypatch.setattr(module, "content_type", lambda x, f=module.content_type: seen.update([x]) or f(x))
    text = "\n".join(f"Line {i} says that nothing was found in the hall, and that somebody will look again." for i in range(12))
    assert block.shrink_block(text, "hall").status == "lossy"
    assert max(seen.values()) <= 2 and seen[text] <= 2  # by the block and by its only section
