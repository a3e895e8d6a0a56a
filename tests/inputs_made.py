"""Blocks of text that tests shrink, with the sizes that are expected of some."""

from __future__ import annotations

import json


def compact(value) -> str:
    return json.dumps(value, separators=(",", ":"))


def issues() -> str:
    return compact([{"nr": i, "subject": f"ticket {i} " + ("crash while saving" if i % 13 == 0 else "wording of a label"), "phase": "new" if i % 40 == 0 else "done", "tags": ["ui", "text"]} for i in range(180)])


def pretty() -> str:
    return json.dumps([{"row": i, "tool": f"drill {i}", "in_stock": False} for i in range(70)], indent=4)


def build_log() -> str:
    lines = ["  fetching sources", *(f"  building part{i:02d} release {i}.1" for i in range(45)), "warning: option --fast is old"]
    lines += [f"info: page {i} of the handbook has more on --fast" for i in range(25)]
    return "\n".join([*lines, "error: part44 does not link", "  at main.c:10:4", "error: stopped after 1 problem"])


def hits() -> str:
    return "\n".join(f"lib/unit{f:02d}.py:{f * 50 + h}:        total += price_of(item_{h}, currency)" for f in range(11) for h in range(13))


def diff() -> str:
    out = []
    for f in range(5):
        out += [f"diff --git a/lib/m{f}.py b/lib/m{f}.py", f"--- a/lib/m{f}.py", f"+++ b/lib/m{f}.py"]
        for h in range(3):
            at = f * 500 + h * 90 + 1
            out.append(f"@@ -{at},19 +{at},19 @@ def step_{h}():")
            out += [f"     before_{n} = read({f}, {n})  # same as it was" for n in range(9)]
            out += [f"-    wait({f} + {h})", f"+    wait({f} * {h})"]
            out += [f"     check(before_{n}, {h})  # same as it was" for n in range(9)]
    return "\n".join(out)


def mixed() -> str:
    rows = [{"n": i, "host": f"box{i}", "state": "lost" if i == 50 else "up"} for i in range(150)]
    return "\n".join(["$ list-hosts --json", compact(rows), "150 hosts in 2 racks"])


REPEATED = "The night shift walked both halls and read every gauge. Nothing was out of range, and no valve had to be touched."


def prose() -> str:
    first = "Notes of the plant for October. What is said twice should be read once, and what is said once should stay."
    return "\n\n".join([first, *[REPEATED] * 12, "Decision: keep the second pump running until the seal has been replaced."])


def prose_with_secret() -> str:
    parts = [
        "The gateway takes orders over a small set of routes. Callers sign each request, and limits count by shop and hour. Clients that are told to wait should wait twice as long each time.",
        "For the rehearsal: api_key=rk-live-Zt81mQx7Lp3wVb9sKd2fHn6yRc4gTa5u. It must not leave this page, and it must not be lost from it either.",
    ]
    parts += [f"Year {i} of the archive: letters were sorted by hand. Every drawer had a list, and every list had a gap. The keeper wrote both down and went home." for i in range(11)]
    return "\n\n".join(parts)


def config() -> str:
    parts = "".join(f"\n# How worker {i} is run.\nworker_{i}:\n  command: run --slot {i}\n  copies: 2\n  port: {9000 + i}\n" for i in range(16))
    return f"---\n# Settings of the test bench.\nbench:\n  name: small\n  room: basement\n{parts}\n# Nothing below is used yet.\nlater:\n  when: never\n"


def table() -> str:
    rows = [f"| {i} | " + ('"bolt, long"' if i == 120 else f"bolt{i}") + f" | shelf 4 | {'gone' if i == 77 else 'there'} | {10 + i % 20} |" for i in range(140)]
    return "\n".join(["| nr | part | place | state | count |", "| --- | --- | --- | --- | --- |", *rows])


PYTHON = "import os\n\n" + "".join(f'def f{k}(a):\n    """First line.\n\n    More of it.\n    """\n' + "".join(f"    x{i} = a + {i}\n" for i in range(30)) + "    return x1\n\n\n" for k in range(3))
JAVASCRIPT = "function foo(a, b) {\n" + "".join(f"  const x{i} = a * {i};\n" for i in range(40)) + "  return x1;\n}\n\nclass A {\n  bar(z) {\n" + "".join(f"    this.y{i} = z + {i};\n" for i in range(20)) + "  }\n}\n"

#: name: text, query, whether line hints are asked for, bytes before and after, tokens saved, status.
SIZES = {
    "issues": (issues(), "", False, 15796, 10447, 1604, "lossless"),
    "pretty": (pretty(), "", False, 6002, 1280, 1417, "lossless"),
    "build_log": (build_log(), "", False, 2724, 858, 560, "lossless"),
    "diff": (diff(), "wait", True, 13141, 4154, 2696, "lossy"),
    "mixed": (mixed(), "", False, 5674, 1961, 1114, "lossless"),
    "prose": (prose(), "gauge range", False, 1560, 327, 369, "lossy"),
    "secret": (prose_with_secret(), "limits", False, 1927, 1019, 273, "lossy"),
    "config": (config(), "", False, 1469, 1084, 115, "lossy"),
    "table": (table(), "gone count", False, 5593, 3950, 493, "lossy"),
}
