"""Configuration files: comments and blank lines are left out."""

from __future__ import annotations

import re

from condensa.kernels.base import Context, Shrunk, Skip, nbytes, rust_lines
from condensa.kernels.detect import config_flavor
from condensa.kernels.loglines import gaps


def removable(line: str, flavor: str) -> bool:
    return line[:1] in ("#", ";") and line != "" if flavor == "ini" else not line.strip() or line.lstrip()[0] == "#"


def safe(text: str, flavor: str) -> bool:
    """No block text in which a comment line could be content."""
    if flavor == "yaml":
        return not any(re.match(r"[^:]*:\s*[|>]", x) for x in rust_lines(text))
    return flavor == "ini" or ('"""' not in text and "'''" not in text)


def shrink_config(text: str, ctx: Context) -> Shrunk:
    flavor = config_flavor(text)
    if flavor is None or not safe(text, flavor):
        raise Skip
    lines = rust_lines(text)
    kept = [i for i, x in enumerate(lines) if not removable(x, flavor)]
    gone = len(lines) - len(kept)
    out = "\n".join(lines[i] for i in kept)
    out += ("\n" if text.endswith("\n") and out else "") + f"[{gone} comment/blank lines elided]"
    if not gone or nbytes(out) >= nbytes(text):
        raise Skip
    return Shrunk(out, gaps(set(kept), len(lines)))
