"""Ignore rules of source trees as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is ignored unless a later rule takes it back.
DEFAULTS = [
    "node_modules/", ".git/", "vendor/", "venv/", ".venv/", "__pycache__/", "dist/", "build/", "out/", "coverage/", ".next/", ".cache/", ".turbo/", "target/", "obj/", "*.lock",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp3", "*.mp4", "*.pdf",
    "*.zip", "*.tar", "*.gz", "*.min.js", "*.min.css", "*.map", "*.generated.*", ".idea/", ".vscode/", "LICENSE", ".gitignore", ".editorconfig", ".prettierrc", ".eslintrc*",
    "*.log",
]


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """Regular expression of one ignore line and whether it takes back; None for blanks and comments."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), negated


def is_ignored(path: Column, *layers: list[str]) -> Column:
    """Whether a relative path is ignored; layers come in order and the last line that matches decides."""
    out = F.lit(False)
    for lines in layers:
        for line in lines:
            rule = pattern_regex(line)
            if rule:
                out = F.when(path.rlike(rule[0]), not rule[1]).otherwise(out)
    return out


def user_ignored(path: Column, user: list[str]) -> Column:
    """Ignored because of the user's lines, not by the defaults alone."""
    return is_ignored(path, DEFAULTS, user) & ~is_ignored(path, DEFAULTS)
