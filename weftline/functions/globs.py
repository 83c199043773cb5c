"""Glob patterns as anchored regular expressions for ``rlike``."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` stay within a path component, ``**`` stands for whole components, ``\\`` escapes."""
    parts = pattern.split("/")
    out = []
    for at, part in enumerate(parts):
        if part == "**":
            out.append("(?:[^/]+/)*" + ("[^/]+" if at == len(parts) - 1 else ""))
            continue
        if "**" in part:
            raise ValueError("'**' must be a whole path component")
        text, i = "", 0
        while i < len(part):
            c = part[i]
            if c == "\\" and i + 1 < len(part):
                i += 1
                text += re.escape(part[i])
            else:
                text += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
            i += 1
        out.append(text + ("/" if at < len(parts) - 1 else ""))
    return "^" + "".join(out) + "$"
