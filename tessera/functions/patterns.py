"""Translators of GLOB and strftime patterns, applied to literals when a statement is read."""

from __future__ import annotations

import re

# Strftime directives and the letters of Spark's date patterns.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%%": "%"}


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for ``*``, ``?``, ``[abc]``, ``[a-z]``, ``[!a]`` and ``[^a]``; case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[i + 1 : end]
            negated = inside[0] in "!^"
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", inside[negated:])
            out.append(f"[{'^' if negated else ''}{inside}]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c != "_" else c)
        i += 1
    return "^(?s)" + "".join(out) + r"\z"


def glob_expression(pattern: str) -> str:
    """The same for a pattern that is an expression: a chain of replacements in SQL. Classes may not hold ``*`` or ``?``."""
    escaped = rf"regexp_replace({pattern}, '([.+(){{}}|$\\\\])', '\\\\$1')"
    escaped = rf"regexp_replace({escaped}, '(?<!\\[)\\^', '\\\\^')"
    return rf"concat('^(?s)', replace(replace(replace({escaped}, '[!', '[^'), '*', '.*'), '?', '.'), '\\z')"


def strftime_to_pattern(fmt: str) -> str:
    """Spark's pattern for a strftime format; directives without a counterpart are refused."""
    out = []
    for part in re.findall(r"%.|[^%]+|%", fmt):
        if part[0] == "%" and part not in DIRECTIVES:
            raise ValueError(f"strftime directive {part} isn't supported")
        if part in DIRECTIVES:
            out.append(DIRECTIVES[part])
        else:
            out.append("'" + part.replace("'", "''") + "'" if re.search("[A-Za-z']", part) else part)
    return "".join(out)
