"""Regular expressions that mean the same here as in ECMAScript.

Patterns in this library are written once in the ECMAScript/RE2 common subset.
Java differs in one way that matters on accented text: ``\\b`` is Unicode-aware,
so ``étoken`` has no boundary before ``token``.  :func:`portable` spells the
ASCII boundary out with look-around.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
#: leading, trailing or both: one cheaper assertion is enough when the
#: neighbouring pattern character is known to be a word character
_BEFORE_WORD = f"(?<!{_WORD})"
_AFTER_WORD = f"(?!{_WORD})"


def portable(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite ``\\b`` to its ASCII meaning and add the flag prefix."""
    out: list[str] = []
    i = 0
    in_class = False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not in_class:
            nxt = pattern[i + 2 : i + 3]
            prev = pattern[i - 1 : i]
            escaped_prev = i >= 2 and pattern[i - 2] == "\\"
            if re.match(_WORD, nxt or " "):
                out.append(_BEFORE_WORD)
            elif re.match(_WORD, prev or " ") and not escaped_prev:
                out.append(_AFTER_WORD)
            else:
                out.append(_BOUNDARY)
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(two)
            i += 2
            continue
        if pattern[i] == "[":
            in_class = True
        elif pattern[i] == "]":
            in_class = False
        out.append(pattern[i])
        i += 1
    body = "".join(out)
    return f"(?i){body}" if ignore_case else body


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``RegExp.test`` on a column."""
    return col.rlike(portable(pattern, ignore_case))


def any_match(col: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """True if one of the patterns matches: a single alternation, one scan of the value."""
    return matches(col, "|".join(f"(?:{p})" for p in patterns), ignore_case)


_PREFIXES = [r"(^|/)", r"(?:^|/)", r"\."]


def factored(patterns: list[str]) -> str:
    """One alternation with common prefixes pulled out.

    ``(^|/)docs/`` and fifty like it cost fifty attempts at every character of a path;
    behind one shared ``(?:^|/)`` they are tried at segment starts only.
    """
    rest: list[str] = []
    shared: dict[str, list[str]] = {}
    for p in patterns:
        prefix = next((x for x in _PREFIXES if p.startswith(x)), None)
        tail = p[len(prefix) :] if prefix else p
        if prefix is None:
            rest.append(f"(?:{p})")
        else:
            key = r"\." if prefix == r"\." else r"(?:^|/)"
            shared.setdefault(key, []).append(f"(?:{tail})")
    return "|".join([f"{key}(?:{'|'.join(tails)})" for key, tails in shared.items()] + rest)


def group(col: Column, pattern: str, index: int = 1, ignore_case: bool = False) -> Column:
    """Capture group, or NULL when the pattern does not match."""
    found = F.regexp_extract(col, portable(pattern, ignore_case), index)
    return F.when(matches(col, pattern, ignore_case), found)


def js_trim(col: Column) -> Column:
    """``String.trim``: all ASCII white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")
