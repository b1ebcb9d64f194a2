"""RE2-style patterns for Spark's Java regex functions.

The fixed patterns are written in the RE2 dialect.  Java reads a few of those
constructs differently (Unicode-aware ``\\b``, ``\\s`` with the vertical tab,
``$`` before a final line end, ``.`` refusing several separators, ASCII-only
``(?i)``); ``re2`` rewrites exactly those.
"""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_BOUNDARY = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"

# White space in the Unicode sense (what trimming removes).
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _boundary(pattern: str, i: int) -> str:
    """``\\b`` at ``i``; next to a plain word letter one side is enough."""
    if re.match(rf"[{_WORD}](?![?*{{])", pattern[i + 2 :]):
        return f"(?<![{_WORD}])"
    if re.search(rf"(?<!\\)[{_WORD}]$", pattern[:i]):
        return f"(?![{_WORD}])"
    return _BOUNDARY


def re2(pattern: str) -> str:
    """Java spelling of an RE2 pattern."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif pair == r"\b" and not in_class:
                out.append(_boundary(pattern, i))
            else:
                out.append(pair)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            # '[' and '&&' inside a class are set operators in Java only
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif c == "$":
            out.append(r"\z")
        elif c == ".":
            out.append(r"[^\n]")
        elif pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 3
        else:
            out.append(c)
        i += 1
    return "".join(out)


# Always true, and makes Java step back through a look-behind that opens with it by
# whole characters: it does so only if one above U+FFFF is spelled out in it.
WHOLE = "(?:(?=\U0010ffff)|)"
