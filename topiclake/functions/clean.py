"""Cleaning of post text with built-in string expressions, so that it stays inside the JVM.

The order of the steps is part of the result. Patterns do not backtrack on junk such as thousands of
dots or signs. Two of them still take time quadratic in the length of one odd stretch: opening angle
brackets without a closing one (C3), and one letter repeated inside a word (C11).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's ``str.split`` sees it.
SPACE = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same as the inside of a class that begins with an outer range, which spares plain letters a walk
# through all ranges; and the same without the blank.
_SPACE = rf"\x09-\x20\x{{85}}-\x{{3000}}&&[{SPACE}]"
_NOT_BLANK = rf"\x09-\x1F\x{{85}}-\x{{3000}}&&[{SPACE}]"
# Code point ranges deleted as emoji and symbols.
EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{1F201}-\x{1F251}"
    r"\x{2B06}-\x{2B07}\x{1F200}-\x{1F251}\x{203C}-\x{32FF}\x{2702}-\x{27B0}"
)
# Punctuation deleted everywhere.
PUNCTUATION = "?!:,./\"“”’‘();_#+&*$@…»|" + "•'—[]%"
# Signs trimmed from both ends of every word.
SIGNS = "!@#$%^&*()_+-=,.<>?/;:'\"[]{}|`~…“”’‘"
# Smileys.
HAPPY = r"[8:=;]['\-]?[)dDp]"
SAD = r"[8:=;]['\-]?[(\\/]"


def _escaped(chars: str) -> str:
    return "".join("\\" + c if c.isascii() else c for c in chars)


_SIGN = f"[{_escaped(SIGNS)}]"


def _sub(pattern: str, replacement: str = "") -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, replacement)


# (step, expression, reachable). The heart and the possessive can never match: every digit and
# every apostrophe is gone by then. They stay listed, and are left out of the plan.
STEPS: list[tuple[str, Callable[[Column], Column], bool]] = [
    # The outer range spares plain letters a walk through all ranges.
    ("C1 emoji", _sub(rf"[\x{{203C}}-\x{{1FAFF}}&&[{EMOJI}]]+"), True),
    ("C2 mention", _sub(f"@[^{SPACE}]+"), True),
    ("C3 html tag", _sub(r"<[^>\n]*>"), True),
    (
        "C4 number",
        _sub(r"(?=[-+.0-9\x{80}-\x{10FFFF}])(?:[-+]\.*+|(?<!\.)\.*+)\p{Nd}[:,./\p{Nd}]*+"),
        True,
    ),
    ("C5 link", _sub(f"(?=[hw])(?:https?://|www\\.)[^{SPACE}]+", "URL"), True),
    ("C6 repeated stop", _sub(r"[!?.]*([!?.])", "$1 "), True),
    ("C7 happy smiley", _sub(HAPPY), True),
    ("C7 sad smiley", _sub(SAD), True),
    ("C8 heart", _sub("<3", "HEART"), False),
    ("C9 punctuation", lambda c: F.translate(c, PUNCTUATION, ""), True),
    ("C10 possessive", _sub(r"[’']s(?![\p{L}\p{N}_])"), False),
    ("C11 stretched word end", _sub(r"([a-z])\1{2,}+(?![\p{L}\p{N}_])", "$1 "), True),
    ("C12 lone dash", lambda c: F.replace(c, F.lit(" - "), F.lit(" ")), True),
    # Single blanks, the usual case, are not matched at all.
    ("C12 white space", _sub(f"(?: [{_SPACE}]|[{_NOT_BLANK}])[{_SPACE}]*+", " "), True),
    (
        "C13 signs at word ends",
        _sub(f"(?={_SIGN})(?:(?<![^ ]){_SIGN}++|(?<!{_SIGN}){_SIGN}++(?![^ ]))"),
        True,
    ),
    ("C14 lower case", F.lower, True),
]


def clean_text(text: Column | str, unreachable: bool = False) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for _, step, reachable in STEPS:
        if reachable or unreachable:
            out = step(out)
    return out
