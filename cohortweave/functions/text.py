"""Text expressions: wildcard patterns, stripping and number parsing."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _literal(text: str) -> str:
    return re.sub(r"([^\w ])", r"\\\1", text)


def wildcard_to_regex(pattern: str) -> str:
    """Regex of a wildcard pattern: ``%``, ``_``, ``[set]`` and ``[^set]``.

    A ``%`` at either end becomes a missing anchor, which spares the matcher a scan.
    """
    core = pattern.strip("%")
    parts = re.split(r"(\[\^?\]?[^\]]*\]|%|_)", core)
    out = []
    for part in parts:
        if part == "%":
            out.append(".*")
        elif part == "_":
            out.append(".")
        elif len(part) > 2 and part[0] == "[" and part[-1] == "]":
            body, negate = (part[2:-1], "^") if part[1] == "^" else (part[1:-1], "")
            members = re.findall(r".-.|.", body, re.S)
            out.append("[" + negate + "".join("-".join(map(_literal, (m[0], m[2]))) if len(m) == 3 else _literal(m) for m in members) + "]")
        else:
            out.append(_literal(part))
    start = "" if pattern.startswith("%") else "^"
    end = "" if pattern.endswith("%") else "$"
    return start + "".join(out) + end


def any_pattern(patterns: Sequence[str]) -> str:
    """One case-insensitive regex that matches when any wildcard pattern does."""
    unique = list(dict.fromkeys(patterns))
    return "(?is)" + "|".join(wildcard_to_regex(p) for p in unique)


def match_patterns(col: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = (),
                   exact: Sequence[str] = (), not_exact: Sequence[str] = ()) -> Column:
    """``(any include AND no exclude AND not a not_exact name) OR an exact name``.

    Text comparison ignores case.  A NULL text gives NULL, as LIKE does.
    """
    text = _c(col)
    tests = []
    if include:
        tests.append(text.rlike(any_pattern(include)))
    if exclude:
        tests.append(~text.rlike(any_pattern(exclude)))
    if not_exact:
        tests.append(~F.lower(text).isin([n.lower() for n in not_exact]))
    keep = reduce(lambda a, b: a & b, tests) if tests else F.lit(False)
    if exact:
        keep = keep | F.lower(text).isin([n.lower() for n in exact])
    return keep


def none_of(col: str | Column, patterns: Sequence[str]) -> Column:
    """No pattern matches; NULL stays NULL."""
    return ~_c(col).rlike(any_pattern(patterns))


def strip_chars(col: str | Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(_c(col), F.lit(chars))


def same_text(col: str | Column, value: str) -> Column:
    """Equality that ignores case."""
    return F.lower(_c(col)) == value.lower()


def text_in(col: str | Column, values: Sequence[str]) -> Column:
    """Membership that ignores case (NULL stays NULL)."""
    return F.lower(_c(col)).isin([v.lower() for v in dict.fromkeys(values)])


def number_or_null(col: str | Column, sentinels: Sequence[str] = ("NULL", ""), dtype: str = "decimal(10,0)") -> Column:
    """Parse a number; sentinel texts and unreadable text become NULL."""
    text = _c(col)
    return F.when(~text_in(text, sentinels), text).try_cast(dtype)


def flag_or_null(col: str | Column, true: str = "true", false: str = "false") -> Column:
    """``true`` to 1, ``false`` to 0, anything else to NULL."""
    return F.when(same_text(col, true), 1).when(same_text(col, false), 0)


def without_dots(col: str | Column) -> Column:
    return F.replace(_c(col), F.lit("."), F.lit(""))
