"""Durations as text and as nanoseconds."""

from __future__ import annotations

import re
from fractions import Fraction

#: Nanoseconds of the compound units; d and w stand alone, with a plain number.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
LONG_UNITS = {"d": 24 * UNITS["h"], "w": 7 * 24 * UNITS["h"]}
_part = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Nanoseconds of '1h30m', '-1.5s', '0', '1.5d' or '2w'. Days and weeks do not combine with other units."""
    body = text.strip()
    if body[-1:] in LONG_UNITS:
        try:
            return int(Fraction(body[:-1]) * LONG_UNITS[body[-1]])
        except ValueError:
            raise ValueError(f"not a duration: {text!r}") from None
    sign = -1 if body[:1] == "-" else 1
    rest = body.lstrip("+-") if body[:1] in "+-" else body
    if rest == "0":
        return 0
    total, at = Fraction(0), 0
    while at < len(rest) and (m := _part.match(rest, at)):
        total += Fraction(m[1]) * UNITS[m[2]]
        at = m.end()
    if not rest or at < len(rest):
        raise ValueError(f"not a duration: {text!r}")
    return sign * int(total)
