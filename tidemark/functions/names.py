"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Sequence


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column (Spark's names ignore case) is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
