"""Names for an operator's own columns."""

from __future__ import annotations

from collections.abc import Sequence


def fresh(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, each behind as many underscores as it takes to be none of those taken, whatever their case."""
    known, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def free(taken: Sequence[str], name: str) -> str:
    """The name of a result's column, which the caller's table mustn't have already."""
    if name.lower() in {t.lower() for t in taken}:
        raise ValueError(f"there is a column {name} already; give the result another name")
    return name
