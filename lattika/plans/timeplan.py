"""Which time levels a query needs, from its literals."""

from __future__ import annotations

from collections.abc import Iterable

from .spec import LEVELS

#: The last character position (exclusive) of each level in `yyyy-MM-dd HH:mm:ss.SSS`, and its slice.
ENDS = (4, 7, 10, 13, 16, 19, 23)
SLICES = ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19), (20, 23))


def depth_of(literals: Iterable[str]) -> int:
    """Levels that the literals tell apart, by what remains without trailing zeros and signs; 7 without literals.

    A bare year that ends in 0 gives 0, as it always did; `needed_depth` doesn't.
    """
    sizes = [len(x.rstrip("".join(c for c in set(x) if c not in "123456789"))) for x in literals]
    if not sizes:
        return 7
    longest = max(sizes)
    if longest < ENDS[0]:
        return 0
    return next((n for n, end in enumerate(ENDS, 1) if longest <= end), 7)


def needed_depth(literals: Iterable[str]) -> int:
    """As depth_of, but at least 1 where there is a literal: a round year still needs its year."""
    given = list(literals)
    return max(1, depth_of(given)) if given else 0


def levels_of(literals: Iterable[str]) -> tuple[str, ...]:
    return LEVELS[: depth_of(literals)]


def depth_in(dims: Iterable[str]) -> int:
    """How many levels in a row, from the year, are among the dimensions."""
    have, n = set(dims), 0
    while n < len(LEVELS) and LEVELS[n] in have:
        n += 1
    return n


def parts(literal: str, depth: int) -> list[str]:
    """A time literal's levels down to a depth; what it doesn't hold is zero."""
    full = literal + "0000-00-00 00:00:00.000"[len(literal) :] if len(literal) < 23 else literal
    return [full[a:b] for a, b in SLICES[:depth]]


def prefix(literal: str, depth: int) -> str | None:
    """The textual key prefix `["2021","10"` of a literal; None at depth 0."""
    return "[" + ",".join(f'"{x}"' for x in parts(literal, depth)) if depth > 0 else None


def replace_time(dims: Iterable[str], time: str) -> list[str]:
    return [x for d in dims for x in (LEVELS if d == time else (d,))]
