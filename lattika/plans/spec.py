"""Cube specifications and their lattice of cuboids: pure planning, no Spark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from itertools import combinations

# Column names of facts and of published rows.
OPERATION, COUNT = "OLAP_OPERATION", "OLAP_COUNT"
LEVELS = ("OLAP_YEAR", "OLAP_MONTH", "OLAP_DAY", "OLAP_HOUR", "OLAP_MINUTE", "OLAP_SECOND", "OLAP_MILLISECOND")
TEMPORAL = ("date", "datetime", "timestamp")


class CuboidPhase(Enum):
    CANDIDATE, APPROVED, CHARGING, PRODUCTIVE, DEPRECATED = range(5)


class SegmentPhase(Enum):
    CREATED, CHARGING, PRODUCTIVE, MERGING, ARCHIVE = range(5)

    @property
    def visible(self) -> bool:
        return self in (SegmentPhase.PRODUCTIVE, SegmentPhase.MERGING)


class SegmentType(Enum):
    DEFAULT, BUILD, COMBINE = range(3)


class TaskPhase(Enum):
    CREATED, PREPARED, SUBMITTED, EXECUTING, COMPLETED, FAILED_TRY, FAILED, READY, ARCHIVE = range(9)


@dataclass(frozen=True)
class Measure:
    """A measure column; distinct ones count values by a sketch, others have min, max and sum."""

    name: str
    kind: str = "double"
    distinct: bool = False


@dataclass(frozen=True)
class CubeSpec:
    """A cube: groups of dimensions that enter cuboids together, measures, time dimension and lattice rules."""

    name: str
    groups: tuple[tuple[str, ...], ...]
    measures: tuple[Measure, ...]
    types: Mapping[str, str] = field(default_factory=dict, hash=False)
    time: str | None = None
    index: tuple[str, ...] = ()
    hierarchies: tuple[tuple[str, ...], ...] = ()
    joints: tuple[tuple[str, ...], ...] = ()
    mandatory: tuple[str, ...] = ()
    time_depths: tuple[int, ...] = ()
    enabled: bool = True
    ttl_ms: int = 0
    batch_size: int = 100_000
    merge_threshold: int = 1_000_000_000

    def __post_init__(self) -> None:
        declared = [d for g in self.groups for d in g]
        if len(set(declared)) != len(declared):
            raise ValueError("a dimension is declared twice")
        if self.time is not None and (self.time not in declared or self.types.get(self.time, "timestamp") not in TEMPORAL):
            raise ValueError(f"{self.time} is no declared date, datetime or timestamp dimension")
        for d in [*self.index, *self.mandatory, *(d for h in (*self.hierarchies, *self.joints) for d in h)]:
            if d not in declared and d not in LEVELS:
                raise ValueError(f"a rule names {d}, which isn't declared")

    @classmethod
    def parse(cls, name: str, dimensions: str, measures: str, time: str | None = None, index: str = "", hierarchies: str = "", joints: str = "", mandatory: str = "", **more) -> CubeSpec:
        """From the textual form: `a:string|b:string,c:long`, `m:double,u.distinct:long`, `a:b`, `a:b:c,d:e`."""
        pairs = [[x.partition(":") for x in g.split(",")] for g in dimensions.split("|") if g]
        lists = lambda s: tuple(tuple(x.split(":")) for x in s.split(",") if x)
        names = lambda s: tuple(x for x in s.split(":") if x)
        return cls(
            name, tuple(tuple(n for n, _, _ in g) for g in pairs), tuple(measure(x) for x in measures.split(",") if x), {n: k or "string" for g in pairs for n, _, k in g},
            time or None, names(index), lists(hierarchies), lists(joints), names(mandatory), **more,
        )

    @property
    def schema_name(self) -> str:
        return self.name.partition(".")[0] if "." in self.name else ""

    @property
    def table_name(self) -> str:
        return self.name.partition(".")[2] if "." in self.name else self.name

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(d for g in self.groups for d in g)

    @property
    def stats(self) -> tuple[str, ...]:
        return tuple(m.name for m in self.measures if not m.distinct)

    @property
    def distincts(self) -> tuple[str, ...]:
        return tuple(m.name for m in self.measures if m.distinct)

    def expanded_groups(self) -> list[tuple[str, ...]]:
        """The groups with the time dimension replaced by its seven levels."""
        return [tuple(x for d in g for x in (LEVELS if d == self.time else (d,))) for g in self.groups]

    def expanded(self) -> tuple[str, ...]:
        return self.order(d for g in self.expanded_groups() for d in g)

    def order(self, dims: Iterable[str], first: str | None = None) -> tuple[str, ...]:
        """The canonical order: time levels, index dimensions as declared, the rest by name; `first` before all."""
        rest = set(dims)
        out = [d for d in (*([first] if first else []), *LEVELS, *self.index) if d in rest]
        return (*dict.fromkeys(out), *sorted(rest - set(out)))

    def loosen(self, dims: Iterable[str]) -> tuple[str, ...]:
        """dims closed once under hierarchies, then joints, then mandatory dimensions."""
        have = set(dims)
        for h in self.hierarchies:
            deepest = max((i for i, d in enumerate(h) if d in have), default=-1)
            have |= set(h[: deepest + 1])
        for j in self.joints:
            if have & set(j):
                have |= set(j)
        return self.order(have | set(self.mandatory))

    def lattice(self) -> list[tuple[str, ...]]:
        """All cuboids, largest first: the whole, the whole without the operation, then each loosened combination once."""
        groups = self.expanded_groups()
        whole = self.expanded()
        out = {whole: None}
        if OPERATION in whole:
            out[self.order(set(whole) - {OPERATION})] = None
        for n in range(len(groups) - 1, -1, -1):
            for chosen in reversed(list(combinations(groups, n))):
                out[self.loosen(d for g in chosen for d in g)] = None
        for depth in self.time_depths:
            deep = set(LEVELS[depth:])
            out |= dict.fromkeys(self.order(set(c) - deep) for c in list(out) if set(LEVELS) <= set(c))
        return list(out)

    def published(self) -> list[tuple[str, str]]:
        """(name, type) of the published row: time levels, dimensions, count, then each measure's columns."""
        out = [(x, "string") for x in LEVELS] if self.time else []
        out += [(d, self.types.get(d, "string")) for d in self.dimensions if d != self.time]
        out.append((COUNT, "long"))
        for m in self.measures:
            out += [(f"{m.name}.distinct", "long")] if m.distinct else [(f"{m.name}.{s}", "double") for s in ("min", "max", "sum")]
        return out


def measure(text: str) -> Measure:
    name, _, kind = text.partition(":")
    return Measure(name.removesuffix(".distinct"), kind or "double", name.endswith(".distinct"))


def cuboid_name(dims: Iterable[str]) -> str:
    return ":".join(dims)


def identical_name(cube: str, ident: int) -> str:
    """A cube's name with its number, as catalogs keep it."""
    return f"{cube}-{ident}"


def cube_of(identical: str) -> tuple[str, int]:
    name, _, ident = identical.rpartition("-")
    return name, int(ident)


def parent(cuboid: tuple[str, ...], others: Mapping[tuple[str, ...], int], strict: bool = False) -> tuple[str, ...] | None:
    """The superset with the fewest rows; ties go to fewer dimensions, then the name. strict: none that has the operation."""
    own = set(cuboid)
    good = [c for c in others if own < set(c) and not (strict and OPERATION in c and OPERATION not in own)]
    return min(good, key=lambda c: (others[c], len(c), cuboid_name(c)), default=None)


def children(cuboid: tuple[str, ...], parents: Mapping[tuple[str, ...], tuple[str, ...] | None]) -> list[tuple[str, ...]]:
    return [c for c, p in parents.items() if p == cuboid]


def parents(lattice: list[tuple[str, ...]], rows: Mapping[tuple[str, ...], int] | None = None) -> dict[tuple[str, ...], tuple[str, ...] | None]:
    """Each cuboid's parent, by known row counts (0 where unknown)."""
    counts = {c: (rows or {}).get(c, 0) for c in lattice}
    return {c: parent(c, counts) for c in lattice}


#: Fixed values: (segments that merge at least, at most) by level; further levels take 5 and 5.
MERGE = {0: (5, 20), 1: (5, 10)}
LEVEL_ROWS, LEVEL_FACTOR, LEVEL_LAST = 500_000, 5, 24


def level(rows: int) -> int | None:
    """The compaction level of a segment of so many rows; None above the last level."""
    n, unit = 0, LEVEL_ROWS * LEVEL_FACTOR
    while rows >= unit:
        n, unit = n + 1, unit * LEVEL_FACTOR
    return n if n <= LEVEL_LAST else None


def merge_bounds(n: int) -> tuple[int, int]:
    return MERGE.get(n, (5, 5))


def progress(phase: TaskPhase, done: int, total: int) -> float:
    """A task's share done: 1 when it is completed or ready, 0 while the total is unknown."""
    if phase in (TaskPhase.COMPLETED, TaskPhase.READY):
        return 1.0
    return min(done / total, 1.0) if total > 0 else 0.0
