"""The cube engine: immutable segments of cuboid states, merged when they are read.

Layout: `<root>/<cube>/cuboid=<id>/segment=<id>/*.parquet`, each cuboid with its own columns, files sorted in
the canonical dimension order. Numbered JSON manifests per cube list cuboids, segments and row counts. Data is
written before the manifest that names it, readers follow the latest manifest only, and a manifest's number is
taken by one writer alone: who comes second reads the new one and applies his change to it. Segment ids are
taken that way before data is written, so writers never share a folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from .operators import cube as build
from .operators import states
from .plans import timeplan
from .plans.spec import LEVELS, CubeSpec, CuboidPhase, SegmentPhase, SegmentType, TaskPhase, cuboid_name, level, merge_bounds, parent
from .sources import facts as fact_streams
from .sources import files


KEPT, TRIES = 10, 50
"""Manifests that stay, and attempts of a writer to add the next one."""


class EmptyBatch(ValueError):
    """A batch without facts, or whose facts cancel each other."""


@dataclass
class Cuboid:
    id: int
    dims: tuple[str, ...]
    phase: str = CuboidPhase.PRODUCTIVE.name


@dataclass
class Segment:
    id: int
    type: str = SegmentType.BUILD.name
    phase: str = SegmentPhase.PRODUCTIVE.name
    level: int = 0
    facts: int = 0
    rows: dict[str, int] = field(default_factory=dict)  # cuboid id -> rows
    eldest: str | None = None
    youngest: str | None = None
    batch: str | None = None
    archived: str | None = None

    @property
    def visible(self) -> bool:
        return SegmentPhase[self.phase].visible


@dataclass
class Query:
    """Dimensions and conditions (column, operator, value); time literals are `time` with >=, <, = on the cube's time dimension."""

    dims: tuple[str, ...] = ()
    where: tuple[tuple[str, str, object], ...] = ()
    order: tuple[str, ...] = ()
    limit: int | None = None


OPERATORS = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: c.like(v),
}


class CubeEngine:
    """Cubes below one folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- metadata

    def _manifests(self, name: str) -> list[int]:
        found = [n for n in files.listing(self.spark, f"{self.root}/{name}") if n.startswith("manifest-") and n.endswith(".json")]
        return sorted(int(n[9:-5]) for n in found)

    def _path(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/manifest-{number:012d}.json"

    def _load(self, name: str) -> tuple[list[Cuboid], list[Segment], dict]:
        """Cuboids, segments and the rest of the latest manifest; its number is `version`."""
        numbers = self._manifests(name)
        if not numbers:
            raise KeyError(f"no cube {name}")
        got = json.loads(files.read_text(self.spark, self._path(name, numbers[-1])))
        return [Cuboid(c["id"], tuple(c["dims"]), c["phase"]) for c in got["cuboids"]], [Segment(**s) for s in got["segments"]], got | {"version": numbers[-1]}

    def _save(self, name: str, cuboids: list[Cuboid], segments: list[Segment], more: dict) -> bool:
        """Writes the manifest after `version`, unless another writer has; the last few stay for readers that follow them."""
        body = {k: v for k, v in more.items() if k not in ("cuboids", "segments", "version")}
        body |= {"cuboids": [{"id": c.id, "dims": list(c.dims), "phase": c.phase} for c in cuboids], "segments": [s.__dict__ for s in segments]}
        number = more.get("version", 0) + 1
        if not files.create_text(self.spark, self._path(name, number), json.dumps(body)):
            return False
        for old in self._manifests(name):
            if old <= number - KEPT:
                files.delete(self.spark, self._path(name, old))
        return True

    def _change(self, name: str, change: Callable):
        """Applies change(cuboids, segments, more) to the latest manifest until it is this writer's turn; returns what it returns."""
        for _ in range(TRIES):
            cuboids, segments, more = self._load(name)
            out = change(cuboids, segments, more)
            if self._save(name, cuboids, segments, more):
                return out
        raise RuntimeError(f"other writers kept changing {name}")

    def _reserve(self, name: str) -> int:
        """A segment id that no other writer gets."""

        def change(cuboids, segments, more):
            more["next_segment"] += 1
            return more["next_segment"] - 1

        return self._change(name, change)

    def create(self, spec: CubeSpec, kinds: dict[str, str] | None = None) -> list[Cuboid]:
        """Registers a cube with its lattice; kinds: Spark types of dimensions that aren't strings."""
        cuboids = [Cuboid(k + 1, dims) for k, dims in enumerate(spec.lattice())]
        if self._manifests(spec.name) or not self._save(spec.name, cuboids, [], {"enabled": spec.enabled, "next_segment": 1, "kinds": kinds or {}}):
            raise ValueError(f"cube {spec.name} is there")
        return cuboids

    def enable(self, spec: CubeSpec, on: bool = True) -> None:
        self._change(spec.name, lambda cuboids, segments, more: more.update(enabled=on))

    def destroy(self, spec: CubeSpec) -> None:
        """Deletes a disabled cube."""
        if self._load(spec.name)[2]["enabled"]:
            raise ValueError("disable the cube first")
        files.delete(self.spark, f"{self.root}/{spec.name}")

    def clear(self, spec: CubeSpec) -> None:
        """Deletes a disabled cube's segments; cuboids stay."""

        def change(cuboids, segments, more):
            if more["enabled"]:
                raise ValueError("disable the cube first")
            segments.clear()
            return cuboids

        for c in self._change(spec.name, change):
            files.delete(self.spark, f"{self.root}/{spec.name}/cuboid={c.id}")

    def cubes(self) -> DataFrame:
        names = [n for n in files.listing(self.spark, self.root) if self._manifests(n)]
        return self.spark.createDataFrame([(n, n.partition(".")[0] if "." in n else "", n.rpartition(".")[2], bool(self._load(n)[2]["enabled"])) for n in names], "cube string, schema string, table string, enabled boolean")

    def cuboids(self, spec: CubeSpec) -> DataFrame:
        cuboids, segments, _ = self._load(spec.name)
        rows = [(c.id, cuboid_name(c.dims), c.phase, sum(s.rows.get(str(c.id), 0) for s in segments if s.visible)) for c in cuboids]
        return self.spark.createDataFrame(rows, "cuboid_id int, cuboid string, phase string, n_rows long")

    def segments(self, spec: CubeSpec) -> DataFrame:
        _, segments, _ = self._load(spec.name)
        rows = [(s.id, s.type, s.phase, s.level, s.facts, sum(s.rows.values()), s.eldest, s.youngest) for s in segments]
        return self.spark.createDataFrame(rows, "segment_id long, type string, phase string, level int, facts long, n_rows long, eldest string, youngest string")

    # ---- storage

    def _folder(self, spec: CubeSpec, cuboid: Cuboid, segment: int) -> str:
        return f"{self.root}/{spec.name}/cuboid={cuboid.id}/segment={segment}"

    def _schema(self, spec: CubeSpec, cuboid: Cuboid, kinds: dict[str, str]) -> StructType:
        dims = [StructField(d, StringType()) if d not in kinds else StructType.fromDDL(f"`{d}` {kinds[d]}")[0] for d in cuboid.dims]
        longs = {states.CNT, *[c for m in spec.stats for c in states.sum_columns(m)[:-1]]}
        stats = [StructField(c, LongType() if c in longs else BinaryType() if c.endswith("_hll") else DoubleType()) for c in states.columns(spec)]
        return StructType([*dims, *stats])

    def _write(self, df: DataFrame, spec: CubeSpec, cuboid: Cuboid, segment: int) -> None:
        """Writes one cuboid of one segment, sorted for skipping; files are as many as the rows ask for. A repeated attempt overwrites itself."""
        out = df.hint("rebalance")
        out = out.sortWithinPartitions(*cuboid.dims) if cuboid.dims else out
        out.write.mode("overwrite").parquet(self._folder(spec, cuboid, segment))

    def _count(self, spec: CubeSpec, cuboids: list[Cuboid], segments: list[int]) -> dict[tuple[int, int], int]:
        """(cuboid, segment) -> rows, from the files' footers, in one job."""
        base = f"{self.root}/{spec.name}"
        folders = [f for c in cuboids for s in segments if files.exists(self.spark, f := self._folder(spec, c, s))]
        if not folders:
            return {}
        got = self.spark.read.schema("cuboid int, segment long").option("basePath", base).parquet(*folders).groupBy("cuboid", "segment").count()
        return {(r["cuboid"], r["segment"]): r["count"] for r in got.collect()}

    def _read(self, spec: CubeSpec, cuboid: Cuboid, segments: list[int], kinds: dict[str, str] | None = None) -> DataFrame:
        schema = self._schema(spec, cuboid, self._load(spec.name)[2]["kinds"] if kinds is None else kinds)
        base = f"{self.root}/{spec.name}/cuboid={cuboid.id}"
        if not segments:
            return self.spark.createDataFrame([], StructType([*schema, StructField("segment", LongType())]))
        # The base path makes `segment` a partition column: filters on it prune folders.
        got = self.spark.read.schema(StructType([*schema, StructField("segment", LongType())])).option("basePath", base).parquet(*[self._folder(spec, cuboid, s) for s in segments])
        return states.with_digits(got, spec)

    # ---- ingest

    def ingest(self, spec: CubeSpec, facts: DataFrame, json_facts: bool = False, raw: bool | None = None, batch: str | None = None, bad: str = "fail", empty: str = "fail") -> int | None:
        """One batch becomes one segment with all cuboids. json_facts: facts has a JSON text column `content`.

        bad: a text that isn't a JSON object makes the batch `fail`, or counts as a fact without values (`null`), or is left
        out (`skip`). A batch without facts, or whose facts cancel, fails as well, or adds nothing and returns
        None with empty=`skip`. A batch id that is already there changes nothing and returns its segment. A
        failing batch leaves no trace but its segment id.
        """
        cuboids, segments, more = self._load(spec.name)
        if not more["enabled"]:
            raise ValueError(f"cube {spec.name} is disabled")
        if batch is not None:
            for s in segments:
                if s.batch == batch:
                    return s.id
        ident, kinds, whole, seen = self._reserve(spec.name), more["kinds"], cuboids[0], Observation()
        source = fact_streams.from_json(facts, spec, bad=bad) if json_facts else facts
        projected = states.projected(source, spec, json_facts if raw is None else raw).observe(seen, F.count(F.lit(1)).alias("n"))
        segment = Segment(ident, batch=batch)
        self._write(projected.groupBy(*whole.dims).agg(*states.partial(spec)), spec, whole, ident)
        written = self._read(spec, whole, [ident], kinds)
        timed = bool(spec.time) and set(LEVELS) <= set(whole.dims)
        known = F.col(LEVELS[0]).isNotNull() & (F.col(LEVELS[0]) != "0000") if timed else F.lit(False)
        point = F.when(known, F.struct(*LEVELS)) if timed else F.lit(None).cast("string")
        n, lo, hi = written.agg(F.count_if(states.valid(spec)), F.min(point), F.max(point)).first()
        if not n:
            files.delete(self.spark, self._folder(spec, whole, ident))
            if empty == "skip":
                return None
            raise EmptyBatch(f"the batch leaves no cell of {spec.name}")
        segment.facts = seen.get["n"]
        segment.eldest, segment.youngest = (stamp(lo), stamp(hi)) if lo else (None, None)
        segment.rows[str(whole.id)] = self._count(spec, [whole], [ident])[whole.id, ident]
        self._fill(spec, cuboids, segment, kinds)
        segment.level = level(sum(segment.rows.values())) or 0

        def change(now, others, _):
            for s in others:
                if batch is not None and s.batch == batch:
                    return s.id
            self._fill(spec, now, segment, kinds)  # cuboids that were added meanwhile
            others.append(segment)
            return ident

        return self._change(spec.name, change)

    def _fill(self, spec: CubeSpec, cuboids: list[Cuboid], segment: Segment, kinds: dict[str, str]) -> None:
        """Builds all cuboids that a segment lacks in one job, from the smallest written one that covers them."""
        missing = [c for c in cuboids if str(c.id) not in segment.rows and c.phase != CuboidPhase.DEPRECATED.name]
        if not missing:
            return
        wanted = {d for c in missing for d in c.dims}
        above = min((c for c in cuboids if str(c.id) in segment.rows and wanted <= set(c.dims)), key=lambda c: (segment.rows[str(c.id)], len(c.dims), cuboid_name(c.dims)))
        bits = {sum(0 if d in c.dims else 1 << len(above.dims) - 1 - i for i, d in enumerate(above.dims)): c.id for c in missing}
        number = F.lit(None).cast("int")
        for k, v in bits.items():
            number = F.when(F.col("_set") == k, v).otherwise(number)
        dims = [F.col(d) for d in above.dims]
        got = self._read(spec, above, [segment.id], kinds).groupingSets([[F.col(d) for d in c.dims] for c in missing], *dims).agg(F.grouping_id().cast("long").alias("_set"), *states.merge(spec))
        got = got.select(number.alias("cuboid"), F.lit(segment.id).cast("long").alias("segment"), *dims, *states.columns(spec)).hint("rebalance", "cuboid").sortWithinPartitions("cuboid", *above.dims)
        got.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cuboid", "segment").parquet(f"{self.root}/{spec.name}")
        rows = self._count(spec, missing, [segment.id])
        segment.rows |= {str(c.id): rows.get((c.id, segment.id), 0) for c in missing}

    # ---- query

    def _live(self, segments: list[Segment]) -> list[int]:
        return [s.id for s in segments if s.visible]

    def route(self, spec: CubeSpec, dims: tuple[str, ...]) -> Cuboid:
        """The exact cuboid if there is one, else that of the loosened dimensions, else the smallest that covers them. Time levels pull in their ancestors."""
        return self._routed(spec, dims, self._load(spec.name))

    def _routed(self, spec: CubeSpec, dims: tuple[str, ...], loaded: tuple) -> Cuboid:
        cuboids, segments, _ = loaded
        good = [c for c in cuboids if c.phase == CuboidPhase.PRODUCTIVE.name]
        deepest = max((i for i, x in enumerate(LEVELS) if x in dims), default=-1)
        wanted = spec.order({*dims, *LEVELS[: deepest + 1]})
        by_dims = {c.dims: c for c in good}
        for exact in (wanted, spec.loosen(wanted)):
            if exact in by_dims:
                return by_dims[exact]
        counts = {c.dims: sum(s.rows.get(str(c.id), 0) for s in segments if s.visible) for c in good}
        found = parent(wanted, counts)
        if found is None:
            raise KeyError(f"no cuboid holds {dims}")
        return by_dims[found]

    def query(self, spec: CubeSpec, q: Query, average: bool = True) -> DataFrame:
        """Merged and finished rows: asked dimensions and each measure's results."""
        loaded = self._load(spec.name)
        conditions, used = self._conditions(spec, q)
        cuboid = self._routed(spec, tuple(dict.fromkeys([*q.dims, *used])), loaded)
        df = self._read(spec, cuboid, self._live(loaded[1]), loaded[2]["kinds"])
        for c in conditions:
            df = df.filter(c)
        out = build.rollup(df, q.dims, spec).filter(states.valid(spec)).select(*q.dims, *states.finished(spec, average))
        if q.order:
            out = out.orderBy(*[F.desc(x[1:]) if x.startswith("-") else F.col(x) for x in q.order])
        return out if q.limit is None else out.limit(q.limit)

    def _conditions(self, spec: CubeSpec, q: Query) -> tuple[list[Column], list[str]]:
        """Conditions on stored columns. A time literal only needs the levels that it tells apart; they compare as one key."""
        out, used, bounds = [], [], {}
        literals = [str(v) for c, _, v in q.where if c == spec.time and spec.time]
        depth = timeplan.needed_depth(literals)
        for column, op, value in q.where:
            if spec.time and column == spec.time:
                own = LEVELS[:depth]
                used += own
                key, point = F.concat(*[F.col(x) for x in own]), "".join(timeplan.parts(str(value), depth))
                out.append(OPERATORS[op](key, F.lit(point)))
                if op == "=":
                    out += [F.col(x) == p for x, p in zip(own, timeplan.parts(str(value), depth), strict=True)]
                elif op in (">=", ">", "<", "<="):
                    first = F.col(own[0])  # the leading level alone prunes row groups
                    out.append(first >= point[:4] if op in (">=", ">") else first <= point[:4])
                    bounds[op[0]] = timeplan.parts(str(value), depth)
            else:
                used.append(column)
                out.append(OPERATORS[op](F.col(column), value))
        if set(bounds) == {"<", ">"}:
            # Levels that both ends share are equalities, and the first that differs is a range: all are pushed to the scan.
            for name, low, high in zip(LEVELS, bounds[">"], bounds["<"], strict=False):
                if low != high:
                    out += [F.col(name) >= low, F.col(name) <= high]
                    break
                out.append(F.col(name) == low)
        return out, used

    def scan(self, spec: CubeSpec, dims: tuple[str, ...], segments: list[int] | None = None, where: Column | None = None, check: bool = False) -> DataFrame:
        """The merged states of one cuboid, in key order, over given or all live segments; check: each must be live."""
        cuboids, known, _ = self._load(spec.name)
        live = self._live(known)
        wanted = live if segments is None else segments
        if check and not set(wanted) <= set(live):
            raise ValueError(f"segments {sorted(set(wanted) - set(live))} aren't live")
        cuboid = next(c for c in cuboids if c.dims == spec.order(dims))
        df = self._read(spec, cuboid, [s for s in wanted if s in live])
        df = df if where is None else df.filter(where)
        return build.rollup(df, cuboid.dims, spec).filter(states.valid(spec)).orderBy(*cuboid.dims)

    def view(self, spec: CubeSpec, name: str | None = None) -> DataFrame:
        """The base cuboid in the published row shape, also as temporary view `schema_table`."""
        cuboids, segments, _ = self._load(spec.name)
        df = build.rollup(self._read(spec, cuboids[0], self._live(segments)), cuboids[0].dims, spec).filter(states.valid(spec))
        out = states.published(df, spec)
        out.createOrReplaceTempView(name or spec.name.replace(".", "_"))
        return out

    # ---- maintenance

    def compact(self, spec: CubeSpec, ids: list[int] | None = None, force: bool = False) -> int | None:
        """Combines segments into one: the given ones, or those of the first level that holds enough. Answers don't change."""
        cuboids, segments, more = self._load(spec.name)
        live = [s for s in segments if s.visible]
        if ids is None:
            for n in sorted({s.level for s in live}):
                least, most = merge_bounds(n)
                same = [s for s in live if s.level == n][:most]
                if len(same) >= (2 if force else least) and sum(sum(s.rows.values()) for s in same) <= spec.merge_threshold:
                    ids = [s.id for s in same]
                    break
        old = [s for s in live if ids and s.id in ids]
        if len(old) < 2:
            return None
        ident, kinds = self._reserve(spec.name), more["kinds"]
        new = Segment(ident, SegmentType.COMBINE.name, facts=sum(s.facts for s in old), eldest=min((s.eldest for s in old if s.eldest), default=None), youngest=max((s.youngest for s in old if s.youngest), default=None))
        whole = cuboids[0]
        self._write(build.rollup(self._read(spec, whole, [s.id for s in old], kinds), whole.dims, spec), spec, whole, ident)
        new.rows[str(whole.id)] = self._count(spec, [whole], [ident])[whole.id, ident]
        self._fill(spec, cuboids, new, kinds)
        new.level = max(level(sum(new.rows.values())) or 0, max(s.level for s in old))

        def change(now, known, _):
            mine = [s for s in known if s.id in {o.id for o in old} and s.visible]
            if len(mine) < len(old):
                return None  # another writer has combined or dropped some of them
            self._fill(spec, now, new, kinds)
            for s in mine:
                s.phase, s.archived = SegmentPhase.ARCHIVE.name, datetime.now().isoformat()
            known.append(new)
            return ident

        return self._change(spec.name, change)

    def mend(self, spec: CubeSpec, dims: tuple[str, ...]) -> int:
        """Adds a cuboid to the cube and to each live segment, from the smallest parent there."""
        ordered = spec.order(dims)

        def add(cuboids, segments, more):
            if all(c.dims != ordered for c in cuboids):
                cuboids.append(Cuboid(max(c.id for c in cuboids) + 1, ordered, CuboidPhase.CHARGING.name))

        def charge(cuboids, segments, more):
            for s in segments:
                if s.visible:
                    self._fill(spec, cuboids, s, more["kinds"])
            cuboid = next(c for c in cuboids if c.dims == ordered)
            cuboid.phase = CuboidPhase.PRODUCTIVE.name
            return cuboid.id

        self._change(spec.name, add)
        return self._change(spec.name, charge)

    def expire(self, spec: CubeSpec, now: str) -> list[int]:
        """Archives segments whose youngest fact is older than the cube's time to live before `now`."""
        if not spec.ttl_ms:
            return []
        edge = datetime.fromisoformat(now).timestamp() * 1000 - spec.ttl_ms

        def change(cuboids, segments, more):
            gone = [s for s in segments if s.visible and s.youngest and datetime.fromisoformat(s.youngest).timestamp() * 1000 < edge]
            for s in gone:
                s.phase, s.archived = SegmentPhase.ARCHIVE.name, now
            return [s.id for s in gone]

        return self._change(spec.name, change)

    def purge(self, spec: CubeSpec) -> int:
        """Deletes archived segments' files; returns their number. Run it when no reader follows an older manifest."""

        def change(cuboids, segments, more):
            gone = [s for s in segments if s.phase == SegmentPhase.ARCHIVE.name]
            segments[:] = [s for s in segments if s not in gone]
            return cuboids, gone

        cuboids, gone = self._change(spec.name, change)
        for s in gone:
            for c in cuboids:
                files.delete(self.spark, self._folder(spec, c, s.id))
        return len(gone)

    def statistics(self, spec: CubeSpec) -> DataFrame:
        """(kind, phase, n, rows): cuboids and segments by phase."""
        cuboids, segments, _ = self._load(spec.name)
        rows = [("cuboid", c.phase, sum(s.rows.get(str(c.id), 0) for s in segments if s.visible)) for c in cuboids] + [("segment", s.phase, sum(s.rows.values())) for s in segments]
        df = self.spark.createDataFrame(rows, "kind string, phase string, r long")
        return df.groupBy("kind", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("n_rows"))

    def audit(self, spec: CubeSpec) -> DataFrame:
        """(segment_id, cuboid_id) of live segments and productive cuboids whose files are missing or hold other rows than the manifest says."""
        cuboids, segments, _ = self._load(spec.name)
        live = [s for s in segments if s.visible]
        rows = self._count(spec, cuboids, [s.id for s in live])
        good = [c for c in cuboids if c.phase == CuboidPhase.PRODUCTIVE.name]
        missing = [(s.id, c.id) for s in live for c in good if not rows.get((c.id, s.id)) or rows[c.id, s.id] != s.rows.get(str(c.id))]
        return self.spark.createDataFrame(missing, "segment_id long, cuboid_id int")

    def segment_ids(self, spec: CubeSpec, dims: tuple[str, ...]) -> DataFrame:
        """(segment_id) of the live segments that a cuboid's stored cells belong to: distinct folder names, no data is read."""
        cuboids, segments, more = self._load(spec.name)
        cuboid = next(c for c in cuboids if c.dims == spec.order(dims))
        return self._read(spec, cuboid, self._live(segments), more["kinds"]).select(F.col("segment").alias("segment_id")).distinct()

    def system_facts(self, spec: CubeSpec, at: str) -> DataFrame:
        """Row counts as facts: ADD for each live segment's cuboids, REMOVE for each archived one's beside its ADD."""
        cuboids, segments, _ = self._load(spec.name)
        rows = []
        for s in segments:
            for c in cuboids:
                n = s.rows.get(str(c.id), 0)
                both = ["ADD"] if s.visible else ["ADD", "REMOVE"]
                rows += [(spec.schema_name, spec.table_name, str(s.id), cuboid_name(c.dims), float(n), op, at) for op in both]
        return self.spark.createDataFrame(rows, "schema string, cube string, segment string, cuboid string, count double, OLAP_OPERATION string, addTime string")

    # ---- operations by name

    def operate(self, name: str, spec: CubeSpec, group: str | None = None, **parameters):
        """Runs `build`, `combine`, `mend`, `expire`, `purge`, `flush` or `info` with parameters, as a job group that `cancel` can stop."""
        known = {"build": self.ingest, "combine": self.compact, "mend": self.mend, "expire": self.expire, "purge": self.purge, "info": self.segments, "flush": lambda s: self.compact(s, force=True)}
        if name not in known:
            raise KeyError(f"no operation {name}")
        context = self.spark.sparkContext
        context.setJobGroup(group or f"{spec.name}-{name}", f"{name} {spec.name}", True)
        try:
            return known[name](spec, **parameters)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def running(self, group: str) -> bool:
        """Whether a job of the group still runs."""
        tracker = self.spark.sparkContext.statusTracker()
        return any((i := tracker.getJobInfo(j)) and i.status == "RUNNING" for j in tracker.getJobIdsForGroup(group))

    def cancel(self, group: str) -> str:
        """Stops the jobs of a group that an operation was started in."""
        self.spark.sparkContext.cancelJobGroup(group)
        return TaskPhase.FAILED.name


def stamp(row) -> str:
    return "{}-{}-{} {}:{}:{}.{}".format(*row)
