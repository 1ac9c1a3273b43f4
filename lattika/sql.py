"""SQL over cubes and tables: parameters, row limits, and catalog search."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import keys

#: SQL type names of results and the Spark types that values are cast to.
TYPES = {
    "CHAR": "string", "VARCHAR": "string", "NUMERIC": "decimal(38,10)", "DECIMAL": "decimal(38,10)", "BIT": "boolean", "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint",
    "INTEGER": "int", "BIGINT": "bigint", "REAL": "float", "FLOAT": "double", "DOUBLE": "double", "BINARY": "binary", "VARBINARY": "binary", "DATE": "date", "TIME": "string", "TIMESTAMP": "timestamp",
}


def execute(spark: SparkSession, sql: str, args: dict | list | None = None, max_rows: int | None = None) -> DataFrame:
    """Runs SQL with named or positional parameters, which Spark binds as literals, and an optional row limit."""
    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    return df if max_rows is None else df.limit(max_rows)


def cast_to(value: Column, sql_type: str) -> Column:
    """A textual value as its SQL type; the text `null` is NULL except for VARCHAR, what can't be read is NULL."""
    text = value if sql_type in ("VARCHAR", "CHAR") else F.nullif(value, F.lit("null"))
    return text.try_cast(TYPES[sql_type])


def like_regex(pattern: str) -> str:
    """A LIKE pattern of catalog searches: only % is special, a backslash takes the next sign as it is."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(".*" if c == "%" else re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def tables(spark: SparkSession) -> DataFrame:
    """(schema, table, column, type, position) of the catalog's tables and views, in declared order."""
    rows = []
    for t in spark.catalog.listTables():
        for k, c in enumerate(spark.catalog.listColumns(t.name)):
            rows.append((".".join(t.namespace or []), t.name, c.name, c.dataType, k + 1))
    return spark.createDataFrame(rows, "schema string, table string, column string, type string, position int")


def search(catalog: DataFrame, **patterns: str | None) -> DataFrame:
    """Catalog rows whose columns match LIKE patterns; None matches all."""
    out = catalog
    for name, p in patterns.items():
        if p is not None:
            out = out.filter(F.col(name).rlike(like_regex(p)))
    return out


# ---- a connection in the manner of Python's database interface


@dataclass(frozen=True)
class Field:
    """A result column: name, SQL type, whether it may be null, place from 1."""

    name: str
    type: str
    nullable: bool
    position: int


#: The SQL type that each Spark type is shown as.
SHOWN = {"string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE", "binary": "VARBINARY", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def described(df: DataFrame) -> list[Field]:
    """The columns of a result."""
    shown = lambda t: SHOWN.get(t, "DECIMAL" if t.startswith("decimal") else "OTHER")
    return [Field(f.name, shown(f.dataType.simpleString()), f.nullable, k + 1) for k, f in enumerate(df.schema)]


class Cursor:
    """Runs queries and gives their rows out; description, rowcount, duration and partial describe the last one."""

    def __init__(self, spark: SparkSession, max_rows: int | None = None):
        self.spark, self.max_rows = spark, max_rows
        self.description: list[Field] = []
        self.rowcount, self.duration, self.partial = -1, 0.0, False
        self._rows: Iterator | None = None

    def execute(self, sql: str, args: dict | list | None = None) -> Cursor:
        """Plans the query; rows come when they are fetched. With max_rows, partial says that more rows were there."""
        start = time.perf_counter()
        self.frame = execute(self.spark, sql, args, None if self.max_rows is None else self.max_rows + 1)
        self.description, self.rowcount, self.partial = described(self.frame), 0, False
        self._rows = (r for part in iter(partial(keys.Cursor(self.frame).take, 1000), []) for r in part)
        self.duration = time.perf_counter() - start
        return self

    def executemany(self, sql: str, many: list) -> Cursor:
        for args in many:
            self.execute(sql, args)
        return self

    def fetchmany(self, n: int) -> list[tuple]:
        if self._rows is None:
            raise ValueError("nothing was executed")
        start, out = time.perf_counter(), []
        while len(out) < n and (r := next(self._rows, None)) is not None:
            if self.max_rows is not None and self.rowcount == self.max_rows:
                self.partial = True
                break
            self.rowcount += 1
            out.append(tuple(r))
        self.duration += time.perf_counter() - start
        return out

    def fetchone(self) -> tuple | None:
        return next(iter(self.fetchmany(1)), None)

    def fetchall(self) -> list[tuple]:
        out: list[tuple] = []
        while got := self.fetchmany(1000):
            out += got
        return out

    def close(self) -> None:
        self._rows = None


class Connection:
    """A read-only connection: what changes data has no effect or isn't there; commit and rollback do nothing."""

    def __init__(self, spark: SparkSession, project: str = "", max_rows: int | None = None):
        self.spark, self.project, self.max_rows, self.open = spark, project, max_rows, True

    def cursor(self) -> Cursor:
        if not self.open:
            raise ValueError("the connection is closed")
        return Cursor(self.spark, self.max_rows)

    def metadata(self) -> DataFrame:
        return tables(self.spark)

    def commit(self) -> None: ...

    def rollback(self) -> None: ...

    def close(self) -> None:
        self.open = False


def connect(spark: SparkSession, url: str) -> Connection:
    """A connection from `cube://host/project?max_rows=n`; the session that is given takes the host's place."""
    m = re.fullmatch(r"cube://[^/?]*/(?P<project>[^?]*)(?:\?(?P<options>.*))?", url)
    if not m:
        raise ValueError(f"no such address: {url}")
    options = dict(x.split("=", 1) for x in (m["options"] or "").split("&") if x)
    return Connection(spark, m["project"], int(options["max_rows"]) if "max_rows" in options else None)
