"""SQLite tables as a Spark data source (read only): ranges of row ids as partitions, filters in SQL.

Databases are found through the file system of the path's scheme. Where there are many, small ones are
packed into tasks by their bytes, unopened. Another one that tasks can open in
place (``file:``, a disk that all of them share) is divided by row ids; one of another file
system is fetched by the task that reads it, whole, and so is one partition. Filters that Spark
offers (``spark.sql.python.filterPushdown.enabled``), and those given as the option ``where``, are
evaluated by SQLite; Spark checks the former again, since SQLite's values have types of their own.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from contextlib import contextmanager
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from tallyforge.sources.textlogs import opened, whole_path

#: Row ids of a partition; bytes of a database's header (a file below that holds no table). Databases
#: up to SMALL bytes are read whole, several by a task: PACK bytes, each counted as OPEN more.
ROWS, HEADER, SMALL, PACK, OPEN = 100_000, 100, 8 << 20, 32 << 20, 256 << 10
#: Rows handed on together.
BATCH = 5_000
_ARROW = {"string": pa.string, "long": pa.int64, "double": pa.float64}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class RowRange(InputPartition):
    uri: str
    low: int | None
    high: int | None


@dataclass
class Several(InputPartition):
    parts: list[RowRange]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.kinds = [f.dataType.typeName() for f in schema.fields][2:]
        self.names = schema.fieldNames()[2:]
        self.uri, self.table, self.match = options["path"], options["table"], options.get("match", "*.db")
        self.places = json.loads(options.get("columns", "{}"))
        self.rows, self.tasks = int(options.get("rows", ROWS)), int(options.get("tasks", 1))
        self.conditions: list[tuple[str, list]] = [(text, values) for text, values in json.loads(options.get("where", "[]"))]

    # -- planning

    def _condition(self, f):
        if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in self.names:
            return None
        place, kind = self._place(f.attribute[0]), self.kinds[self.names.index(f.attribute[0])]
        if isinstance(f, IsNotNull):
            return f"{place} IS NOT NULL", []
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        if any(not isinstance(x, (str, int, float)) or isinstance(x, bool) for x in values):
            return None
        if kind == "string" and not isinstance(f, (EqualTo, In)):
            return None  # the order of texts is the collation's
        typed = place if kind == "string" else f"CAST({place} AS {'INTEGER' if kind == 'long' else 'REAL'})"
        #: Numbers are shown as text where a column is text, not always as SQLite would show them.
        loose = f"typeof({place}) NOT IN ('text', 'null') OR " if kind == "string" else ""
        if isinstance(f, In):
            return f"({loose}{typed} IN ({','.join('?' * len(values))}))", values
        return (f"({loose}{typed} {_COMPARED[type(f)]} ?)", values) if type(f) in _COMPARED else None

    def partitions(self):
        fs, root = opened(self.uri)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no file or folder: {self.uri}")
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [x for x in found if x.type == pafs.FileType.File and x.size >= HEADER]
        sizes = dict(sorted((x.path, x.size) for x in files if x is info or fnmatch(x.path.rpartition("/")[2], self.match)))
        local = isinstance(fs, pafs.LocalFileSystem)
        scheme = "file:" if local else self.uri.split("://")[0] + "://"
        small = {p: n for p, n in sizes.items() if n <= SMALL}
        #: A few are divided by row ids, whatever their size.
        packed = self._packed(scheme, small) if len(small) > self.tasks and self.rows >= ROWS else []
        out = [*packed]
        for path in sizes:
            if packed and path in small:
                continue
            if not local:
                out.append(RowRange(scheme + path, None, None))
                continue
            low, high = self._bounds(path)
            step = low
            while low is not None and step <= high:
                out.append(RowRange(f"file:{path}", step, min(step + self.rows - 1, high)))
                step += self.rows
        return out or [RowRange("", None, None)]

    def _packed(self, scheme, small):
        """Small databases, which only their task opens: planning costs no more than the listing, and
        tasks grow with the bytes, not with the files."""
        most = min(PACK, -(-sum(n + OPEN for n in small.values()) // self.tasks))
        packs, size = [], most
        for path, n in small.items():
            if size + n + OPEN > most:
                packs.append(Several([]))
                size = 0
            packs[-1].parts.append(RowRange(scheme + path, None, None))
            size += n + OPEN
        return packs

    def _bounds(self, path):
        """First and last row id; none for an empty table or another application's database."""
        with _database(f"file:{path}") as db:
            if db.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", [self.table]).fetchone() is None:
                return None, None
            return db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()

    # -- reading

    def _place(self, name: str) -> str:
        return self.places.get(name) or _quoted(name)

    def sql(self, partition: RowRange) -> tuple[str, list]:
        wanted, values = [text for text, _ in self.conditions], [x for _, given in self.conditions for x in given]
        if partition.low is not None:
            wanted, values = ["rowid BETWEEN ? AND ?", *wanted], [partition.low, partition.high, *values]
        where = " WHERE " + " AND ".join(wanted) if wanted else ""
        return f"SELECT rowid, {', '.join(map(self._place, self.names))} FROM {_quoted(self.table)}{where} ORDER BY rowid", values

    def read(self, partition):
        for part in partition.parts if isinstance(partition, Several) else [partition]:
            yield from self._read(part)

    def _read(self, partition: RowRange):
        if not partition.uri:
            return
        named = "/" + partition.uri.split(":", 1)[1].lstrip("/")
        with _database(partition.uri) as db:
            if partition.low is None and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [self.table]).fetchone() is None:
                return
            found = db.execute(*self.sql(partition))
            while rows := found.fetchmany(BATCH):
                numbers, *columns = zip(*rows)
                fitted = [pa.array([_fit(x, k) for x in column], _ARROW[k]()) for column, k in zip(columns, self.kinds)]
                yield pa.RecordBatch.from_arrays([pa.repeat(named, len(rows)), pa.array(numbers, pa.int64()), *fitted], names=["file", "line_no", *self.names])


class FilteringReader(SqliteReader):
    """Takes Spark's filters too; Spark refuses such a reader where its setting is off."""

    def pushFilters(self, filters):
        self.conditions += [made for made in map(self._condition, filters) if made]
        return filters  # all are checked again: what SQLite keeps is a superset


@contextmanager
def _database(uri: str):
    """A database opened read only; one of another file system from a copy for this task. A file
    that isn't a database raises."""
    if uri.startswith("file:"):
        db = sqlite3.connect(f"file:{'/' + uri.removeprefix('file:').lstrip('/')}?mode=ro", uri=True)
        try:
            yield db
        finally:
            db.close()
        return
    fs, path = opened(uri)
    with tempfile.TemporaryDirectory() as own:
        with fs.open_input_stream(path, compression=None) as source, open(os.path.join(own, "db"), "wb") as copy:
            while block := source.read(8 << 20):
                copy.write(block)
        with _database(f"file:{own}/db") as db:
            yield db


def _fit(value, kind):
    """SQLite types are per value; what doesn't fit the column is null."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else str(value) if isinstance(value, (int, float)) else None
    if kind == "long":
        return int(value) if isinstance(value, (int, float)) and abs(value) < 2**63 else None
    if kind == "double":
        return float(value) if isinstance(value, (int, float)) else None
    return None


class SqliteDataSource(DataSource):
    """``format("sqlite_table")``; options path (file or folder), table, match (``*.db``), rows (of a
    partition), tasks (to deal to, at least, where there are more databases), columns (JSON: SQL for a column that isn't one of the table), where (JSON:
    conditions with their values), filters (``true``: take Spark's filters).

    The schema's first two columns are the database file and the row id; only the columns after
    them are read."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        return self.options["ddl"]

    def reader(self, schema):
        return (FilteringReader if self.options.get("filters") == "true" else SqliteReader)(schema, self.options)


def sqlite_rows(
    spark: SparkSession, path: str, table: str, columns: dict[str, str], match: str = "*.db", places: dict[str, str] | None = None, where: list[tuple[str, list]] | None = None, rows: int = ROWS
) -> DataFrame:
    """file, line_no (the row id) and ``columns`` (name: type) of a table in every database below
    ``path``. ``places``: SQL for columns that the table calls otherwise; ``where``: conditions
    that SQLite checks. A missing path raises, and so does a damaged database; one without the
    table has no rows, nor has a file too short for a database's header."""
    spark.dataSource.register(SqliteDataSource)
    ddl = "file string, line_no long, " + ", ".join(f"{name} {kind}" for name, kind in columns.items())
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("sqlite_table").schema(ddl).options(table=table, match=match, rows=rows, filters=pushed, tasks=spark.sparkContext.defaultParallelism)
    return reader.option("columns", json.dumps(places or {})).option("where", json.dumps(where or [])).load(whole_path(spark, path))
