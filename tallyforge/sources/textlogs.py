"""Log files as rows: one a file, or one a line with its place.

Lines are read by byte ranges: files are listed by Spark, each is divided into ranges of a
bounded size, and ranges (not files) are dealt to tasks. A line belongs to the range in which
it begins, so a range may start and end anywhere, also within a character.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, of a read, and of lines that are handed on together.
RANGE, READ, BATCH = 64 << 20, 4 << 20, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that isn't set and Spark runs in
    one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def whole_path(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: a bare path is one of ``fs.defaultFS``, as Spark reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _named(uri: str | Column) -> Column:
    return F.regexp_replace(uri, "^[a-z0-9]+:/*", "/")


#: How many tasks Spark lists folders with; by default a task for each folder, up to 10,000.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _loaded(spark: SparkSession, kind: str, paths: str | list[str], glob: str, **options: str) -> DataFrame:
    """The matching files below the folders, listed by four tasks a core: folders can be as many as
    files, and a task for each costs far more than its listing. The setting is then as before."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.format(kind).options(recursiveFileLookup="true", pathGlobFilter=glob, **options).load([paths] if isinstance(paths, str) else [*paths])
    finally:
        spark.conf.set(LISTING, before)


def whole_files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """file, modified_ms, value: each matching file below the folders, for documents that only
    make sense whole. Spark packs small files into tasks by size."""
    found = _loaded(spark, "text", paths, glob, wholetext="true")
    name = _named(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")))
    return found.select(name.alias("file"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("modified_ms"), "value")


def listed_files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """uri, file, modified_ms, length: the matching files below the folders. Nothing of them is
    read; conditions on ``file`` prune what later steps open. A path that isn't there raises."""
    found = _loaded(spark, "binaryFile", paths, glob)
    return found.select(F.col("path").alias("uri"), _named("path").alias("file"), F.unix_millis("modificationTime").alias("modified_ms"), "length")


def ranges_of(files: DataFrame, size: int | None = None) -> DataFrame:
    """``files`` with a row for each range: at, until. Ranges are dealt by hash, as many tasks as
    their bytes ask for."""
    size = size or RANGE
    spark = files.sparkSession
    ranges = files.where("length > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    ranges = ranges.withColumn("until", F.least(F.col("at") + size, F.col("length")))
    n, total = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).head()
    tasks = max(-(-total // RANGE), min(n, spark.sparkContext.defaultParallelism), 1)
    return ranges.repartition(int(tasks), "uri", "at")


def _of_range(file, at: int, until: int):
    """(offset, line) lists of the lines that begin in [at, until), without line breaks."""
    place = max(at - 1, 0)
    file.seek(place)
    rest = b""
    while at:  # the line that begins before the range is another's
        block = file.read(READ)
        if not block:
            return
        k = block.find(b"\n")
        if k >= 0:
            rest, place = block[k + 1 :], place + k + 1
            break
        place += len(block)
    pieces, ended = [rest], False
    while place < until and not ended:
        block = b"" if b"\n" in pieces[0] else file.read(READ)
        ended = not block and b"\n" not in pieces[0]
        pieces.append(block)
        if not ended and b"\n" not in block and b"\n" not in pieces[0]:
            continue  # a long line goes on
        data = b"".join(pieces)
        keep = len(data) if ended else data.rfind(b"\n") + 1
        lines = data[:keep].split(b"\n")
        if lines and not lines[-1]:
            lines.pop()
        offsets = place + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])[: len(lines)]
        here = int(np.searchsorted(offsets, until))
        yield offsets[:here], lines[:here]
        pieces, place = [data[keep:]], place + keep


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def _reader(needles: list[list[bytes]] | None, also: list[str]):
    schema = pa.schema([("file", pa.string()), ("modified_ms", pa.int64()), ("line_no", pa.int64()), ("value", pa.string())])

    def wanted(line: bytes) -> bool:
        return bool(line.strip(b"\r")) and (needles is None or any(all(x in line for x in some) for some in needles))

    def read(batches):
        for batch in batches:
            more = [batch.schema.field(c) for c in also]
            for row in batch.to_pylist():
                fs, path = opened(row["uri"])
                with fs.open_input_file(path) as file:
                    number = 0
                    for offsets, lines in _of_range(file, row["at"], row["until"]):
                        place = offsets.tolist() if row["first"] is None else range(row["first"] + number, row["first"] + number + len(lines))
                        number += len(lines)
                        held, size = [], 0
                        for at, line in zip(place, lines):
                            if wanted(line):
                                held.append((at, _text(line)))
                                size += len(line)
                            if size > BATCH:
                                yield made(row, held, more)
                                held, size = [], 0
                        if held:
                            yield made(row, held, more)

    def made(row, held, more):
        same = lambda field: pa.repeat(pa.scalar(row[field.name], field.type), len(held))
        columns = [*map(same, [schema.field("file"), schema.field("modified_ms")]), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *map(same, more)], schema=pa.schema([*schema, *more]))

    return read


def _counted(batches):
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = opened(row["uri"])
            with fs.open_input_file(path) as file:
                n = sum(len(lines) for _, lines in _of_range(file, row["at"], row["until"]))
            yield pa.RecordBatch.from_pydict({"uri": [row["uri"]], "at": [row["at"]], "n": [n]})


def range_lines(files: DataFrame, needles: list[list[str]] | None = None, numbered: bool = False, size: int | None = None, also: list[str] = ()) -> DataFrame:
    """file, modified_ms, line_no, value: the lines of listed ``files``, without empty ones.

    ``also``: further columns of ``files`` that each line gets. Spark takes the lines for as small
    as the listing that they are read from, so a join with them can end as a broadcast of
    either side: what is known of a file travels with its ranges, and joins of lines with
    tables that grow with them ask for ``merge``.

    line_no is the line's byte offset in its file, or with ``numbered`` its number from 0: a
    first pass counts the lines of each range, and the sums of the ranges before are added.
    ``needles``: texts that a line must hold, as alternatives of all-of lists; other lines are
    dropped where they are read. Bytes that aren't UTF-8 become U+FFFD.
    """
    ranges = ranges_of(files, size)
    told = ["uri", "file", "modified_ms", "at", "until"]
    if numbered:
        counts = written(ranges.select("uri", "at", "until").mapInArrow(_counted, "uri string, at long, n long"))
        before = Window.partitionBy("uri").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        firsts = counts.select("uri", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        ranges = ranges.join(firsts, ["uri", "at"])
    else:
        ranges = ranges.withColumn("first", F.lit(None).cast("long"))
    asked = None if needles is None else [[x.encode() for x in some] for some in needles]
    kinds = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in also)
    return ranges.select(*told, "first", *also).mapInArrow(_reader(asked, [*also]), "file string, modified_ms long, line_no long, value string" + kinds)


def log_lines(spark: SparkSession, paths: str | list[str], glob: str, needles: list[list[str]] | None = None, keep: Column | None = None, **how) -> DataFrame:
    """The lines of the matching files; ``keep`` is a condition on ``file`` that the listing obeys,
    so files that fail it are never opened."""
    files = listed_files(spark, paths, glob)
    return range_lines(files if keep is None else files.where(keep), needles, **how)


def file_heads(files: DataFrame, size: int) -> DataFrame:
    """file, head: the first ``size`` bytes of listed files, as text."""

    def read(batches):
        for batch in batches:
            heads = []
            for uri in batch.column("uri").to_pylist():
                fs, path = opened(uri)
                with fs.open_input_file(path) as file:
                    heads.append(file.read(size).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(heads, pa.string())], names=["file", "head"])

    return files.select("uri", "file").mapInArrow(read, "file string, head string")


def _backwards(file, block: int):
    """Lines of a file from its end, with how many bytes were read so far."""
    end = size = file.size()
    tail: list[bytes] = []
    while end > 0:
        start = max(0, end - block)
        file.seek(start)
        data, end = file.read(end - start), start
        if b"\n" not in data and start:
            tail.insert(0, data)
            continue
        cut = data.find(b"\n") + 1 if start else 0
        for line in reversed(b"".join([data[cut:], *tail]).split(b"\n")):
            yield line, size - end
        tail = [data[:cut]]


def last_line(files: DataFrame, matches, block: int = 64 << 10) -> DataFrame:
    """file, value, bytes_read: of each listed file the last line that ``matches`` (bytes to
    bool), read backwards in blocks, so no more is read than lies behind that line and a block.
    A file without such a line has no row."""

    def read(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                fs, path = opened(row["uri"])
                with fs.open_input_file(path) as file:
                    hit = next(((line, n) for line, n in _backwards(file, block) if line.strip() and matches(line)), None)
                if hit:
                    found.append((row["file"], _text(hit[0]), hit[1]))
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "value", "bytes_read"])

    return files.select("uri", "file").mapInArrow(read, "file string, value string, bytes_read long")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row. A plain projection would be repeated in
    each filter and expression that reads it, since filters move below it; a generator of one
    row stays where it is."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def json_lines(rows: DataFrame) -> DataFrame:
    """Lines that parse as JSON, with the VARIANT column ``v``."""
    return once(rows, "v", F.try_parse_json("value")).where("v is not null")
