"""Python data sources: JSON texts that connectors have landed, and ``_meta.json`` override files.

``landed`` reads what ``land`` wrote: a folder for each landing (``batch=000000000007``) with a folder
for each day of last change in it (``until=2024-01-31``), JSON lines below. ``since`` skips the folders of
earlier days unopened, and files are cut into ranges of bytes, each a task. As a stream, offsets are
the numbers of whole landings, so a restarted query takes up exactly where it ended.

``override_files`` reads the ``_meta.json`` files below a folder, over which Spark's own readers pass
because of the underscore.

Executors open files by ``pyarrow.fs``, so paths may be local (shared) or in the stores that it knows.
"""

from __future__ import annotations

import datetime as dt
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

LANDED = "value string, until date, batch long"
#: Bytes of a file that one task reads, and of texts that it hands on at a time.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _below(fs: pafs.FileSystem, path: str, recursive: bool = False) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=recursive)), key=lambda f: f.path)


def day_of(since: str | None) -> dt.date | None:
    """The day of an ISO time or of epoch seconds, UTC."""
    if since is None or since == "":
        return None
    try:
        return dt.datetime.fromtimestamp(float(since), dt.UTC).date()
    except ValueError:
        at = dt.datetime.fromisoformat(since)
        return (at.astimezone(dt.UTC) if at.tzinfo else at).date()


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from byte ``start`` up to ``end``."""

    path: str
    start: int
    end: int
    until: dt.date | None
    batch: int


class Landings:
    """The folders below a landing path."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.since = day_of(options.get("since"))
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.fs, self.path = _open(self.uri)

    def numbers(self) -> list[int]:
        """Landings in order, as far as all of them are whole: one that is being written ends the list."""
        out = []
        for f in _below(self.fs, self.path):
            name = f.path.rstrip("/").rpartition("/")[2]
            if f.type == pafs.FileType.Directory and name.startswith("batch="):
                if self.fs.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.NotFound:
                    break
                out.append(int(name[6:]))
        return out

    def ranges(self, after: int = -1, to: int | None = None) -> list[Range]:
        out = []
        for n in self.numbers():
            if n <= after or (to is not None and n > to):
                continue
            for folder in _below(self.fs, f"{self.path}/batch={n:012d}"):
                key, _, day = folder.path.rpartition("/")[2].partition("=")
                if key != "until":
                    continue
                until = None if day.startswith("__") else dt.date.fromisoformat(day)
                if self.since is not None and until is not None and until < self.since:
                    continue
                for f in _below(self.fs, folder.path):
                    if f.is_file and not f.base_name.startswith(("_", ".")):
                        out += [Range(f.path, at, min(at + self.size, f.size), until, n) for at in range(0, f.size, self.size)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Whole lines, in batches of some bytes. The line that a range ends in is read to its end."""
        def batch(lines: list[str]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([part.until] * n, pa.date32()), pa.array([part.batch] * n, pa.int64())], names=["value", "until", "batch"])

        with self.fs.open_input_file(part.path) as f:
            f.seek(max(0, part.start - 1))
            lines_in, at = io.BufferedReader(f, 1 << 20), max(0, part.start - 1)
            if part.start:
                at += len(lines_in.readline())  # the rest of a line that began before
            lines, size = [], 0
            while at < part.end and (line := lines_in.readline()):
                at += len(line)
                if text := line.rstrip(b"\r\n").decode("utf-8", "replace"):
                    lines.append(text)
                    size += len(line)
                if size >= BATCH_BYTES:
                    yield batch(lines)
                    lines, size = [], 0
            if lines:
                yield batch(lines)


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def pushFilters(self, filters):
        """Lower bounds of ``until`` work as ``since`` does; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == ("until",) and f.value is not None:
                low, now = f.value, day_of(self.options.get("since"))
                self.options["since"] = max(low, now or low).isoformat()
            yield f

    def partitions(self) -> list[InputPartition]:
        return Landings(self.options).ranges()

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Range):  # no landing: Spark asks for one partition without a range
            yield from Landings(self.options).read(partition)


class LandedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(Landings(self.options).numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return Landings(self.options).ranges(start["batch"], end["batch"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Range):
            yield from Landings(self.options).read(partition)

    def commit(self, end: dict) -> None:
        """Landings stay: other queries may read them."""


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema: StructType) -> DataSourceReader:
        return LandedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LandedStream(self.options)


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


class OverrideReader(DataSourceReader):
    """Each folder right below the path is walked by a task of its own."""

    def __init__(self, options: dict):
        self.uri = options["path"]

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.uri)
        return [Folder(path, False)] + [Folder(f.path, True) for f in _below(fs, path) if f.type == pafs.FileType.Directory]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.uri)
        if not isinstance(partition, Folder):
            return
        for f in _below(fs, partition.path, partition.recursive):
            if f.is_file and f.base_name == "_meta.json":
                with fs.open_input_file(f.path) as stream:
                    text = stream.read().decode("utf-8", "replace")
                folder = f.path.rpartition("/")[0][len(root.rstrip("/")) :].strip("/")
                yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([text])], names=["folder", "value"])


class OverrideFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "override_files"

    def schema(self) -> str:
        return "folder string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return OverrideReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Landed, OverrideFiles):
        spark.dataSource.register(source)


def land(raw: DataFrame, path: str, batch: int, modified: str = "modified") -> None:
    """Write JSON texts (value) as landing ``batch``, by the day of ``modified`` (epoch seconds; null: of any day).
    Landing a batch again replaces it."""
    day = F.date_format(F.timestamp_seconds(F.col(modified)), "yyyy-MM-dd")
    raw.select("value", day.alias("until")).write.mode("overwrite").partitionBy("until").text(f"{path}/batch={batch:012d}")


def scan_landed(spark: SparkSession, path: str, since: float | str | None = None, stream: bool = False) -> DataFrame:
    """Landed texts (value, until, batch). ``since`` skips earlier days whole; the rows of its own day are all there."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("landed")
    return (reader if since is None else reader.option("since", str(since))).load(path)


def scan_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(folder, value) of the ``_meta.json`` files below ``path``, folders relative to it."""
    register(spark)
    return spark.read.format("override_files").load(path)


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, content: binary) as single files below ``root``; tasks write what they hold. A local file stands
    whole at its path or not at all, also where an attempt of a task is ended while another one writes it."""
    def run(rows) -> None:
        fs, top = _open(root)
        made = set()
        for r in rows:
            at = f"{top}/{r['path']}"
            if (folder := at.rpartition("/")[0]) not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            # Other stores publish a file when it is closed.
            to = f"{folder}/.{uuid.uuid4().hex}" if fs.type_name == "local" else at
            with fs.open_output_stream(to) as out:
                out.write(bytes(r["content"] or b""))
            if to != at:
                fs.move(to, at)

    files.select("path", "content").foreachPartition(run)


def write_overrides(overrides: DataFrame, path: str) -> None:
    """Write (folder, value) as ``_meta.json`` files below ``path``."""
    name = F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.lit("_meta.json"))
    write_files(overrides.select(name.alias("path"), F.col("value").cast("binary").alias("content")), path)


def _listed(name: str) -> bool:
    """Whether Spark's readers list a file or folder of that name."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified) of the files without a byte below ``root``, or ``root`` itself: Spark's readers pass over them.
    Each folder right below is walked by a task; in a store that ``pyarrow.fs`` does not know the driver lists all."""
    sc, folders, rows = spark.sparkContext, [], []
    at = sc._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(sc._jsc.hadoopConfiguration())
    for s in store.globStatus(at) or []:
        top = s.getPath()
        try:
            fs, base = _rooted(top.toString())
            inner = _below(fs, base) if s.isDirectory() else []
            folders += [(top.toString(), base, False)] + [(top.toString(), f.path, True) for f in inner if f.type == pafs.FileType.Directory and _listed(f.base_name)]
        except (pa.ArrowInvalid, OSError):
            found = store.listFiles(top, True)
            while found.hasNext():
                f = found.next()
                below = f.getPath().toString()[len(top.toString()) :].strip("/").split("/")
                if not f.getLen() and all(map(_listed, filter(None, below))):
                    rows.append((f.getPath().toString(), dt.datetime.fromtimestamp(f.getModificationTime() / 1000, dt.UTC)))

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, path, recursive in (r.values() for p in parts for r in p.to_pylist()):
            fs, base = _rooted(top)
            one = fs.get_file_info(path)
            infos = [one] if one.is_file else _below(fs, path, recursive)
            empty = [f for f in infos if f.is_file and not f.size and all(map(_listed, filter(None, f.path[len(base) :].strip("/").split("/"))))]
            times = pa.array([f.mtime_ns // 10**6 * 1000 for f in empty], pa.int64()).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([top + f.path[len(base) :] for f in empty], pa.string()), times], names=["path", "modified"])

    if rows or not folders:
        listed = spark.createDataFrame(rows, "path string, modified timestamp").coalesce(1)
        if not folders:
            return listed
    dealt = spark.createDataFrame(sc.parallelize(folders, min(len(folders), sc.defaultParallelism)), "top string, path string, recursive boolean")
    walked = dealt.mapInArrow(walk, "path string, modified timestamp")
    return walked.unionAll(listed) if rows else walked


def _rooted(top: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a path as Hadoop writes it: local ones are not escaped."""
    return (pafs.LocalFileSystem(), top.removeprefix("file:").rstrip("/") or "/") if top.startswith("file:/") else _open(top)
