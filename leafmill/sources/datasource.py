"""Documents of every family as a Spark data source: ``spark.read.format("documents")`` and ``spark.readStream``.

Call ``register`` first.  Files are listed when a query is planned, dealt out by their size and opened by
tasks through Arrow's file systems (mounted folders, object stores, HDFS where its library is installed).  A tar archive is
listed as one file and read as its members, each a document; so millions of small files needn't be listed one by one.
"""

from __future__ import annotations

import datetime as dt
import json
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from leafmill.sources import cells, documents
from leafmill.sources.archives import located, members

SCHEMA = pa.schema([("path", pa.string()), ("family", pa.string()), ("part", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("error", pa.string())])
DDL = "path string, family string, part int, name string, text string, length long, modified timestamp, error string"
#: Bytes of files that one task opens, unless a single file is larger.
PARTITION_BYTES = 64 << 20

#: A listed file: time of its change in nanoseconds, path, size.
Listed = tuple[int, str, int]


def suffix_of(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


def family_of(path: str) -> str | None:
    ending = suffix_of(path)
    return next((name for name, endings in documents.FAMILIES.items() if ending in endings), None)


def is_archive(path: str) -> bool:
    return suffix_of(path) == documents.ARCHIVE


def listed(path: str) -> list[Listed]:
    """Files of known families and archives below a folder, oldest first; hidden ones aren't read."""
    system, root = located(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(step[:1] in "._" for step in p[len(root) :].split("/") if step)
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and (family_of(f.path) or is_archive(f.path)) and not hidden(f.path))


class Files(InputPartition):
    def __init__(self, files: list[Listed]):
        super().__init__(None)
        self.files = files


def dealt(files: Sequence[Listed], most: int) -> list[Files]:
    """Files in groups of about ``most`` bytes; a file counts 4 kB more, so that many small ones aren't one task's."""
    out: list[list[Listed]] = []
    held = 0
    for f in files:
        size = f[2] + 4096
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(f)
        held += size
    return [Files(group) for group in out]


def _files(folder: str, files: list[Listed], families: set[str] | None) -> Iterator[tuple[int, str, int, bytes | None, str | None]]:
    """(time of change, path, size, bytes, error) of files and of archives' members of the families, all known ones if none are given; one that is gone has an error."""
    system, _ = located(folder)
    for changed, path, size in files:
        try:
            if is_archive(path):
                with system.open_input_stream(path) as f:
                    for name, data in members(f):
                        found = family_of(name)
                        if found and (families is None or found in families):
                            yield changed, f"{path}/{name}", len(data), data, None
            else:
                with system.open_input_stream(path) as f:
                    data = f.read()
                yield changed, path, size, data, None
        except (tarfile.TarError, OSError) as e:
            # of no family, so no row where families are asked for
            if families is None or not is_archive(path):
                yield changed, path, size, None, f"{type(e).__name__}: {e}"[:200]


def opened(folder: str, files: list[Listed], families: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of files; one that is gone or damaged is a row with an error."""
    text = documents._valid
    rows: list[tuple] = []
    held = 0
    for changed, path, size, data, error in _files(folder, files, families):
        family = family_of(path)
        parts = [(None, None, None, None, None, error)] if data is None else documents.file_rows(family, suffix_of(path), data) if family in documents.PACKED else [(cells.decoded(data), None, None, None, None, None)]
        when = dt.datetime.fromtimestamp(changed / 1e9, dt.UTC)
        rows += [(path, family, k, text(name), text(found), size, when, text(error)) for k, (found, name, *_, error) in enumerate(parts)]
        held += sum(len(found or "") for found, *_ in parts)
        if len(rows) >= documents.PART_ROWS or held >= documents.PART_CHARS:
            yield _record(rows)
            rows, held = [], 0
    if rows:
        yield _record(rows)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class _Read:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("documents need a path")
        self.path, self.most, self.families = options["path"], int(options.get("partitionbytes", PARTITION_BYTES)), None

    def wanted(self, files: list[Listed]) -> list[Listed]:
        return files if self.families is None else [f for f in files if is_archive(f[1]) or family_of(f[1]) in self.families]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return opened(self.path, partition.files, self.families)


class DocumentsReader(_Read, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the family choose files; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("family",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.families = names if self.families is None else self.families & names
            else:
                yield f

    def partitions(self) -> list[Files]:
        return dealt(self.wanted(listed(self.path)), self.most) or [Files([])]


class DocumentsStreamReader(_Read, DataSourceStreamReader):
    """Offsets are the time of change and path of the last file that was read: a file has to be whole when it gets its name."""

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"at": json.dumps(list(files[-1][:2]) if files else [-1, ""])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (tuple(json.loads(o["at"])) for o in (start, end))
        return dealt([f for f in self.wanted(listed(self.path)) if low < f[:2] <= high], self.most)


class DocumentsSource(DataSource):
    """Options: path, and partitionBytes, the bytes that one task opens."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DocumentsReader:
        return DocumentsReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DocumentsStreamReader:
        return DocumentsStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it: Spark wants a setting for that."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentsSource)
