"""``format("watch_export")``: a Python data source over folders of export archives, for batches and streams, and a sink for archives.

The planner lists the folder and packs archives into partitions by their bytes. A task opens each of its archives once, reads the list of members
and unpacks only those that are asked for: filters on ``filename`` and ``archive`` reach the reader, so other members are never
read and other archives never opened. There is one row for each archive and target, also where the member is missing, so
scanning and extracting need no shuffle.

Paths are those that pyarrow's file systems reach from the driver and the executors: a shared mount, ``hdfs:``, ``s3:``, ``gs:``, ``abfss:``.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from watchloom.session import ship
from watchloom.sources import exports

FORMAT = "watch_export"
SCHEMA = "archive string, filename string, members long, member string, pos long, raw binary, size_bytes long, error string, missing boolean"
#: Bytes of archives that one partition holds, unless a single archive has more, and nanoseconds for which late archives are waited for.
PARTITION_BYTES, OVERLAP_NS = 128 * 2**20, 3600 * 10**9
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ARROW = pa.schema(
    [("archive", pa.string()), ("filename", pa.string()), ("members", pa.int64()), ("member", pa.string()), ("pos", pa.int64()), ("raw", pa.binary()), ("size_bytes", pa.int64()), ("error", pa.string()), ("missing", pa.bool_())]
)


@dataclass
class Archives(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else path.rstrip("/"))


def _listed(path: str) -> list[fs.FileInfo]:
    """The archives below ``path`` by name; what is being written lies in folders that begin with ``_``."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.endswith(".zip") and "/_" not in f.path[len(root) :]), key=lambda f: f.path)


def _packed(files: list[fs.FileInfo], limit: int) -> list[Archives]:
    out, held = [], 0
    for f in files:
        if not out or held + f.size > limit:
            out.append(Archives([]))
            held = 0
        out[-1].paths.append(f.path)
        held += f.size
    return out


def _members(body, targets: list[str], match: str) -> Iterator[tuple]:
    """``filename, members, member, pos, raw, size_bytes, error, missing`` for each target of an open archive."""
    try:
        with zipfile.ZipFile(body) as z:
            listed = z.infolist()
            names = [i.filename.rsplit("/", 1)[-1] for i in listed]
            names = names if match == "first" else [n.lower() for n in names]
            for target in targets:
                at = [k for k, n in enumerate(names) if n == target]
                if not at:
                    yield target, len(listed), None, None, None, None, None, True
                    continue
                pos = at[0] if match == "first" else at[-1]
                raw = error = None
                try:
                    raw = z.read(listed[pos])
                except (RuntimeError, zipfile.BadZipFile, zlib.error, EOFError, OSError, pa.ArrowInvalid, NotImplementedError) as e:
                    error = type(e).__name__
                yield target, len(listed), listed[pos].filename, pos, raw, listed[pos].file_size, error, False
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for a file shorter than any archive
        for target in targets:
            yield target, 0, None, None, None, None, "BadZipFile", True


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.match = options.get("match", "first")
        self.targets = [t.strip() for t in options.get("targets", ",".join(exports.TARGETS)).split(",")]
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.overlap = int(float(options.get("overlapSeconds", OVERLAP_NS / 1e9)) * 1e9)
        if self.match not in ("first", "last_ci"):
            raise ValueError(f"match is 'first' or 'last_ci', not {self.match!r}")

    def rows(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as body:
                rows = [(path, *r) for r in _members(body, self.targets, self.match)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ExportReader(DataSourceReader, _Options):
    archives: tuple[str, ...] | None = None

    def __init__(self, options: dict):
        _Options.__init__(self, options)

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Equality on ``filename`` and ``archive`` narrows what is read; all else is left to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("filename",):
                self.targets = [t for t in self.targets if t in values]
            elif values is not None and f.attribute == ("archive",):
                self.archives = tuple(v for v in values if self.archives is None or v in self.archives)
            else:
                yield f

    def partitions(self) -> list[Archives]:
        files = [f for f in _listed(self.path) if self.archives is None or f.path in self.archives] if self.targets else []
        return _packed(files, self.limit) or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class ExportStreamReader(DataSourceStreamReader, _Options):
    """An offset holds the time of the last change seen and the names of the archives that changed shortly before it.

    An archive that shows up late, by a move for example, is still found if it was changed within ``overlapSeconds`` of the newest one
    seen by then. So the offset grows with the archives of that span, not with all.
    """

    def __init__(self, options: dict):
        _Options.__init__(self, options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto": 0, "recent": "[]"}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.path)
        upto = max((f.mtime_ns for f in files), default=0)
        return {"upto": upto, "recent": json.dumps([f.path for f in files if f.mtime_ns > upto - self.overlap])}

    def _seen(self, offset: dict, recent: set, f: fs.FileInfo) -> bool:
        return f.path in recent or f.mtime_ns <= offset["upto"] - self.overlap

    def partitions(self, start: dict, end: dict) -> list[Archives]:
        old, new = set(json.loads(start["recent"])), set(json.loads(end["recent"]))
        return _packed([f for f in _listed(self.path) if self._seen(end, new, f) and not self._seen(start, old, f)], self.limit)

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ExportWriter(DataSourceWriter):
    """Rows ``archive, files array<struct<filename, content>>`` become archives; they show up together when the job commits."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def _aside(self) -> tuple[fs.FileSystem, str, str]:
        store, root = _store(self.path)
        return store, root, f"{root}/_pending-{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, _, aside = self._aside()
        store.create_dir(aside, recursive=True)
        names, attempt = [], uuid.uuid4().hex
        for row in rows:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for f in row.files:
                    z.writestr(zipfile.ZipInfo(f.filename), f.content)
            names.append(f"{attempt}-{row.archive}")
            with store.open_output_stream(f"{aside}/{names[-1]}") as out:
                out.write(buffer.getvalue())
        return Written(names)

    def commit(self, messages: list) -> None:
        store, root, aside = self._aside()
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{aside}/{name}", f"{root}/{name.split('-', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, _, aside = self._aside()
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)


class WatchExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExportReader:
        return ExportReader(self.options)

    def streamReader(self, schema) -> ExportStreamReader:  # noqa: N802
        return ExportStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        if overwrite:
            raise ValueError("archives are added only: use mode('append')")
        return ExportWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and let filters reach it unless the session has settled that itself."""
    ship(spark).dataSource.register(WatchExport)
    if not spark._jsparkSession.sessionState().conf().contains(_PUSHDOWN):
        spark.conf.set(_PUSHDOWN, "true")
    return spark


def files(found: DataFrame, user: Column | None = None, match: str = "first") -> DataFrame:
    """``user_id, archive, filename, content_type, content, size_bytes`` of the members that are there, from rows of the source.

    The user is the archive's name without its ending unless ``user`` says otherwise. With ``last_ci`` members that are not UTF-8 are left out.
    """
    own = found.filter(~F.col("missing") & F.col("raw").isNotNull())
    if match == "last_ci":
        own = own.filter(F.is_valid_utf8(F.col("raw").cast("string")))
    kind = F.when(F.col("filename").endswith(".json"), "application/json").otherwise("text/csv")
    named = F.regexp_extract("archive", r"([^/]*)\.zip$", 1) if user is None else user
    return own.select(named.alias("user_id"), "archive", "filename", kind.alias("content_type"), exports.decoded(F.col("raw")).alias("content"), "size_bytes")
