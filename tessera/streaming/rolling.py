"""A sink of JSON lines in files that are rolled at a size, as a Python data source; sinks in memory and for nothing.

``df.writeStream.format("rolling_json")`` with options ``path``, ``max_bytes`` (32 MiB unless given; a longer line has a file of its own) and
``profile``: ``off`` writes nothing, ``minimal`` only the events named in ``events`` (comma-separated), ``standard`` all; the field ``event``
holds a row's event. Tasks write files under names of their own. A batch's commit writes one manifest, named by the batch's
number, that lists its files; readers see only files of manifests. So a batch that is written again replaces its own rows,
files of failed tasks and aborted batches are never read, and an aborted batch removes what it knows of.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MAX_BYTES = 32 << 20
PROFILES = ("off", "minimal", "standard")


def _store(path: str):
    """(file system, path in it) of a path with or without a scheme, whatever store it names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RollingWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.most = options["path"].rstrip("/"), int(options.get("max_bytes", MAX_BYTES))
        self.profile = options.get("profile", "standard")
        self.events = frozenset(filter(None, options.get("events", "").split(",")))
        if self.profile not in PROFILES:
            raise ValueError(f"profile {self.profile!r} is none of {PROFILES}")

    def _wanted(self, row: Row) -> bool:
        return self.profile == "standard" or self.profile == "minimal" and row["event"] in self.events

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        files, out, size = [], None, 0
        try:
            for row in iterator:
                if not self._wanted(row):
                    continue
                line = (json.dumps(row.asDict(True), default=str, ensure_ascii=False) + "\n").encode()
                if out is None or size and size + len(line) > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.jsonl")
                    store.create_dir(posixpath.join(root, "rows"))
                    out, size = store.open_output_stream(posixpath.join(root, "rows", files[-1])), 0
                out.write(line)
                size += len(line)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.path)
        folder = posixpath.join(root, "commits")
        store.create_dir(folder)
        draft = posixpath.join(root, f"draft-{uuid.uuid4().hex}")
        with store.open_output_stream(draft) as out:
            out.write("".join(json.dumps({"batch": batchId, "file": f}) + "\n" for m in messages if m for f in m.files).encode())
        store.move(draft, posixpath.join(folder, f"{batchId:012}.jsonl"))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(posixpath.join(root, "rows", f))


class RollingJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rolling_json"

    def streamWriter(self, schema: StructType, overwrite: bool) -> RollingWriter:  # noqa: N802
        return RollingWriter(dict(self.options))


def committed(spark: SparkSession, path: str) -> list[str]:
    """Files of the committed batches: as many as were rolled."""
    try:
        listed = spark.read.schema("batch long, file string").json(f"{path}/commits").orderBy("batch", "file").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return [f"{path}/rows/{r.file}" for r in listed]


def read_rolled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the committed batches."""
    files = committed(spark, path)
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def sink(rows: DataFrame, kind: str, place: str, checkpoint: str, **options):
    """The stream ``rows`` into ``rolling`` files under ``place``, into the ``memory`` table ``place``, or into ``null``; started, for all that is there."""
    if kind not in ("rolling", "memory", "null"):
        raise ValueError(f"no sink is called {kind!r}")
    writer = rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    match kind:
        case "rolling":
            rows.sparkSession.dataSource.register(RollingJson)
            return writer.format("rolling_json").options(path=place, **{k: str(v) for k, v in options.items()}).start()
        case "memory":
            return writer.format("memory").queryName(place).start()
        case _:
            return writer.format("noop").start()
