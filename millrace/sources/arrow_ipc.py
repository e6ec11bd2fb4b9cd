"""Arrow IPC files and streams, in any store that Spark (listing, reading) and Arrow (reading by batch, writing) know.

A file is read by its record batches through a Spark data source: parts of a file go to different tasks, and
a task reads the footer and then only its own batches, of each only the columns asked for. The driver lists
names and sizes and reads one schema. A stream has no footer, so one task reads it, batch by batch. In stores that only
Spark can open, a file is one row of the binary reader (2 GB at most).

A write is published when its job commits: what lost or repeated tasks wrote stays in a staging folder
and goes with it.

Defined cases: columns are matched by name, and a file that lacks one gives nulls; a file without batches or rows gives none; no
file at all is an error, as is an unknown column; more parts than batches leave some parts empty.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from millrace.session import ship

#: Rows of the batches that tasks hand to Spark.
_ROWS = 10_000


def _store(path: str):
    """Arrow's file system of a path and the place in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _reader(source, columns: list[str] | None = None):
    """The reader of an IPC file or stream, told apart by its first bytes, over the named columns that it has."""
    start = source.tell()
    opened = pa.ipc.open_file if source.read(6) == b"ARROW1" else pa.ipc.open_stream
    source.seek(start)
    found = opened(source)
    if columns is None:
        return found
    source.seek(start)
    # no index stands for all columns, so the first one is read where a file has none of the names
    held = [k for k, name in enumerate(found.schema.names) if name in columns] or [0]
    return opened(source, options=pa.ipc.IpcReadOptions(included_fields=held))


def _read(source, wanted: pa.Schema, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """Share `part` of `parts` of the batches (of a stream: part 0 has all), as the wanted schema in small batches."""
    reader = _reader(source, wanted.names)
    if hasattr(reader, "num_record_batches"):
        n = reader.num_record_batches
        batches = (reader.get_batch(k) for k in range(n * part // parts, n * (part + 1) // parts))
    else:
        batches = iter(reader) if part == 0 else iter(())
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            some = batch.slice(at, _ROWS)
            held = [some.column(f.name).cast(f.type) if f.name in some.schema.names else pa.nulls(some.num_rows, f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays(held, schema=wanted)


class FilePart(InputPartition):
    def __init__(self, file: str, part: int, parts: int):
        self.file, self.part, self.parts = file, part, parts


class ArrowFilesReader(DataSourceReader):
    """One partition for each part of a file; a file has as many parts as its size holds part_bytes."""

    def __init__(self, schema: T.StructType, options: dict):
        self.wanted = to_arrow_schema(schema)
        self.files, self.part_bytes = json.loads(options["files"]), int(options["part_bytes"])

    def partitions(self) -> list[FilePart]:
        out = []
        for file, size in self.files:
            parts = max(1, -(-size // self.part_bytes))
            out += [FilePart(file, k, parts) for k in range(parts)]
        return out

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        store, place = _store(part.file)
        with store.open_input_file(place) as source:
            yield from _read(source, self.wanted, part.part, part.parts)


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc_files"

    def reader(self, schema: T.StructType) -> ArrowFilesReader:
        return ArrowFilesReader(schema, self.options)


def _spark_schema(schema: pa.Schema, columns: list[str] | None) -> T.StructType:
    every = from_arrow_schema(schema, prefer_timestamp_ntz=True)
    if columns is None:
        return every
    if missing := [c for c in columns if c not in every.names]:
        raise ValueError(f"no columns {missing}")
    return T.StructType([every[c] for c in columns])


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, part_bytes: int | None = None) -> DataFrame:
    """IPC or Feather files under a path; the first by name gives the schema.

    columns: those to read, in this order; others are not fetched from a file. part_bytes: size of the parts that
    go to tasks, spark.sql.files.maxPartitionBytes if not given; batches are never cut, so a part has whole ones.
    """
    listed = spark.read.format("binaryFile").load(path)
    files = sorted((r.path, r.length) for r in listed.select("path", "length").collect())
    if not files:
        raise FileNotFoundError(path)
    ship(spark)
    try:
        store, place = _store(files[0][0])
    except pa.ArrowInvalid:
        return _read_rows(listed, columns)
    with store.open_input_file(place) as source:
        schema = _spark_schema(_reader(source).schema, columns)
    if part_bytes is None:
        part_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_ipc_files").schema(schema).option("files", json.dumps(files)).option("part_bytes", part_bytes).load()


def _read_rows(listed: DataFrame, columns: list[str] | None) -> DataFrame:
    """Whole files as rows of Spark's binary reader, for stores that Arrow can't open; a task finds the schema."""

    def head(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column("content"):
                found = _reader(pa.BufferReader(content.as_buffer())).schema.serialize()
                yield pa.RecordBatch.from_arrays([pa.array([found.to_pybytes()], pa.binary())], names=["schema"])

    first = listed.orderBy("path").limit(1).select("content").mapInArrow(head, "schema binary").first()
    schema = _spark_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first[0]))), columns)
    wanted = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column("content"):
                yield from _read(pa.BufferReader(content.as_buffer()), wanted)

    return listed.select("content").mapInArrow(run, schema)


def write_arrow(df: DataFrame, path: str, stream: bool = False) -> DataFrame:
    """One IPC file a partition, written by the executors through the Python data source; returns file and rows."""
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        file: str | None
        rows: int

    class Writer(DataSourceArrowWriter):
        """Tasks write under _staging; only the files of attempts that the job commits are moved to the path."""

        def __init__(self, options: dict):
            self.path, self.stream = options["path"], options.get("stream") == "true"
            self.staging = f"_staging-{options['job']}"

        def _store(self):
            return _store(self.path)

        def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
            store, place = self._store()
            store.create_dir(f"{place}/{self.staging}", recursive=True)
            name, rows, out, sink = f"part-{uuid.uuid4().hex}.arrow", 0, None, None
            for batch in batches:
                if sink is None:
                    out = store.open_output_stream(f"{place}/{self.staging}/{name}")
                    sink = (pa.ipc.new_stream if self.stream else pa.ipc.new_file)(out, batch.schema)
                sink.write_batch(batch)
                rows += batch.num_rows
            if sink is not None:
                sink.close()
                out.close()
            return Written(name if sink is not None else None, rows)

        def commit(self, messages: list) -> None:
            store, place = self._store()
            for m in messages:
                if m is not None and m.file is not None:
                    store.move(f"{place}/{self.staging}/{m.file}", f"{place}/{m.file}")
            self.abort(messages)

        def abort(self, messages: list) -> None:
            from pyarrow import fs

            store, place = self._store()
            if store.get_file_info(f"{place}/{self.staging}").type == fs.FileType.Directory:
                store.delete_dir(f"{place}/{self.staging}")

    class ArrowIpc(DataSource):
        @classmethod
        def name(cls) -> str:
            return "arrow_ipc"

        def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
            return Writer(self.options)

    spark = df.sparkSession
    spark.dataSource.register(ArrowIpc)
    df.write.format("arrow_ipc").mode("append").option("job", uuid.uuid4().hex).option("path", path).option("stream", str(stream).lower()).save()
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
