"""File sources and sinks: CSV, JSON, Parquet, datasets, frames from memory, chunked exports and encryption of columns."""

from __future__ import annotations

import csv
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Entity
from millrace.functions.cells import parse_typed, strip_nul
from millrace.types import quoted

Transform = Callable[[DataFrame], DataFrame] | None
EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet", "pq": "parquet", "feather": "arrow_ipc", "arrow": "arrow_ipc", "ipc": "arrow_ipc", "orc": "orc", "xlsx": "workbook"}


def _then(df: DataFrame, transform: Transform) -> DataFrame:
    return df.transform(transform) if transform else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def scan_csv(spark: SparkSession, path: str, sep: str = ",", null_values: str | list[str] | dict[str, str] | None = None, skip_rows: int = 0, n_rows: int | None = None, schema: T.StructType | str | None = None, transform: Transform = None, sampling: float = 1.0) -> DataFrame:
    """A CSV scan with null tokens (for all or single columns), leading lines to skip in each file, and a callback before it runs."""
    options = {"sep": sep, "samplingRatio": str(sampling)}
    if skip_rows:
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split(F.col("value"), "\r?\n"), skip_rows + 1, 2**31 - 1 - skip_rows)).alias("value")).where("value <> ''")
        header = lines.first()[0]
        names = next(csv.reader([header], delimiter=sep))
        kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        parsed = lines.where(F.col("value") != header).select(F.from_csv("value", ", ".join(f"{quoted(n)} string" for n in names), {"sep": sep}).alias("r")).select("r.*")
        out = parsed.select(*[F.col(quoted(n)).cast(kind[n].dataType if kind is not None else "string").alias(n) for n in names])
    else:
        out = read_csv(spark, path, schema, **options)
    tokens = {c: null_values for c in out.columns} if isinstance(null_values, (str, list)) else (null_values or {})
    out = out.withColumns({c: F.when(~F.col(quoted(c)).cast("string").isin(*([t] if isinstance(t, str) else t)), F.col(quoted(c))) for c, t in tokens.items() if c in out.columns})
    return _then(out if n_rows is None else out.limit(n_rows), transform)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    out = out.where(where) if where else out
    return out.select(*[F.col(quoted(c)) for c in columns]) if columns else out


def scan_parquet(spark: SparkSession, path: str, row_index: str | None = None, order_by: list[str] | None = None, n_rows: int | None = None, transform: Transform = None) -> DataFrame:
    from millrace.operators.rows import with_row_index

    out = spark.read.parquet(path)
    out = with_row_index(out, order_by or out.columns, row_index) if row_index else out
    return _then(out if n_rows is None else out.limit(n_rows), transform)


def read_json(spark: SparkSession, path: str, multiline: bool = False, schema: T.StructType | str | None = None, sampling: float = 1.0, transform: Transform = None) -> DataFrame:
    reader = spark.read.option("multiLine", multiline).option("samplingRatio", sampling)
    return _then((reader.schema(schema) if schema else reader).json(path), transform)


def read_dataset(spark: SparkSession, path: str, format: str = "parquet", columns: list[str] | None = None, where: str | None = None, base_path: str | None = None, schema: T.StructType | str | None = None, directory: list[str] | None = None) -> DataFrame:
    """A partitioned dataset; directory names the levels of folders that are values without a name."""
    reader = spark.read.format(format)
    reader = reader.option("basePath", base_path) if base_path else reader
    reader = reader.schema(schema) if schema else reader
    if directory:
        reader = reader.option("recursiveFileLookup", True)
    out = (reader.option("header", True) if format == "csv" else reader).load(path)
    if directory:
        parts = F.split(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), "/")
        out = out.select("*", *[F.element_at(parts, k - len(directory)).alias(name) for k, name in enumerate(directory)])
    out = out.where(where) if where else out
    return out.select(*columns) if columns else out


def read_many(frames: list[DataFrame]) -> DataFrame:
    """Frames of one schema as one, by position; the names are those of the first."""
    first = frames[0]
    for other in frames[1:]:
        if [f.dataType for f in other.schema] != [f.dataType for f in first.schema]:
            raise ValueError("schemas differ")
    return reduce(DataFrame.union, frames)


def read_bulk_csv(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A page of a bulk export: read as text, NUL characters out, then typed."""
    text = spark.read.schema(", ".join(f"{quoted(c)} string" for c in kinds)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return parse_typed(strip_nul(text), kinds)


def from_records(spark: SparkSession, rows: list[dict], schema: T.StructType | str) -> DataFrame:
    """Rows of dicts; missing keys are null."""
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table, a pandas frame, or anything with a dataframe interchange or Arrow stream interface."""
    import pyarrow as pa

    if hasattr(table, "__arrow_c_stream__") and not isinstance(table, pa.Table):
        table = pa.table(table)
    elif hasattr(table, "__dataframe__") and not isinstance(table, pa.Table):
        from pyarrow.interchange import from_dataframe

        table = from_dataframe(table)
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    return df.toArrow()


def empty_like(spark: SparkSession, entity: Entity) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c.name, c.spark_type(), c.nullable) for c in entity.columns if c.spark_type() is not None]))


def read_or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType | str) -> DataFrame:
    """What read gives, or an empty frame of the schema where it may not be read."""
    try:
        return read()
    except Exception:  # noqa: BLE001  an unreadable source is an empty one here
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_dataset(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] = (), max_rows_per_file: int = 0, existing: str = "error") -> None:
    """existing: error, overwrite_or_ignore (add files), or delete_matching (replace the partitions that are written)."""
    modes = {"error": "errorifexists", "overwrite_or_ignore": "append", "delete_matching": "overwrite"}
    writer = df.write.format(format).mode(modes[existing]).partitionBy(*partition_by)
    if existing == "delete_matching" and partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer = writer.option("maxRecordsPerFile", max_rows_per_file) if max_rows_per_file else writer
    (writer.option("header", True) if format == "csv" else writer).save(path)


def create_data(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.format(format).mode("errorifexists").save(path)


def replace_data(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.format(format).mode("overwrite").save(path)


def drop_data(spark: SparkSession, *paths: str) -> list[bool]:
    """Deletes files or folders; for each whether it was there."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        out.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return out


def export_chunks(df: DataFrame, path: str, chunk_rows: int, line_sep: str = "\n") -> DataFrame:
    """CSV files of at most chunk_rows each; file, rows, size of every file written."""
    df.write.option("header", True).option("maxRecordsPerFile", chunk_rows).option("lineSep", line_sep).csv(path)
    back = df.sparkSession.read.option("header", True).option("lineSep", line_sep).schema(T.StructType([T.StructField(c, T.StringType()) for c in df.columns])).csv(path)
    return back.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("rows"))


def export_sized(df: DataFrame, path: str, chunk_rows: int, chunk_bytes: int, order_by: list[str] | str, line_sep: str = "\n") -> tuple[DataFrame, DataFrame]:
    """CSV files, one a chunk, of at most chunk_rows rows and chunk_bytes bytes (header included), in an order of the rows.

    Returns the chunks (chunk, file, total, size) and the rows whose own line is past the bound, which are in none. A row starts
    a chunk by the rows and bytes before it, so chunks are cut in all tasks at once: a row of at most half the bound is in
    the chunk of its row count and of its bytes over the bound less the longest such row, a longer one is alone. Files stand in folders _chunk=<number>; numbers have gaps.
    No rows give no file.
    """
    from millrace.operators.rows import running_totals

    if "_chunk" in df.columns:
        raise ValueError("column '_chunk' exists")
    size = F.octet_length(F.to_csv(F.struct(*[F.col(quoted(c)) for c in df.columns]))) + len(line_sep)
    bound = chunk_bytes - len(",".join(f'"{c}"' for c in df.columns).encode()) - len(line_sep)
    if chunk_rows < 1 or bound < 1:
        raise ValueError("the bounds hold no row")
    small = F.col("_size") <= bound // 2
    sized = running_totals(df.withColumn("_size", size), order_by, {"_rows": F.when(small, 1), "_bytes": F.when(small, F.col("_size")), "_alone": F.when(~small, 1)})
    longest = sized.where(small).agg(F.max("_size")).first()[0] or 0
    by_size = F.floor(F.col("_rows") / chunk_rows) + F.floor(F.col("_bytes") / (bound - longest + 1))
    # large rows are numbered below zero, each alone
    chunked = sized.withColumn("_chunk", F.when(small, by_size).otherwise(-1 - F.col("_alone")))
    refused = chunked.where(F.col("_size") > bound).select(*[F.col(quoted(c)) for c in df.columns])
    kept = chunked.where(F.col("_size") <= bound)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = kept.repartition(tasks, "_chunk").sortWithinPartitions("_chunk", "_rows").select("_chunk", *[F.col(quoted(c)) for c in df.columns])
    plain.write.partitionBy("_chunk").option("header", True).option("lineSep", line_sep).csv(path)
    number = F.regexp_extract("path", r"_chunk=(-?\d+)/", 1)
    listed = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select(number.cast("long").alias("chunk"), F.col("path").alias("file"), F.col("length").alias("size"))
    totals = kept.groupBy(F.col("_chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("total"))
    return totals.join(listed, "chunk").select("chunk", "file", "total", "size"), refused


def send_chunks(chunks: DataFrame, send: Callable[[bytes], tuple[int, int]]) -> DataFrame:
    """chunk, total, processed, failed, unprocessed, message: each chunk's file is handed to send in a task of its own.

    send gives how many rows were processed and, of these, failed. Where it raises an error, the whole chunk is unprocessed
    and the message says why; the other chunks go on. A task that is lost sends its chunk again.
    """
    listed = chunks.select("chunk", "file", "total")
    spark = chunks.sparkSession

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                chunk, total = batch.column("chunk")[k].as_py(), batch.column("total")[k].as_py()
                try:
                    processed, failed = send(batch.column("content")[k].as_py())
                    out = (chunk, total, processed, failed, total - processed, None)
                except Exception as why:  # noqa: BLE001  a chunk's failure is a row of the result
                    out = (chunk, total, 0, 0, total, f"{type(why).__name__}: {why}"[:500])
                kinds = [pa.int64()] * 5 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=["chunk", "total", "processed", "failed", "unprocessed", "message"])

    folders = [r[0] for r in listed.select(F.regexp_replace("file", "/_chunk=[^/]*/[^/]*$", "")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "chunk long, total long, processed long, failed long, unprocessed long, message string")
    contents = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folders).select(F.col("path").alias("file"), "content")
    return contents.join(listed, "file").select("chunk", "total", "content").mapInArrow(run, "chunk long, total long, processed long, failed long, unprocessed long, message string")


def encrypt_columns(df: DataFrame, columns: list[str], key: str | bytes) -> DataFrame:
    """Columns as text, encrypted by AES-GCM with a 16, 24 or 32 byte key; nulls stay null."""
    k = F.lit(key.encode() if isinstance(key, str) else key)
    return df.withColumns({c: F.aes_encrypt(F.col(quoted(c)).cast("string").cast("binary"), k, F.lit("GCM")) for c in columns})


def decrypt_columns(df: DataFrame, columns: dict[str, str], key: str | bytes) -> DataFrame:
    """columns: name to the type that it is to have again."""
    k = F.lit(key.encode() if isinstance(key, str) else key)
    return df.withColumns({c: F.aes_decrypt(F.col(quoted(c)), k, F.lit("GCM")).cast("string").cast(kind) for c, kind in columns.items()})
