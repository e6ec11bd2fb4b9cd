"""What a folder holds: entities with their columns, targeted or whole, and landing of uploads as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import entity_of
from millrace.sources import files
from millrace.sources.arrow_ipc import read_arrow
from millrace.sources.workbook import read_workbook, sheet_names

COLUMNS = "entity string, column string, type string, nullable boolean, ordinal int, path string, format string"


def listing(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(name, path, format) of the supported files and datasets directly in a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in system.listStatus(folder):
        name = s.getPath().getName()
        stem, dot, extension = name.rpartition(".")
        kind = files.EXTENSIONS.get(extension.lower()) if dot else None
        if kind and not name.startswith(("_", ".")):
            out.append((stem, s.getPath().toString(), kind))
    return sorted(out)


def read_any(spark: SparkSession, path: str, kind: str, sheet: str | None = None) -> DataFrame:
    if kind == "csv":
        return files.read_csv(spark, path)
    if kind == "json":
        lines = path.rsplit(".", 1)[-1].lower() in ("ndjson", "jsonl")
        return files.read_json(spark, path, multiline=not lines)
    if kind == "arrow_ipc":
        return read_arrow(spark, path)
    if kind == "workbook":
        return read_workbook(spark, path, sheet)
    return spark.read.format(kind).load(path)


def entities(spark: SparkSession, path: str) -> list[tuple[str, str, str, str | None]]:
    """(entity, path, format, sheet): a file each, or a sheet each of a workbook."""
    out = []
    for name, place, kind in listing(spark, path):
        if kind == "workbook":
            out += [(f"{name}__{r.sheet}", place, kind, r.sheet) for r in sheet_names(spark, place).orderBy("sheet").collect()]
        else:
            out.append((name, place, kind, None))
    return out


def discover(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """A row for each column of each entity; files that can't be read are left out unless that leaves nothing.

    wanted: a frame of entity and, if it has one, column: only those are listed, missing ones silently not.
    """
    rows, failed = [], None
    for name, place, kind, sheet in entities(spark, path):
        try:
            columns = entity_of(read_any(spark, place, kind, sheet), name).columns
        except Exception as why:  # noqa: BLE001  an unreadable file is skipped
            failed = why
            continue
        rows += [(name, c.name, c.type, c.nullable, c.ordinal, place, kind) for c in columns]
    if not rows and failed is not None:
        raise ValueError(f"nothing in {path} can be read: {failed}") from failed
    found = spark.createDataFrame(rows, COLUMNS)
    if wanted is not None:
        found = found.join(wanted, [c for c in ("entity", "column") if c in wanted.columns], "left_semi")
    return found.orderBy("entity", "ordinal")


def land(spark: SparkSession, path: str, out_dir: str) -> DataFrame:
    """entity, path, rows: each supported file as one snappy Parquet folder under out_dir."""
    rows = []
    for name, place, kind, sheet in entities(spark, path):
        target = f"{out_dir}/{name}.parquet"
        files.write_parquet(read_any(spark, place, kind, sheet), target, "overwrite")
        rows.append((name, target, spark.read.parquet(target).count()))
    return spark.createDataFrame(rows, "entity string, path string, rows long")


def snapshot_metadata(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Metadata of all sources in one frame; a source that fails is one row with its message."""
    parts = []
    for name, path in sources.items():
        try:
            parts.append(discover(spark, path).select(F.lit(name).alias("source"), "*", F.lit(None).cast("string").alias("message")))
        except Exception as why:  # noqa: BLE001  one source's failure is a row of the result
            empty = spark.createDataFrame([(name, str(why).splitlines()[0][:500])], "source string, message string")
            parts.append(empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
