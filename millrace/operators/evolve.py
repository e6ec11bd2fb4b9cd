"""Schema alignment, rebuilds, single columns, and migration of whole sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Entity, Locator
from millrace.functions.cells import bool_flag
from millrace.operators.tables import AUDIT, upsert
from millrace.types import quoted

MANAGED = set(AUDIT)


def _family(kind: T.DataType) -> str:
    for name, classes in (("text", (T.StringType, T.VarcharType, T.CharType)), ("number", (T.NumericType,)), ("bool", (T.BooleanType,)), ("time", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("binary", (T.BinaryType,))):
        if isinstance(kind, classes):
            return name
    return kind.typeName()


def column_action(current: T.StructField | None, wanted: T.StructField) -> str:
    """add, none, modify (text that must hold more, a wider number) or rebuild (another family)."""
    if current is None:
        return "add"
    if _family(current.dataType) != _family(wanted.dataType):
        return "rebuild"
    if _family(wanted.dataType) == "text":
        have, want = (f.metadata.get("max_length") for f in (current, wanted))
        return "none" if have is None or (want is not None and want <= have) else "modify"
    if current.dataType == wanted.dataType:
        return "none"
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType]
    kinds = [type(current.dataType), type(wanted.dataType)]
    if all(k in order for k in kinds):
        if kinds[0] is kinds[1] is T.DecimalType:
            wider = wanted.dataType.scale >= current.dataType.scale and wanted.dataType.precision - wanted.dataType.scale >= current.dataType.precision - current.dataType.scale
            return "modify" if wider else "rebuild"
        return "modify" if order.index(kinds[0]) < order.index(kinds[1]) else "rebuild"
    return "rebuild"


def diff_schema(spark: SparkSession, current: T.StructType, wanted: T.StructType) -> DataFrame:
    have = {f.name: f for f in current}
    rows = [(f.name, column_action(have.get(f.name), f), f.dataType.simpleString()) for f in wanted]
    return spark.createDataFrame(rows, "column string, action string, type string")


def default_of(kind: T.DataType, nullable: bool, declared=None) -> Column:
    """A declared default; else blank, zero or 1970-01-01 where null is not allowed; else null."""
    if declared is not None:
        return F.lit(declared).cast(kind)
    if nullable:
        return F.lit(None).cast(kind)
    return {"text": F.lit(" "), "number": F.lit(0), "bool": F.lit(False), "time": F.lit("1970-01-01")}.get(_family(kind), F.lit(None)).cast(kind)


def rebuild(df: DataFrame, wanted: T.StructType, defaults: dict | None = None) -> DataFrame:
    """All wanted columns in one select: existing ones cast (text to number also by its truth value), new ones with their default."""
    defaults = defaults or {}
    out = []
    for f in wanted:
        if f.name not in df.columns:
            value = default_of(f.dataType, f.nullable, defaults.get(f.name))
        else:
            c, old = F.col(quoted(f.name)), df.schema[f.name].dataType
            value = c.try_cast(f.dataType) if _family(old) == "text" else c.cast(f.dataType)
            if _family(old) == "text" and _family(f.dataType) in ("number", "bool"):
                value = F.coalesce(value, bool_flag(c).cast(f.dataType))
            if not f.nullable:
                value = F.coalesce(value, default_of(f.dataType, False, defaults.get(f.name)))
        out.append(value.alias(f.name))
    return df.select(*out)


def align(df: DataFrame, wanted: T.StructType, add: bool = True, defaults: dict | None = None) -> DataFrame:
    """df with the wanted columns added (unless add is false), widened or recast; its other columns stay behind them."""
    have = {f.name: f for f in df.schema}
    target = []
    for f in df.schema:
        new = next((w for w in wanted if w.name == f.name), None)
        target.append(f if new is None or column_action(f, new) == "none" else new)
    if add:
        target += [w for w in wanted if w.name not in have]
    return rebuild(df, T.StructType(target), defaults)


def create_table(spark: SparkSession, name: str, entity: Entity, keys: bool = True, audit: bool = True) -> None:
    """An empty table of an entity, with its managed key and audit columns."""
    fields = [T.StructField(f"{entity.name}_id".lower(), T.LongType(), False)] if keys else []
    fields += [T.StructField(c.name, c.spark_type(), c.nullable) for c in entity.columns if c.spark_type() is not None and c.name not in {f.name for f in fields}]
    if audit:
        fields += [T.StructField(a, T.TimestampType() if a.endswith("_at") else T.StringType()) for a in AUDIT if a not in {f.name for f in fields}]
    spark.createDataFrame([], T.StructType(fields)).write.mode("errorifexists").saveAsTable(name)


def rebuild_table(spark: SparkSession, name: str, wanted: T.StructType, defaults: dict | None = None) -> None:
    """A catalog table rebuilt under a new schema: written as _TMP, swapped by rename, the old one kept as _OLD."""
    rebuild(spark.table(name), wanted, defaults).write.mode("overwrite").saveAsTable(f"{name}_TMP")
    spark.sql(f"DROP TABLE IF EXISTS {name}_OLD")
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}_OLD")
    spark.sql(f"ALTER TABLE {name}_TMP RENAME TO {name}")


def add_column(df: DataFrame, field: T.StructField, default=None) -> DataFrame:
    if field.name in df.columns:
        raise ValueError(f"column {field.name!r} exists")
    return df.withColumn(field.name, default_of(field.dataType, field.nullable, default))


def modify_column(df: DataFrame, field: T.StructField) -> DataFrame:
    if field.name not in df.columns:
        raise ValueError(f"no column {field.name!r}")
    return rebuild(df, T.StructType([field if f.name == field.name else f for f in df.schema]))


def upsert_column(df: DataFrame, field: T.StructField, default=None) -> DataFrame:
    return modify_column(df, field) if field.name in df.columns else add_column(df, field, default)


def drop_column(df: DataFrame, name: str, confirm: bool = False, managed: set[str] = MANAGED) -> DataFrame:
    if name.lower() in managed:
        raise ValueError(f"{name!r} is a managed column")
    if not confirm:
        raise ValueError("dropping a column needs confirm=True")
    return df.drop(name)


def retarget(entity: Entity, namespace: str, source: str = "") -> Entity:
    """The entity as it is to be in another system: upper-case name, new place, no keys, untyped columns left out."""
    from dataclasses import replace

    name = entity.name.upper()
    columns = [replace(c, entity=name, primary_key=False, unique=False, foreign_key=None) for c in entity.columns if c.type is not None]
    return Entity(name, columns, locator=Locator(source, namespace, name))


def drop_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """name, dropped: tables that exist are dropped, others skipped."""
    rows = []
    for n in names:
        there = spark.catalog.tableExists(n)
        if there:
            spark.sql(f"DROP TABLE {n}")
        rows.append((n, there))
    return spark.createDataFrame(rows, "name string, dropped boolean")


def migrate(spark: SparkSession, sources: dict[str, DataFrame], target_path: str, keys: dict[str, list[str]], entities: list[str] | None = None, read: Callable[[str], DataFrame | None] | None = None) -> DataFrame:
    """entity, status, rows, message: each source aligned to its target and upserted on its keys, failures kept apart.

    Targets are versions under target_path/ENTITY; read gives the present one, by default the last version.
    """
    wanted = None if entities is None else {e.lower() for e in entities}
    rows = []
    for name, source in sources.items():
        if wanted is not None and name.lower() not in wanted:
            continue
        try:
            base = f"{target_path}/{name.upper()}"
            present, version = (read(name), None) if read else latest_version(spark, base)
            if present is None:
                present = spark.createDataFrame([], source.schema)
            present = align(present, source.schema)
            after = upsert(present, source, [k for k in keys.get(name, []) if k in source.columns])
            after.write.mode("errorifexists").parquet(f"{base}/v={(version or 0) + 1}")
            rows.append((name, "ok", source.count(), None))
        except Exception as failed:  # noqa: BLE001  one entity's failure is a row of the result
            rows.append((name, "error", None, str(failed).splitlines()[0][:500]))
    return spark.createDataFrame(rows, "entity string, status string, rows long, message string")


def latest_version(spark: SparkSession, base: str) -> tuple[DataFrame | None, int | None]:
    """The last version under a path, and its number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None, None
    found = [int(s.getPath().getName()[2:]) for s in files.listStatus(path) if s.getPath().getName().startswith("v=")]
    return (spark.read.parquet(f"{base}/v={max(found)}"), max(found)) if found else (None, None)


def fan_out_status(results: DataFrame) -> int:
    """200 when every entity went well, 207 when some did, 500 when none did."""
    row = results.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count(F.lit(1)).alias("n")).first()
    return 200 if row["ok"] == row["n"] else 207 if row["ok"] else 500


def migratable(objects: DataFrame, skip_names: list[str] = (), skip_suffixes: list[str] = ("Feed", "History", "Share", "ChangeEvent", "Tag")) -> DataFrame:
    """Business objects: queryable, retrievable, layoutable or searchable, and no system object by name or suffix."""
    use = F.col("queryable") & F.col("retrieveable") & (F.col("layoutable") | F.col("searchable"))
    out = objects.where(use & ~F.col("name").isin(list(skip_names)) if skip_names else use)
    return out.where(~F.col("name").rlike("(?:" + "|".join(skip_suffixes) + ")$")) if skip_suffixes else out
