"""A table in files with an index of the keys in each, so that a merge rewrites only the files that hold a key of its rows.

    base/data/<write>/part-*.parquet     files, each written once and never changed
    base/index/<write>/                  for each of these files: rows, least and greatest first key, and bits of key hashes
    base/versions/v=<n>/                 the files that make up a version

A version is a list of files. A merge finds the files that its keys may be in (first keys within the file's
range, by a range join, and then a bit for the hash of the whole key), joins the rows of those files only, and
lists the new files with all the others. A version is published by one write that fails if it exists, so of two
merges of one version only one counts; readers of earlier versions keep their files.

Rows with a null key are in files of their own, which no merge reads. A bit may be set by another key: then
a file is rewritten for nothing, never missed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ranges import join_overlap
from millrace.operators.tables import Audit, single_source, upsert
from millrace.session import discard, materialize
from millrace.types import quoted

#: Bits a key has in its file's index, about; a bitmap is of 32,768 bits, and a file has as many bitmaps as it needs.
BITS_A_KEY, BITMAP = 10, 32_768
#: A task writes so many files one after the other, or as many as have so many rows.
FILES_A_TASK, ROWS_A_TASK = 64, 1_000_000
#: The spans of so many files at most, some 100 bytes each, go to every task.
FEW_FILES = 100_000


class KeyedTable:
    """keys: of which the first orders the files."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], rows_a_file: int = 1_000_000):
        self.spark, self.base, self.keys, self.rows_a_file = spark, base.rstrip("/"), keys, rows_a_file

    # versions

    def files(self, version: int) -> DataFrame:
        """write, file, rows and keyed (whether its rows have keys) of a version's files."""
        return self.spark.read.schema("write string, file string, rows long, keyed boolean").parquet(f"{self.base}/versions/v={version}")

    def read(self, version: int) -> DataFrame:
        return self._rows({(r["write"], r["file"]) for r in self.files(version).collect()})

    def _rows(self, names: set[tuple[str, str]]) -> DataFrame:
        """The rows of files; a folder of which all files are asked for is listed once, not file by file."""
        folders: dict[str, list[str]] = {}
        for write, file in sorted(names):
            folders.setdefault(f"data/{write}/{file.rpartition('/')[0]}", []).append(f"{self.base}/data/{write}/{file}")
        paths = []
        for folder, files in folders.items():
            store, path = self._store(folder)
            paths += [f"{self.base}/{folder}"] if len(files) > 1 and store.getContentSummary(path).getFileCount() == len(files) else files
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    @property
    def schema(self):
        return self.spark.read.parquet(f"{self.base}/schema").schema

    def _store(self, *place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *place]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def published(self, version: int) -> bool:
        store, path = self._store("versions", f"v={version}", "_SUCCESS")
        return store.exists(path)

    def latest(self) -> int:
        """The highest published version."""
        store, path = self._store("versions")
        found = [int(s.getPath().getName().removeprefix("v=")) for s in store.listStatus(path)]
        return max(v for v in found if self.published(v))

    def withdraw(self, version: int) -> None:
        """Takes away what a lost writer left of a version that it didn't publish, so that it can be written again."""
        if not self.published(version):
            store, path = self._store("versions", f"v={version}")
            store.delete(path, True)

    def _publish(self, files: DataFrame, version: int) -> None:
        files.select("write", "file", "rows", "keyed").write.mode("errorifexists").parquet(f"{self.base}/versions/v={version}")

    # writing

    def _complete(self) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(quoted(k)).isNotNull()
        return out

    def _hash(self, names: list[str]) -> Column:
        return F.xxhash64(*[F.col(quoted(k)) for k in names])

    @staticmethod
    def _bit(h: Column, bitmaps: Column) -> tuple[Column, Column]:
        """The bitmap of a hash, of so many, and its place in it."""
        return F.pmod(h, bitmaps).cast("int").alias("bitmap"), F.pmod(F.shiftright(h, 20), F.lit(BITMAP)).cast("int").alias("bit")

    def _write(self, rows: DataFrame, files: int) -> DataFrame:
        """Rows as new files in the order of their keys, those without keys apart, and their index. Returns the new files.

        A task sorts its range of keys and cuts it into files, so there are as many as the rows need and, at most, one more a task.
        """
        write, a_task = uuid.uuid4().hex, max(1, min(FILES_A_TASK, ROWS_A_TASK // self.rows_a_file))
        keyed = self._complete()
        order = [keyed.alias("_keyed"), *[F.col(quoted(k)) for k in self.keys]]
        placed = rows.withColumn("_deal", F.when(keyed, F.lit(0)).otherwise(F.monotonically_increasing_id()))
        placed = placed.repartitionByRange(max(1, -(-files // a_task)), *order, "_deal").withColumn("keyed", keyed).drop("_deal")
        placed = placed.sortWithinPartitions("keyed", *[F.col(quoted(k)) for k in self.keys])  # begins with the folder, else the writer puts a sort by it alone in its place
        placed.write.option("maxRecordsPerFile", self.rows_a_file).partitionBy("keyed").parquet(f"{self.base}/data/{write}")
        first = F.col(quoted(self.keys[0]))
        read = self.spark.read.schema(T.StructType([*self.schema, T.StructField("keyed", T.StringType())])).parquet(f"{self.base}/data/{write}")
        named = read.select(F.concat(F.lit("keyed="), F.col("keyed"), F.lit("/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("file"), F.col("keyed").cast("boolean").alias("keyed"), first.alias("k"), self._hash(self.keys).alias("h"))
        sizes = named.groupBy("file", "keyed").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
        sizes = sizes.withColumn("bitmaps", F.ceil(F.col("rows") * BITS_A_KEY / BITMAP).cast("int"))
        bits = named.where("keyed").join(sizes.select("file", "bitmaps"), "file").select("file", *self._bit(F.col("h"), F.col("bitmaps")))
        bits = bits.groupBy("file", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
        sizes.join(bits.groupBy("file").agg(F.collect_list(F.struct("bitmap", "bits")).alias("maps")), "file", "left").withColumn("write", F.lit(write)).write.parquet(f"{self.base}/index/{write}")
        return self.spark.read.parquet(f"{self.base}/index/{write}").select("write", "file", "rows", "keyed")

    def create(self, rows: DataFrame) -> DataFrame:
        """Version 0."""
        rows.limit(0).write.mode("errorifexists").parquet(f"{self.base}/schema")
        self._publish(self._write(rows, -(-rows.count() // self.rows_a_file)), 0)
        return self.read(0)

    # merging

    def touched(self, version: int, keys: DataFrame) -> DataFrame:
        """write and file of the files that may hold one of these keys."""
        files = self.files(version).where("keyed")
        writes = {r["write"]: r["count"] for r in files.groupBy("write").count().collect()}
        if not writes:
            return files.select("write", "file")
        index = self.spark.read.parquet(*[f"{self.base}/index/{w}" for w in writes]).join(files.select("write", "file"), ["write", "file"])
        asked = keys.where(self._complete()).select(F.col(quoted(self.keys[0])).alias("k"), self._hash(self.keys).alias("h"))
        spans = index.select("write", "file", "low", "high", "bitmaps")
        if sum(writes.values()) <= FEW_FILES:
            spans = F.broadcast(spans)  # else Spark may send the keys to the one task that reads the index
        if spans.schema["low"].dataType.simpleString() in ("string", "binary", "boolean"):
            near = asked.join(spans, (F.col("k") >= F.col("low")) & (F.col("k") <= F.col("high")))
        else:
            near = join_overlap(asked, spans, ("k", "k"), ("low", "high"))
        near = near.select("write", "file", *self._bit(F.col("h"), F.col("bitmaps")))
        maps = index.select("write", "file", F.explode("maps").alias("m")).select("write", "file", "m.bitmap", "m.bits").hint("merge")
        octet = F.conv(F.hex(F.substring("bits", F.expr("bit div 8 + 1"), F.lit(1))), 16, 10).cast("int")
        return near.join(maps, ["write", "file", "bitmap"]).where(F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", octet, F.col("bit") % 8)) == 1).select("write", "file").distinct()

    def merge(self, version: int, rows: DataFrame, order_by: list[str] | str | None = None, audit: Audit | None = None, delete: bool = False) -> dict[str, int]:
        """The next version: rows of known keys update, others are inserted; delete: rows of these keys go instead.

        Returns the files of the version before and how many of them were rewritten.
        """
        source = materialize(rows.select(*self.keys).distinct() if delete else single_source(rows, self.keys, order_by), "source")
        files = self.files(version)
        hit = self.touched(version, source).collect()  # names of files, some for each million rows of the table
        names = {(r["write"], r["file"]) for r in hit}
        old = self._rows(names)
        fresh = old.join(source, self.keys, "left_anti") if delete else upsert(old, source, self.keys, audit=audit)
        gone = self.spark.createDataFrame(sorted(names), "write string, file string")
        kept = files.join(gone, ["write", "file"], "left_anti")
        if not delete or names:
            added = 0 if delete else -(-source.count() // self.rows_a_file)
            kept = kept.unionByName(self._write(fresh, len(names) + added))
        self._publish(kept, version + 1)
        discard(source)
        return {"files": files.count(), "rewritten": len(names)}
