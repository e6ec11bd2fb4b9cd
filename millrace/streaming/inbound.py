"""Streams: recurring inbound messages applied once each, windows with watermarks, and failure counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.keyed import KeyedTable
from millrace.session import discard, materialize
from millrace.types import quoted


def inbound_files(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """JSON payload files as a stream of their text, at most so many files a run."""
    return spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).load(path).withColumnRenamed("value", "payload")


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, ledger: str, once: bool = False, every: str = "2 minutes") -> StreamingQuery:
    """handle(batch, id) for each micro-batch, once: ids that the ledger folder lists are skipped on a retry.

    handle must write to paths of its own batch id (a rerun after a loss overwrites them); the ledger
    entry follows its return.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch={number}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            return
        handle(batch, number)
        files.mkdirs(path)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _dealt(batch: DataFrame, key: str) -> DataFrame:
    """A batch read once and dealt over tasks by its ids, those without one by number: a file may be one task's to read, and all later steps would be too."""
    deal = F.when(F.col(quoted(key)).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(F.col(quoted(key))))
    return materialize(batch.withColumn("_deal", deal).repartition("_deal").drop("_deal"), "batch")


def apply_once(
    stream: DataFrame, table: KeyedTable, make: Callable[[DataFrame, DataFrame], DataFrame], key: str, checkpoint: str, ledger: str,
    order_by: list[str] | str | None = None, once: bool = False, every: str = "2 minutes",
) -> StreamingQuery:
    """Messages merged into a keyed table, each once, wherever in a batch a run is lost and however often one is sent.

    make(messages, current) gives the rows to merge from new messages and the table as it is, so it may add to what is
    there. Each batch has an entry in the ledger, written before anything else: the ids of its messages and
    the version that it is to become. A message is new if no other entry has its id. The merge is published in
    one step, as that version. A rerun finds its entry, and with it the version: if that is
    published, the batch is done, else it is merged again from the same messages into the same version.

    Of a message sent twice in one batch both copies reach make. Messages with a null id can't be known again:
    they are applied once for each time they are sent. One query writes a table; a checkpoint of another name
    is another run, whose batches have entries of their own. Only entries whose ids reach into a batch's range are read.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()

    def run(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{name}-{number:09d}"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch={own}/_SUCCESS")
        kind, held = batch.schema[key].dataType.simpleString(), None
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = _dealt(batch, key)
            ids = held.select(F.col(quoted(key)).alias("id"), F.lit(None).cast("long").alias("version")).where("id IS NOT NULL").distinct()
            target = spark.range(1).select(F.lit(None).cast(kind).alias("id"), F.lit(table.latest() + 1).cast("long").alias("version"))
            ids.unionByName(target).write.mode("overwrite").parquet(f"{ledger}/batch={own}")
        entry = spark.read.schema(f"id {kind}, version long").parquet(f"{ledger}/batch={own}")
        version, low, high = entry.agg(F.max("version"), F.min("id"), F.max("id")).first()
        if table.published(version):
            return
        table.withdraw(version)
        entries = spark.read.schema(f"id {kind}, version long, batch string").parquet(ledger)
        seen = entries.where((F.col("batch") != own) & F.col("id").between(low, high)).select("id").distinct()
        held = _dealt(batch, key) if held is None else held
        fresh = materialize(held.join(seen, held[quoted(key)] == seen["id"], "left_anti"), "messages")
        made = materialize(make(fresh, table.read(version - 1)), "applied")
        table.merge(version - 1, made, order_by)
        discard(held, fresh, made)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed(stream: DataFrame, ts: str, every: str, aggs: dict[str, Column], period: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Window aggregates on a stream; rows later than the watermark are dropped."""
    window = F.window(F.col(quoted(ts)), period or every, every)
    out = stream.withWatermark(ts, late).groupBy(*[F.col(quoted(c)) for c in by], window.alias("w")).agg(*[e.alias(n) for n, e in aggs.items()])
    return out.select(*[F.col(quoted(c)) for c in by], F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[F.col(quoted(n)) for n in aggs])


def failures(stream: DataFrame, failed: Column, keys: list[str], ts: str, minutes: int = 15, most: int = 5, step: int = 1, late: str = "10 minutes") -> DataFrame:
    """Sliding failure counts of a stream and whether they reach the most allowed."""
    out = windowed(stream, ts, f"{step} minutes", {"n_failed": F.count_if(failed)}, f"{minutes} minutes", late, keys)
    return out.withColumn("locked", F.col("n_failed") >= most)
