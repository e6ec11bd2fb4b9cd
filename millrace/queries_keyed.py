"""Registered queries of range joins, percentiles of several columns, keyed tables in files, deep slices, dense windows and files read in parts."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, ranges, rows, windows
from millrace.operators.keyed import KeyedTable
from millrace.queries import query, read
from millrace.session import shared_dir
from millrace.sources import arrow_ipc, files, jdbc, workbook
from millrace.streaming import inbound


@query("SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON l_extendedprice >= o_totalprice - 0.05 AND l_extendedprice <= o_totalprice + 0.05")
def join_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return ranges.join_band(line.select("l_orderkey", "l_linenumber", "l_extendedprice"), orders.select("o_orderkey", "o_totalprice"), "l_extendedprice", "o_totalprice", 0.05, 0.05).select("l_orderkey", "l_linenumber", "o_orderkey")


_TIMES = "SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS sent, CAST(l_shipdate AS DATE) + CAST(floor(l_quantity) AS INTEGER) AS got FROM lineitem"


@query(f"""
SELECT a.l_partkey, count(*) AS n FROM ({_TIMES}) a JOIN ({_TIMES}) b
ON a.l_partkey = b.l_partkey AND a.sent <= b.got AND b.sent <= a.got AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber) GROUP BY a.l_partkey
""")
def join_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("sent"), F.date_add(F.to_date("l_shipdate"), F.floor("l_quantity").cast("int")).alias("got"))
    met = ranges.join_overlap(times, times, ("sent", "got"), ("sent", "got"), "l_partkey", suffix="_b")
    later = (F.col("l_orderkey") < F.col("l_orderkey_b")) | (F.col("l_orderkey") == F.col("l_orderkey_b")) & (F.col("l_linenumber") < F.col("l_linenumber_b"))
    return met.where(later).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


_MODES = ("nearest", "higher", "lower", "midpoint", "linear")
_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _described(mode: str, column: str) -> str:
    def at(p: float) -> str:
        x = f"({p} * (n - 1))"
        low, high = f"s[CAST(floor{x} AS BIGINT) + 1]", f"s[CAST(ceil{x} AS BIGINT) + 1]"
        return {"lower": low, "higher": high, "midpoint": f"({low} + {high}) / 2", "linear": f"{low} + ({high} - {low}) * ({x} - floor{x})", "nearest": f"s[CAST(floor({x} + 0.5) AS BIGINT) + 1]"}[mode]

    return f"""SELECT '{mode}' AS mode, '{column}' AS "column", n AS count, round({at(0.01)}, 6) AS p01, round({at(0.5)}, 6) AS p50, round({at(0.9)}, 6) AS p90
    FROM (SELECT count({column}) AS n, list(CAST({column} AS DOUBLE) ORDER BY {column}) FILTER (WHERE {column} IS NOT NULL) AS s FROM lineitem)"""


@query("\nUNION ALL ".join(_described(m, c) for m in _MODES for c in _COLUMNS))
def describe_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, out = read(spark, sf_dir, "lineitem"), None
    for mode in _MODES:
        part = aggregates.describe(line, list(_COLUMNS), (0.01, 0.5, 0.9), mode)
        part = part.select(F.lit(mode).alias("mode"), "column", "count", *[F.round(c, 6).alias(c) for c in ("p01", "p50", "p90")])
        out = part if out is None else out.unionByName(part)
    return out


def _customers(spark: SparkSession, sf_dir: str) -> KeyedTable:
    table = KeyedTable(spark, f"{shared_dir(spark)}/millrace-keyed-{uuid.uuid4().hex}", ["c_custkey"], 500)
    table.create(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return table


@query("""
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN c_name ELSE name END AS c_name, CASE WHEN k IS NULL THEN c_acctbal ELSE bal END AS c_acctbal
FROM customer FULL JOIN (SELECT o_custkey + 1000000 AS k, 'x' AS name, round(sum(o_totalprice), 2) AS bal FROM orders GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'ordered', CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_custkey HAVING count(*) > 12) ON c_custkey = k
""")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with many orders are updated, and a customer is added for each that orders, in a table in files."""
    orders, table = read(spark, sf_dir, "orders"), _customers(spark, sf_dir)
    added = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal")).select((F.col("o_custkey") + 1000000).alias("c_custkey"), F.lit("x").alias("c_name"), "c_acctbal")
    busy = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12").select(F.col("o_custkey").alias("c_custkey"), F.lit("ordered").alias("c_name"), F.col("n").cast("double").alias("c_acctbal"))
    table.merge(0, added.unionByName(busy))
    return table.read(1)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _customers(spark, sf_dir)
    table.merge(0, read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), delete=True)
    return table.read(1)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber OFFSET 30000")
def slice_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.slice_rows(read(spark, sf_dir, "lineitem"), 30000, None, ["l_extendedprice", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""
SELECT event_type, f + INTERVAL 1 HOUR * CAST(floor(epoch(ts - f) / 3600) AS BIGINT) AS ts, count(*) AS n
FROM (SELECT event_type, ts, min(ts) OVER (PARTITION BY event_type) AS f FROM events) GROUP BY ALL
""")
def dyn_from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_by_dynamic(read(spark, sf_dir, "events"), "ts", "1h", {"n": F.count(F.lit(1))}, start_by="datapoint", by=["event_type"])


@query("""
SELECT event_id, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS total, CAST(sum(cents) OVER w AS DOUBLE) / count(*) OVER w AS mean, min(cents) OVER w AS low, max(cents) OVER w AS high
FROM (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '7775999.999999 seconds' PRECEDING AND CURRENT ROW)
""")
def rolling_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No keys, and windows of 90 days that hold nearly all events; whole cents, so that no sum depends on its order."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    aggs = {"n": ("count", None), "total": ("sum", "cents"), "mean": ("mean", "cents"), "low": ("min", "cents"), "high": ("max", "cents")}
    return windows.rolling(events, "ts", "90d", aggs).select("event_id", *aggs)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def arrow_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of wide Arrow files, read in parts of 1 MB."""
    path = f"{shared_dir(spark)}/millrace-arrow-{uuid.uuid4().hex}"
    arrow_ipc.write_arrow(read(spark, sf_dir, "lineitem"), path)
    return arrow_ipc.read_arrow(spark, path, ["l_orderkey", "l_linenumber", "l_quantity"], 1 << 20)


class _Lossy(KeyedTable):
    """Lost once before its second merge is published, and once after the third is."""

    lost: set[int]

    def _publish(self, files: DataFrame, version: int) -> None:
        if version == 2 and version not in self.lost:
            self.lost.add(version)
            raise RuntimeError("lost before publishing")
        super()._publish(files, version)
        if version == 3 and version not in self.lost:
            self.lost.add(version)
            raise RuntimeError("lost after publishing")


@query("""
SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) + coalesce(spent, 0) AS cents
FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a message that adds to its customer's balance; a tenth are sent again, and the stream is lost twice half-way and started anew."""
    base = f"{shared_dir(spark)}/millrace-once-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mq_id"), F.col("o_custkey").alias("c_custkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    again = orders.where("pmod(hash(mq_id), 10) = 0").withColumn("sent", F.lit(2))
    sent = orders.withColumn("sent", F.lit(1)).unionByName(again)
    sent.repartition(3, "mq_id", "sent").drop("sent").write.parquet(f"{base}/in")
    table = _Lossy(spark, f"{base}/table", ["c_custkey"], 500_000)
    table.lost = set()
    table.create(read(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")))

    def add(messages: DataFrame, current: DataFrame) -> DataFrame:
        sums = messages.dropDuplicates(["mq_id"]).groupBy("c_custkey").agg(F.sum("cents").alias("more"))
        return current.join(sums, "c_custkey").select("c_custkey", (F.col("cents") + F.col("more")).alias("cents"))

    for _ in range(3):
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        try:
            inbound.apply_once(stream, table, add, "mq_id", f"{base}/state", f"{base}/ledger", once=True).awaitTermination()
        except StreamingQueryException as e:
            if "lost" not in str(e):
                raise
    assert table.lost == {2, 3}
    return table.read(table.latest())


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment, 1 AS several FROM customer")
def workbook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks of bounded rows, most names outside the shared texts, read back by blocks that several tasks parse."""
    path = f"{shared_dir(spark)}/workbook-{uuid.uuid4().hex}"
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    workbook.write_workbook(customers, path, "Customers", 400_000, most_shared=100)
    back = workbook.read_workbook(spark, path, "Customers", block_bytes=1 << 14)
    tasks = back.select(F.spark_partition_id().alias("p")).distinct().count()
    return back.withColumn("several", F.lit(int(tasks > 1)))


_LINES = "SELECT o_orderkey, length(o_orderkey || ',' || o_custkey) + 1 AS n FROM orders"


@query(f"""
WITH l AS ({_LINES}), s AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, max(n) OVER () AS m FROM l),
c AS (SELECT *, i // 700 + CAST(b AS BIGINT) // (8192 - 25 - m + 1) AS chunk FROM s)
SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS total, CAST(sum(n) + 21 AS BIGINT) AS size, count(*) AS processed, CAST(count(*) FILTER (o_orderkey % 7 = 0) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS unprocessed FROM c GROUP BY chunk
""")
def chunks_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks bounded by rows and bytes, each handed over by a task; what came of each."""
    path = f"{shared_dir(spark)}/sized-{uuid.uuid4().hex}"
    chunks, _ = files.export_sized(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, 700, 8192, "o_orderkey")

    def send(content: bytes) -> tuple[int, int]:
        keys = [int(line.split(b",")[0]) for line in content.splitlines()[1:]]
        return len(keys), sum(k % 7 == 0 for k in keys)

    return files.send_chunks(chunks, send).join(chunks.select("chunk", "size"), "chunk").select("chunk", "total", "size", "processed", "failed", "unprocessed")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_orderkey * l_orderkey END AS k FROM lineitem)
SELECT l_orderkey AS "L_ORDERKEY", l_linenumber AS "L_LINENUMBER", k AS "K", true AS balanced FROM l WHERE l_orderkey % 10 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, -k, true FROM l WHERE l_orderkey % 10 = 0
""")
def jdbc_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that write again after they were taken for lost, then a merge by keys; a column where one value has a third of the rows read in equal parts."""
    url = f"jdbc:derby:memory:millrace{uuid.uuid4().hex};create=true"
    key = F.when(F.col("l_orderkey") % 3 == 0, 7).otherwise(F.col("l_orderkey") * F.col("l_orderkey")).cast("long")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("L_ORDERKEY"), F.col("l_linenumber").cast("long").alias("L_LINENUMBER"), key.alias("K"))
    write = jdbc.StagedWrite(lines, url, "LINES")
    write.stage()
    write.stage()
    write.publish()
    write.drop()
    jdbc.write_jdbc_once(lines.where("L_ORDERKEY % 10 = 0").withColumn("K", -F.col("K")), url, "LINES", ["L_ORDERKEY", "L_LINENUMBER"])
    back = jdbc.read_jdbc_balanced(spark, url, "LINES", "K", 8, "L_ORDERKEY")
    sizes = [r[0] for r in back.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return back.withColumn("balanced", F.lit(max(sizes) <= 2 * -(-sum(sizes) // 8)))
