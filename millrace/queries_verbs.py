"""Registered queries of the frame verbs, of sources and sinks, and of the life of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Assignment, Catalog, Column, Entity, Group, Join, Operation, entity_of
from millrace.functions import cells
from millrace.operators import aggregates, evolve, joins, reshape, rows, tables, windows
from millrace.queries import _customers, _entity, _fresh, _gaps, _run, col, query, read
from millrace.session import materialize
from millrace.sources import discover, files, jdbc
from millrace.types import ORACLE_COLUMNS, promote


def refused(write) -> bool:
    """Whether a call raises an error, as it should."""
    try:
        write()
    except Exception:  # noqa: BLE001  any refusal counts
        return True
    return False


def with_answer(df: DataFrame, **answers: bool) -> DataFrame:
    return df.withColumns({n: F.lit(a) for n, a in answers.items()})


# --- rules of the query object ------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def catalog_empty_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty IN is false, an empty NOT IN true, and a value that is no list counts as empty."""
    o = lambda name: col("orders", name)
    either = Group("OR", [Operation(o("o_orderstatus"), "IN", []), Operation(o("o_orderstatus"), "IN", "F"), Operation(o("o_totalprice"), ">", 300000)])
    return _run(spark, sf_dir, Catalog([_entity("orders", "o_orderkey", "o_totalprice")], [], [either, Operation(o("o_orderkey"), "NOT IN", [])]))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey > l_linenumber * 1 AND l_partkey <= l_suppkey")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns compared with columns, and a BETWEEN without two ends refused."""
    c = lambda name: col("lineitem", name)
    refused_end = refused(lambda: Operation(c("l_tax"), "BETWEEN", [1]))
    where = [Operation(c("l_suppkey"), ">", c("l_linenumber")), Operation(c("l_partkey"), "<=", c("l_suppkey"))]
    return _run(spark, sf_dir, Catalog([_entity("lineitem", "l_orderkey", "l_linenumber")], [], where)).where(F.lit(refused_end))


# --- frame verbs --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.select(read(spark, sf_dir, "orders"), ["o_orderkey", 3])


@query("SELECT o_orderkey, round(o_totalprice / 2, 3) AS half, upper(o_orderstatus) AS status FROM orders")
def select_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.select_expr(read(spark, sf_dir, "orders"), F.col("o_orderkey"), half=F.round(F.col("o_totalprice") / 2, 3), status=F.upper("o_orderstatus"))


@query("SELECT s_suppkey, s_name, s_nationkey + 1 AS s_nationkey, s_acctbal, s_acctbal < 0 AS debt FROM supplier")
def with_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_columns(read(spark, sf_dir, "supplier"), s_nationkey=F.col("s_nationkey") + 1, debt=F.col("s_acctbal") < 0)


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_retailprice < 1500 AND p_brand IS NOT NULL")
def filter_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_rows(read(spark, sf_dir, "part"), F.col("p_size") > 10, F.col("p_retailprice") < 1500, F.col("p_brand").isNotNull()).select("p_partkey", "p_size")


@query("SELECT c_custkey AS id, c_name AS \"full name\", c_nationkey, c_mktsegment FROM customer")
def rename_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop(rows.rename(read(spark, sf_dir, "customer"), {"c_custkey": "id", "c_name": "full name"}), "c_acctbal", "absent")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS DECIMAL(12,1)) AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS INTEGER) END AS mixed FROM customer")
def cast_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.lit("n/a"))
    return rows.cast(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", mixed.alias("mixed")), {"c_custkey": "string", "c_acctbal": "decimal(12,1)", "mixed": "int"}, strict=False)


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def keep_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.keep_columns(read(spark, sf_dir, "lineitem"), ["l_tax", "l_orderkey", "l_linenumber", "no_such"])


@query("SELECT true AS same, false AS fewer, false AS renamed")
def equal_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of orders in two orders, without one, and under other names."""
    o = read(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    answers = (rows.frames_equal(o, o.orderBy("o_totalprice")), rows.frames_equal(o, o.where(F.col("o_orderkey") != last)), rows.frames_equal(o, o.withColumnRenamed("o_custkey", "k")))
    return spark.createDataFrame([answers], "same boolean, fewer boolean, renamed boolean")


_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS price FROM orders)"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("price"))


@query(f"SELECT * FROM {_HOLES} ORDER BY price DESC NULLS FIRST, o_orderkey LIMIT 500")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.limit(rows.sort(_holes(spark, sf_dir), ["price", "o_orderkey"], [True, False]), 500)


@query(f"SELECT * FROM {_HOLES} ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 300 OFFSET 20")
def sort_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.limit(rows.sort_by(_holes(spark, sf_dir), [("price", "descending"), ("o_orderkey", "ascending")]), 300, 20)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 70")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.head(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 70, ["o_custkey", "o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 70")
def reversed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.reverse(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).limit(70)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN -1 ELSE l_tax END AS l_tax FROM lineitem")
def nan_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))  # noqa: E741
    return reshape.fill_nan(l, -1.0)


@query("""
SELECT 'n' AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders
UNION ALL SELECT 'buyers', count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F'), count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O'), count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'P') FROM orders
""")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.transpose(aggregates.agg(read(spark, sf_dir, "orders"), ["o_orderstatus"], F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("buyers")), "o_orderstatus")


@query("SELECT c_custkey, count(*) AS n, true AS refused FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 1:m join that holds, and the 1:1 and m:1 of the same tables refused."""
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    no = all(refused(lambda v=v: joins.join(c, o, "c_custkey", "o_custkey", "inner", validate=v)) for v in ("1:1", "m:1"))
    return with_answer(joins.join(c, o, "c_custkey", "o_custkey", "inner", validate="1:m").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")), refused=no)


@query("SELECT o_orderstatus, count(*) AS n, true AS refused FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    counted = reshape.pipe(o, lambda df, low, by: df.where(F.col("o_totalprice") > low).groupBy(by).agg(F.count(F.lit(1)).alias("n")), 1000, by="o_orderstatus")
    return with_answer(counted, refused=refused(lambda: reshape.pipe(o, DataFrame.count)))


# --- windows over ranges, as large keys need them -------------------------------------------------------


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW)")
def rolling_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling(read(spark, sf_dir, "events"), "ts", "1h", {"n": ("count", None), "total": ("sum", "value")}).select("event_id", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, event_id, coalesce(lead(value, 3) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS value FROM events")
def shift_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shift(read(spark, sf_dir, "events").select("event_type", "event_id", "value"), -3, "event_id", 0.0, by=["event_type"], spread=True)


_TYPED = "(SELECT event_type, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_type, event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_TYPED}")
def backfill_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fill_forward(_typed(spark, sf_dir), ["value"], "event_id", ["event_type"], backward=True, spread=True)


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM {_TYPED}),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER p AS r0, last_value(value IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER f AS r1, first_value(value IGNORE NULLS) OVER f AS v1
  FROM n WINDOW p AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, event_id, round(CASE WHEN value IS NOT NULL THEN value ELSE v0 + (v1 - v0) * (r - r0) / (r1 - r0) END, 6) AS value FROM k
""")
def interp_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.interpolate(_typed(spark, sf_dir), ["value"], "event_id", ["event_type"], spread=True).withColumn("value", F.round("value", 6))


@query("SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN (SELECT round(avg(value), 6) FROM events WHERE event_id % 3 <> 0) ELSE round(value, 6) END AS value FROM events")
def fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.fill_null(_gaps(spark, sf_dir), strategy="mean", columns=["value"]).withColumn("value", F.round("value", 6))


# --- cells ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def nul_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.strip_nul(read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("\x00"), "c_name", F.lit("\x00\x00")).alias("c_name"), "c_mktsegment"))


@query("SELECT c_custkey, list_filter(['c_custkey', CASE WHEN c_custkey % 2 = 0 THEN 'c_name' END, 'c_acctbal'], lambda x: x IS NOT NULL) AS _set FROM customer")
def patch_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return cells.prepare_patch(c, ["c_acctbal"]).select("c_custkey", "_set")


@query("SELECT c_custkey AS \"CUST_KEY_2_ID\", c_name AS \"ORDER_COL\", c_acctbal AS \"ACCT_BAL\", c_mktsegment AS \"C_2_ND_SEGMENT\", c_nationkey AS \"DATE\" FROM customer")
def snake_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return cells.snake_columns(c.select(F.col("c_custkey").alias("custKey2Id"), F.col("c_name").alias("order"), F.col("c_acctbal").alias(" acct-bal! "), F.col("c_mktsegment").alias("2ndSegment"), F.col("c_nationkey").alias("date")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c_name is null' END AS _error FROM customer")
def not_null_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    ok, bad = cells.enforce_not_null(c, ["c_custkey", "c_name"])
    return ok.withColumn("_error", F.lit(None).cast("string")).unionByName(bad).select("c_custkey", "_error")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:30:45'")
def since_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts").where(windows.micros(F.col("ts")) >= F.unix_micros(cells.date_literal("2024-01-10T12:30:45.987Z")))


_PAIRS = [("int8", "int32"), ("uint8", "int32"), ("int64", "float32"), ("bool", "date32"), ("bool", "int16"), ("bool", "string"), ("decimal128", "float64"), ("date32", "timestamp_us"), ("string", "uuid"), ("binary", "large_binary"), ("int8", "string"), ("null", "binary")]


@query("""
SELECT a, b, wide, n FROM (VALUES ('int8', 'int32', 'int32'), ('uint8', 'int32', 'int64'), ('int64', 'float32', 'float64'), ('bool', 'date32', 'large_string'), ('bool', 'int16', 'int16'), ('bool', 'string', 'string'), ('decimal128', 'float64', 'decimal128'),
  ('date32', 'timestamp_us', 'timestamp_us'), ('string', 'uuid', 'string'), ('binary', 'large_binary', 'large_binary'), ('int8', 'string', 'large_string'), ('null', 'binary', 'binary')) t(a, b, wide) JOIN (SELECT o_orderkey % 12 AS k, count(*) AS n FROM orders GROUP BY 1)
  ON k = CASE a WHEN 'int8' THEN CASE b WHEN 'int32' THEN 0 ELSE 10 END WHEN 'uint8' THEN 1 WHEN 'int64' THEN 2 WHEN 'bool' THEN CASE b WHEN 'date32' THEN 3 WHEN 'int16' THEN 4 ELSE 5 END WHEN 'decimal128' THEN 6 WHEN 'date32' THEN 7 WHEN 'string' THEN 8 WHEN 'binary' THEN 9 ELSE 11 END
""")
def promoted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of type ids dealt to the orders by their keys, with the type that holds both."""
    pairs = spark.createDataFrame([(k, a, b, promote(a, b)) for k, (a, b) in enumerate(_PAIRS)], "k long, a string, b string, wide string")
    assert all(promote(a, b) in ORACLE_COLUMNS for a, b in _PAIRS)
    return read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 12).alias("k")).agg(F.count(F.lit(1)).alias("n")).join(pairs, "k").select("a", "b", "wide", "n")


@query("""
SELECT c_custkey AS k, CAST(c_custkey % 2 = 0 AS VARCHAR) AS v, CAST(c_custkey AS DOUBLE) AS n FROM customer UNION ALL SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_totalprice FROM orders
""")
def union_bool_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is a boolean here and a date there is text in the union."""
    from millrace.types import union_promoted

    one = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2 == 0).alias("v"), F.col("c_custkey").alias("n"))
    two = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("v"), F.col("o_totalprice").alias("n"))
    return union_promoted([one, two])


# --- sources and sinks ----------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_acctbal, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "csv")
    files.write_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), path)
    return files.read_csv(spark, path)


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def parquet_scan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "scan")
    files.write_parquet(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), path)
    return files.scan_parquet(spark, path, "place", ["o_totalprice", "o_orderkey"], transform=lambda df: df.where("place >= 0"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one schema under different names, by position; one of another schema is refused."""
    one, two = _fresh(spark, "many"), _fresh(spark, "many")
    files.write_csv(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), one)
    files.write_csv(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), two)
    frames = [files.read_csv(spark, one, "k long, name string"), files.read_csv(spark, two, "s_suppkey long, s_name string")]
    assert refused(lambda: files.read_many([frames[0], frames[1].select("s_name", "s_suppkey")]))
    return files.read_many(frames)


@query("""
SELECT o_orderkey, epoch_us(o_orderdate) AS ordered, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, o_orderstatus = 'F' AS done, '08:30:00.000' AS at, list_filter([CASE WHEN o_orderkey % 10 = 5 THEN 'price' END], lambda x: x IS NOT NULL) AS _bad FROM orders
""")
def bulk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as a bulk export writes it: times with Z, NUL characters, empty cells for null, and cells that don't fit."""
    path, k = _fresh(spark, "bulk"), F.col("o_orderkey")
    price = F.when(k % 10 == 5, F.lit("n/a")).when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.col("o_totalprice").cast("string"), F.lit("\x00")))
    page = read(spark, sf_dir, "orders").select(k.cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ordered"), price.alias("price"), F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("false").alias("done"), F.lit("08:30:00.000Z").alias("at"))
    page.write.option("header", True).option("emptyValue", "").csv(path)
    out = files.read_bulk_csv(spark, path, {"o_orderkey": "int", "ordered": "datetime", "price": "double", "done": "boolean", "at": "time"})
    return out.withColumn("ordered", F.unix_micros("ordered"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(NULL AS VARCHAR) AS note FROM orders GROUP BY 1")
def records_and_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result to Arrow and back, then as dicts that lack a key of the schema."""
    counts = aggregates.agg(read(spark, sf_dir, "orders"), ["o_orderpriority"], F.count(F.lit(1)).alias("n"))
    again = files.from_arrow(spark, files.to_arrow(counts))
    return files.from_records(spark, [r.asDict() for r in again.collect()], "o_orderpriority string, n long, note string")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def empty_and_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders behind an empty frame of their entity and a source that is not there."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    gone = files.read_or_empty(spark, lambda: spark.read.parquet(f"{_fresh(spark, 'none')}"), o.schema)
    return rows.concat(files.empty_like(spark, entity_of(o, "orders")), gone, files.read_or_empty(spark, lambda: o, o.schema))


@query("SELECT c_custkey, c_name, true AS refused, true AS dropped, false AS again FROM customer")
def data_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created once, refused the second time, replaced; and another one dropped, once."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    path, other = _fresh(spark, "data"), _fresh(spark, "data")
    files.create_data(c.where("c_custkey % 2 = 0"), path)
    no = refused(lambda: files.create_data(c, path))
    files.replace_data(c, path)
    files.create_data(c, other, "orc")
    dropped, again = files.drop_data(spark, other, other)
    return with_answer(files.read_parquet(spark, path), refused=no, dropped=dropped, again=again)


def _upload(spark: SparkSession, sf_dir: str) -> str:
    base = _fresh(spark, "upload")
    files.write_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), f"{base}/customer.csv")
    files.write_json(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), f"{base}/supplier.jsonl")
    files.write_parquet(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), f"{base}/orders.parquet")
    return base


@query("SELECT 'customer' AS entity, count(*) AS rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders")
def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.land(spark, _upload(spark, sf_dir), _fresh(spark, "landed")).select("entity", "rows")


@query("""
SELECT entity, "column", type, format, n FROM (VALUES ('customer', 'c_custkey', 'int32', 'csv'), ('customer', 'c_name', 'string', 'csv'), ('supplier', 's_name', 'string', 'json'), ('supplier', 's_suppkey', 'int64', 'json'),
  ('orders', 'o_orderkey', 'int64', 'parquet'), ('orders', 'o_orderdate', 'timestamp_us', 'parquet')) t(entity, "column", type, format)
JOIN (SELECT 'customer' AS e, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders) ON e = entity
""")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an upload of three formats, with the rows of each entity, in one snapshot beside a folder that is not there."""
    base = _upload(spark, sf_dir)
    found = discover.snapshot_metadata(spark, {"up": base, "gone": _fresh(spark, "gone")}).where("message IS NULL")
    counted = discover.land(spark, base, _fresh(spark, "landed")).select("entity", F.col("rows").alias("n"))
    return found.join(counted, "entity").select("entity", "column", "type", "format", "n")


def _database(spark: SparkSession) -> str:
    """A database in the memory of this JVM, as tests and single machines have it."""
    return f"jdbc:derby:memory:millrace{uuid.uuid4().hex};create=true"


@query("SELECT s_suppkey AS \"S_SUPPKEY\", s_name AS \"S_NAME\", s_acctbal AS \"S_ACCTBAL\" FROM supplier WHERE s_acctbal > 0")
def jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in batches, read back in ranges of the key; the filter is the database's work."""
    url = _database(spark)
    jdbc.write_jdbc(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_NAME"), F.col("s_acctbal").alias("S_ACCTBAL")), url, "SUPPLIER", "overwrite")
    return jdbc.read_jdbc(spark, url, table="SUPPLIER", partition_col="S_SUPPKEY", partitions=3).where("S_ACCTBAL > 0")


@query("SELECT s_nationkey AS \"NATION\", count(*) AS \"N\" FROM supplier GROUP BY 1")
def jdbc_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole query run by the database, then a statement with parameters over its rows."""
    url = _database(spark)
    jdbc.write_jdbc(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_nationkey").alias("S_NATIONKEY")), url, "SUPPLIER")
    counted = jdbc.read_jdbc(spark, url, query="SELECT S_NATIONKEY AS NATION, CAST(COUNT(*) AS BIGINT) AS N FROM SUPPLIER GROUP BY S_NATIONKEY")
    return jdbc.query(spark, "SELECT NATION, N FROM {t} WHERE N > :low", {"low": 0}, t=counted)


@query("SELECT \"column\", type, ordinal, (SELECT count(*) FROM supplier) AS n FROM (VALUES ('S_SUPPKEY', 'BIGINT', 1), ('S_NAME', 'CLOB', 2)) t(\"column\", type, ordinal)")
def jdbc_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _database(spark)
    jdbc.write_jdbc(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_NAME")), url, "SUPPLIER")
    found = jdbc.discover_jdbc(spark, url, tables=["supplier"]).select("column", "type", "ordinal")
    return found.crossJoin(jdbc.read_jdbc(spark, url, table="SUPPLIER").agg(F.count(F.lit(1)).alias("n")))


# --- writes and the life of tables ------------------------------------------------------------------------


@query("""
SELECT c_custkey, CASE WHEN c_custkey >= 5000000 THEN c_name WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey >= 5000000 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey >= 5000000 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 5000000, c_name, c_acctbal, c_mktsegment FROM customer) WHERE c_custkey % 4 <> 0 OR c_custkey >= 5000000
""")
def ingest_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update and delete with more columns than each may set; the others are left out."""
    c = _customers(spark, sf_dir)
    may = {"creatable": ["c_custkey", "c_name"], "updatable": ["c_name"], "key": "c_custkey"}
    new = tables.ingest(c, c.withColumn("c_custkey", F.col("c_custkey") + 5000000), "insert", **may)
    changed = tables.ingest(new, c.where("c_custkey % 3 = 0").withColumns({"c_name": F.concat("c_name", F.lit("!")), "c_acctbal": F.lit(-1.0)}), "update", **may)
    return tables.ingest(changed, c.where("c_custkey % 4 = 0"), "delete", **may)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT NULL, 'new ' || c_name, 0, NULL FROM customer WHERE c_custkey % 10 = 0")
def upsert_by_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the first unique column of the entity that is no primary key."""
    c = _customers(spark, sf_dir)
    catalog = Catalog([Entity("customer", [Column("customer", "c_custkey", primary_key=True, unique=True), Column("customer", "c_name", unique=True)])])
    known = c.where("c_custkey % 5 = 0").select("c_name", F.lit(0.0).alias("c_acctbal"))
    return tables.upsert_external(c, known.unionByName(known.join(c.where("c_custkey % 10 = 0").select("c_name"), "c_name").withColumn("c_name", F.concat(F.lit("new "), "c_name"))), catalog=catalog)


@query("SELECT o_orderkey, o_custkey, true AS refused FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the entity that the assignments name; two of them are refused."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    join, poor = Join(col("orders", "o_custkey"), col("customer", "c_custkey")), Operation(col("customer", "c_acctbal"), "<", 0)
    mark = Assignment(col("orders", "o_orderkey"), None)
    catalog = Catalog([_entity("orders"), _entity("customer", "c_custkey")], [join], [poor], assignments=[mark])
    two = Catalog(catalog.entities, [join], assignments=[mark, Assignment(col("customer", "c_name"), "x")])
    no = refused(lambda: tables.target_of(two))
    return with_answer(tables.delete_joined(catalog, {"orders": o, "customer": read(spark, sf_dir, "customer")}, ["o_orderkey"]), refused=no)


@query("SELECT c_custkey, 'all' AS part FROM customer UNION ALL SELECT c_custkey, 'live' FROM customer WHERE c_custkey % 4 <> 1")
def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(k == 1, True).when(k == 2, False).alias("is_deleted"))
    return tables.include_deleted(c, True).select("c_custkey", F.lit("all").alias("part")).union(tables.include_deleted(c, False).select("c_custkey", F.lit("live")))


@query("""
SELECT p_partkey AS part_id, p_partkey, CAST(p_size AS VARCHAR) AS p_size, 'none' AS p_note, 'worker' AS created_by, true AS kept_old, 2 AS n_dropped FROM part
""")
def table_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created from an entity with managed columns, filled, rebuilt under another schema, and dropped with what the rebuild kept."""
    name, p = f"millrace_{uuid.uuid4().hex}", read(spark, sf_dir, "part")
    evolve.create_table(spark, name, Entity("part", [Column("part", "p_partkey", type="int64"), Column("part", "p_size", type="int32"), Column("part", "p_odd")]))
    filled = p.select(F.col("p_partkey").alias("part_id"), "p_partkey", "p_size", *[F.lit(None).cast("timestamp") if a.endswith("_at") else F.lit("worker") for a in tables.AUDIT])
    filled.write.insertInto(name)
    wanted = T.StructType([T.StructField("part_id", T.LongType()), T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.StringType()), T.StructField("p_note", T.StringType()), T.StructField("created_by", T.StringType())])
    evolve.rebuild_table(spark, name, wanted, {"p_note": "none"})
    kept = materialize(spark.table(name), "life")
    old = spark.table(f"{name}_OLD").count() == kept.count()
    dropped = evolve.drop_tables(spark, [name, f"{name}_OLD", f"{name}_TMP"]).where("dropped").count()
    return kept.withColumns({"kept_old": F.lit(old), "n_dropped": F.lit(dropped)})


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, 0 AS p_rank, CAST(NULL AS DATE) AS p_since, true AS refused FROM part")
def column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added, recast, added or recast as need be, and dropped; managed ones and unconfirmed drops are refused."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.lit("x").alias("created_by"))
    no = refused(lambda: evolve.drop_column(p, "p_name")) and refused(lambda: evolve.drop_column(p, "created_by", confirm=True)) and refused(lambda: evolve.add_column(p, T.StructField("p_size", T.LongType())))
    p = evolve.add_column(p, T.StructField("p_rank", T.IntegerType(), False))
    p = evolve.modify_column(p, T.StructField("p_size", T.StringType()))
    p = evolve.upsert_column(evolve.upsert_column(p, T.StructField("p_since", T.DateType())), T.StructField("p_since", T.DateType()))
    return with_answer(evolve.drop_column(p, "p_name", confirm=True).drop("created_by"), refused=no)


@query("SELECT 'orders' AS entity, 'ok' AS status, count(*) AS rows, 207 AS code FROM orders UNION ALL SELECT 'lines', 'error', NULL, 207")
def migrate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, of which one repeats its keys: the other is migrated all the same."""
    sources = {"orders": read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "lines": read(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax"), "left_out": read(spark, sf_dir, "customer")}
    out = evolve.migrate(spark, sources, _fresh(spark, "migrate"), {"orders": ["o_orderkey"], "lines": ["l_orderkey"]}, ["ORDERS", "lines"])
    return out.select("entity", "status", "rows", F.lit(evolve.fan_out_status(out)).alias("code"))


@query("SELECT p_partkey, 'Part' || p_partkey AS name FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey <> 7")
def business_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as object descriptions: some can't be searched or laid out, some are histories, one is a system object."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Part"), k, F.when(k % 3 == 0, F.lit("History")).otherwise(F.lit("")))
    objects = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.lit(True).alias("queryable"), F.lit(True).alias("retrieveable"), (k % 4 == 1).alias("layoutable"), (k % 4 > 1).alias("searchable"))
    return evolve.migratable(objects, skip_names=["Part7"]).select("p_partkey", "name")
