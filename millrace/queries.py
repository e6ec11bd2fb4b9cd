"""Registered queries over the driver tables, each with the SQL that states its rows."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Assignment, Catalog, Column, Entity, Field, Group, Join, Operation, Sort, describe_schema
from millrace.functions import cells
from millrace.operators import aggregates, evolve, joins, mdm, reshape, rows, tables, windows
from millrace.plans.compile import to_dataframe
from millrace.session import shared_dir, ship
from millrace.sources import arrow_ipc, discover, files
from millrace.streaming import inbound
from millrace.types import union_promoted, widen_decimals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(entity: str, name: str, **more) -> Column:
    return Column(entity, name, **more)


def _entity(name: str, *columns: str) -> Entity:
    return Entity(name, [col(name, c) for c in columns])


def _run(spark: SparkSession, sf_dir: str, catalog: Catalog) -> DataFrame:
    """The query object after a round trip through its JSON, over the driver tables."""
    again = Catalog.from_json(catalog.to_json())
    return to_dataframe(again, {e.name: read(spark, sf_dir, e.name) for e in again.entities})


# --- the query object -------------------------------------------------------------------------------


@query("""
SELECT c_name, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_totalprice BETWEEN 50000 AND 200000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND (o_orderpriority LIKE '1-%' OR NOT (o_orderstatus = 'F'))
ORDER BY o_totalprice DESC, o_orderkey LIMIT 200
""")
def catalog_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        spark,
        sf_dir,
        Catalog(
            [_entity("customer", "c_name", "c_mktsegment"), _entity("orders", "o_orderkey", "o_totalprice")],
            [Join(col("customer", "c_custkey"), col("orders", "o_custkey"))],
            [
                Operation(col("orders", "o_totalprice"), "BETWEEN", [50000, 200000]),
                Operation(col("customer", "c_mktsegment"), "IN", ["BUILDING", "MACHINERY"]),
                Group("OR", [Operation(col("orders", "o_orderpriority"), "LIKE", "1-%"), Group("NOT", [Operation(col("orders", "o_orderstatus"), "=", "F")])]),
            ],
            [Sort(col("orders", "o_totalprice"), "DESC"), Sort(col("orders", "o_orderkey"))],
            limit=200,
        ),
    )


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_totalprice > 400000")
def catalog_left_isnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, Catalog([_entity("customer", "c_custkey", "c_name"), _entity("orders", "o_orderkey")], [Join(col("customer", "c_custkey"), col("orders", "o_custkey"), "LEFT")], [Group("OR", [Operation(col("orders", "o_orderkey"), "IS NULL"), Operation(col("orders", "o_totalprice"), ">", 400000)])]))


@query("""
SELECT n_nationkey, n_name, s_suppkey, s_acctbal FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey
WHERE NOT (s_acctbal > 5000 AND n_name LIKE 'NATION_1%') AND (n_nationkey < 20 OR s_acctbal IS NULL OR s_acctbal NOT BETWEEN 0 AND 1000) AND n_name != 'none'
""")
def catalog_outer_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = (lambda c: col("nation", c)), (lambda c: col("supplier", c))
    return _run(
        spark,
        sf_dir,
        Catalog(
            [_entity("nation", "n_nationkey", "n_name"), _entity("supplier", "s_suppkey", "s_acctbal")],
            [Join(n("n_nationkey"), s("s_nationkey"), "OUTER")],
            [
                Group("NOT", [Operation(s("s_acctbal"), ">", 5000), Operation(n("n_name"), "LIKE", "NATION_1%")]),
                Group("OR", [Operation(n("n_nationkey"), "<", 20), Operation(s("s_acctbal"), "IS NULL"), Operation(s("s_acctbal"), "NOT BETWEEN", [0, 1000])]),
                Operation(n("n_name"), "<>", "none"),
                Group("AND", []),
            ],
        ),
    )


@query("""
SELECT r_name, n_name, c_name, c_acctbal FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
WHERE c_acctbal >= 0 AND c_custkey > n_nationkey AND r_name NOT IN ('x') ORDER BY c_acctbal, c_name LIMIT 50 OFFSET 10
""")
def catalog_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        spark,
        sf_dir,
        Catalog(
            [_entity("region", "r_name"), _entity("nation", "n_name"), _entity("customer", "c_name", "c_acctbal")],
            [Join(col("nation", "n_nationkey"), col("customer", "c_nationkey")), Join(col("region", "r_regionkey"), col("nation", "n_regionkey"))],
            [Operation(col("customer", "c_acctbal"), ">=", 0), Operation(col("customer", "c_custkey"), ">", col("nation", "n_nationkey")), Operation(col("region", "r_name"), "NOT IN", ["x"]), Operation(col("region", "r_name"), "NOT IN", [])],
            [Sort(col("customer", "c_acctbal")), Sort(col("customer", "c_name"))],
            limit=50,
            offset=10,
        ),
    )


# --- joins -------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").where("o_totalprice > 100000"), "c_custkey", "o_custkey", "left semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(read(spark, sf_dir, "orders").where("o_totalprice > 400000"), read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "right anti")


@query("""
SELECT r_regionkey, r_name, o_orderstatus, n FROM region CROSS JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
""")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(read(spark, sf_dir, "region"), aggregates.agg(read(spark, sf_dir, "orders"), ["o_orderstatus"], F.count(F.lit(1)).alias("n")), how="cross")


@query("""
SELECT coalesce(c_custkey, k) AS c_custkey, c_name, count(o_orderkey) AS n_orders
FROM customer FULL JOIN (SELECT o_orderkey, o_custkey + 100 AS k FROM orders) ON c_custkey = k GROUP BY 1, 2
""")
def join_full_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("k"))
    return joins.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey", "k", "full outer", validate="1:m").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey AND p_retailprice < s_acctbal")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    return joins.join_where(p, s, p.p_retailprice < s.s_acctbal, equal=[("p_size", "s_nationkey")]).select("p_partkey", "s_suppkey")


_BUYS = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"
_VIEWS = "(SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)"


def _buys_and_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views


@query(f"SELECT b.event_id, b.user_id, b.ts, v.ts AS ts_right, v.view_id FROM {_BUYS} b ASOF LEFT JOIN {_VIEWS} v ON b.user_id = v.user_id AND b.ts >= v.ts")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_asof(*_buys_and_views(spark, sf_dir), "ts", "user_id")


@query(f"SELECT b.event_id, b.user_id, b.ts, v.ts AS ts_right, v.view_id FROM {_BUYS} b ASOF LEFT JOIN {_VIEWS} v ON b.user_id = v.user_id AND b.ts <= v.ts")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_asof(*_buys_and_views(spark, sf_dir), "ts", "user_id", "forward")


@query(f"""
SELECT event_id, user_id, ts, ts_right, view_id FROM (
  SELECT b.event_id, b.user_id, b.ts, v.ts AS ts_right, v.view_id, row_number() OVER (PARTITION BY b.event_id ORDER BY CASE WHEN v.ts IS NULL THEN 1 ELSE 0 END, abs(epoch_us(b.ts) - epoch_us(v.ts)), v.ts) AS k
  FROM {_BUYS} b LEFT JOIN {_VIEWS} v ON b.user_id = v.user_id AND abs(epoch_us(b.ts) - epoch_us(v.ts)) <= 172800000000) WHERE k = 1
""")
def asof_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_asof(*_buys_and_views(spark, sf_dir), "ts", "user_id", "nearest", "2 days")


# --- aggregates --------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit(datetime.datetime(1998, 9, 2)).cast("timestamp_ntz"))  # noqa: E741
    return aggregates.agg(l, ["l_returnflag", "l_linestatus"], F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""
SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(stddev_samp(l_quantity), 6) AS sd1, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
  count(l_tax) AS n_tax, count(*) AS n, count(DISTINCT l_linenumber) AS lines, bool_or(l_discount > 0.05) AS any_big, bool_and(l_discount >= 0) AS all_pos FROM lineitem GROUP BY 1
""")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").withColumns({"big": F.col("l_discount") > 0.05, "pos": F.col("l_discount") >= 0})  # noqa: E741
    out = aggregates.aggregate(l, [("l_quantity", "stddev", "sd"), ("l_quantity", "variance", "var"), ("l_quantity", "stddev_sample", "sd1"), ("l_shipdate", "min", "first_ship"), ("l_shipdate", "max", "last_ship"), ("l_tax", "count", "n_tax"), ("", "count_all", "n"), ("l_linenumber", "count_distinct", "lines"), ("big", "any", "any_big"), ("pos", "all", "all_pos")], "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in ("sd", "var", "sd1")})


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(read(spark, sf_dir, "orders"), [("o_totalprice", "first", "first_price"), ("o_totalprice", "last", "last_price")], "o_custkey", "o_orderkey")


@query("""
SELECT 'o_totalprice' AS "column", count(o_totalprice) AS "count", count(*) - count(o_totalprice) AS null_count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS "min",
  round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, max(o_totalprice) AS "max" FROM orders
""")
def describe_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.describe(read(spark, sf_dir, "orders"), ["o_totalprice"], interpolation="linear").withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("""
SELECT * FROM (SELECT 'value' AS "column", count(*) FILTER (WHERE event_id % 3 = 0) AS nulls, count(*) AS rows FROM events
UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL), count(*) FROM events UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type = 'error'), count(*) FROM events)
""")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumns({"value": F.when(F.col("event_id") % 3 != 0, F.col("value")), "event_type": F.when(F.col("event_type") != "error", F.col("event_type"))})
    return aggregates.null_profile(e, ["value", "user_id", "event_type"])


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_values(read(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(read(spark, sf_dir, "lineitem"), [("", "count_all", "n")])


# --- windows and time --------------------------------------------------------------------------------


@query("SELECT event_id, count(*) OVER w AS n_7d, round(sum(value) OVER w, 4) AS value_7d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '604799.999999 seconds' PRECEDING AND CURRENT ROW)")
def rolling_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.rolling(read(spark, sf_dir, "events"), "ts", "7d", {"n_7d": F.count(F.lit(1)), "value_7d": F.sum("value")}, by=["user_id"])
    return out.select("event_id", "n_7d", F.round("value_7d", 4).alias("value_7d"))


@query("SELECT event_type, date_trunc('day', ts) AS ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def dyn_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_by_dynamic(read(spark, sf_dir, "events"), "ts", "1d", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}, by=["event_type"])


@query("SELECT date_trunc('month', o_orderdate) AS o_orderdate, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def dyn_1mo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_by_dynamic(read(spark, sf_dir, "orders"), "o_orderdate", "1mo", {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)})


@query("""
SELECT w AS _lower_boundary, w + INTERVAL 1 DAY AS _upper_boundary, w + INTERVAL 1 DAY AS ts, count(*) AS n FROM (
  SELECT ts, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL 18 HOUR]) AS w FROM events) GROUP BY 1
""")
def dyn_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_by_dynamic(read(spark, sf_dir, "events"), "ts", "6h", {"n": F.count(F.lit(1))}, period="1d", label="right", include_boundaries=True)


@query("SELECT user_id, event_id, coalesce(lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS value FROM events")
def shift_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shift(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), 2, "event_id", -1.0, by=["user_id"])


_GAPS = "(SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {_GAPS}),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER p AS r0, last_value(value IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER f AS r1, first_value(value IGNORE NULLS) OVER f AS v1
  FROM n WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN value IS NOT NULL THEN value ELSE v0 + (v1 - v0) * (r - r0) / (r1 - r0) END, 6) AS value FROM k
""")
def interp_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.interpolate(_gaps(spark, sf_dir), ["value"], "event_id", ["user_id"]).withColumn("value", F.round("value", 6))


@query(f"SELECT user_id, event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS value FROM {_GAPS}")
def ffill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.fill_null(_gaps(spark, sf_dir), strategy="forward", columns=["value"], order_by="event_id", by=["user_id"], limit=1)


@query("SELECT event_id, user_id, n_failed, n_failed >= 3 AS locked FROM (SELECT event_id, user_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_failed FROM events)")
def fail_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.failure_threshold(read(spark, sf_dir, "events"), F.col("event_type") == "error", ["user_id"], "ts", 24 * 60, 3)
    return out.select("event_id", "user_id", "n_failed", "locked")


@query("SELECT event_id, ts FROM events WHERE event_type <> 'click' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'")
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") != "click").alias("is_active"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    return windows.active_at(e, datetime.datetime(2024, 1, 15)).select("event_id", "ts")


# --- order, positions, sets, reshape -----------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.top_k(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.bottom_k(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 100")
def slice_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.slice_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, 40, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 30")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.tail(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 30, "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 9 AS idx, o_orderkey FROM orders")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_row_index(read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "idx", 10).select("idx", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 3 AND (r - 3) % 7 = 0")
def nth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.gather_every(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 7, "o_orderkey", 3)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.unique(read(spark, sf_dir, "orders"), ["o_custkey"], "first", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def unique_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.unique(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "none")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.latest_per_key(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "event_id")


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.concat(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS amount, NULL AS brand FROM part UNION ALL SELECT p_partkey, p_retailprice, p_brand FROM part")
def union_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return union_promoted([p.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("amount")), p.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("amount"), F.col("p_brand").alias("brand"))])


@query("""
SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1
""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.pivot(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "sum")
    return out.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in out.columns if c != "o_orderpriority"])


@query("""
SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)
""")
def unpivot_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unpivot(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def explode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.split("text", " ").alias("word"))
    return reshape.explode(words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.col("props"), F.lit("]")).alias("p"))
    return reshape.explode_json(e, "p", "k long")


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS json FROM customer""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_json_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")))


@query("""
SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer)
JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS j FROM (SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderkey % (SELECT count(*) FROM customer))) ON i = j
""")
def hstack_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    some = o.crossJoin(c.agg(F.count(F.lit(1)).alias("n"))).groupBy((F.col("o_orderkey") % F.col("n")).alias("m")).agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return rows.hstack(c.select("c_acctbal", "c_custkey"), some, ["c_acctbal", "c_custkey"], "o_orderkey").drop("c_acctbal")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END, 0) AS c_acctbal, coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END, '?') AS c_name FROM customer")
def fill_null_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"))
    return reshape.fill_null(reshape.fill_null(c, 0), "?")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 0")
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.drop_nulls(read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal")), ["c_acctbal"])


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
def sql_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.sql_multi("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > :low GROUP BY 1", {"orders": read(spark, sf_dir, "orders"), "customer": read(spark, sf_dir, "customer")}, {"low": 1000})


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"


@query(_SETS.format("orders"))
def sql_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.sql(read(spark, sf_dir, "orders"), _SETS.format("frame"))


# --- cells, hashes, checks ---------------------------------------------------------------------------


@query("SELECT c_custkey, upper(md5(coalesce(nullif(c_name, ''), chr(0)) || chr(30) || CAST(c_nationkey AS VARCHAR) || chr(30) || CASE WHEN c_custkey % 2 = 0 THEN chr(0) ELSE c_mktsegment END)) AS hash FROM customer")
def row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", cells.row_hash(F.col("c_name"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment"))).alias("hash"))


@query("SELECT c_custkey, sha256(c_name) AS token, substr(md5(c_name), 1, 8) AS short_key, CAST(('0x' || substr(md5(c_name), 1, 7)) AS BIGINT) AS digits FROM customer")
def token_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", cells.sha256_hex(F.col("c_name")).alias("token"), cells.md5_key(F.col("c_name")).alias("short_key"), cells.md5_digits(F.col("c_name")).alias("digits"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(1000 + p_size AS DOUBLE) END AS amount, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE DATE '2024-02-03' END AS day, trim(p_name) AS label,
  list_filter([CASE WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 0 THEN 'amount' END, CASE WHEN p_partkey % 7 = 0 THEN 'day' END], lambda x: x IS NOT NULL) AS _bad FROM part
""")
def normalize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).when(F.col("p_partkey") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" 1,0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("\x00"))).alias("amount"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-02-03T10:00:00Z")).alias("day"),
        F.concat(F.lit(" "), F.col("p_name")).alias("label"),
    )
    return cells.normalize(p, {"amount": "NUMBER", "day": "DATE", "label": "TEXT"}).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 1 WHEN event_id % 4 = 2 THEN 0 END AS flag FROM events")
def bool_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    return read(spark, sf_dir, "events").select("event_id", cells.bool_flag(F.when(k == 0, F.lit("TRUE")).when(k == 1, F.lit("Y")).when(k == 2, F.lit("n")).otherwise(F.lit("maybe"))).alias("flag"))


@query("SELECT o_orderkey, CAST(floor((200 + o_orderkey % 305) / 100) * 100 AS INTEGER) AS class FROM orders")
def code_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", cells.code_class(F.lit(200) + F.col("o_orderkey") % 305).alias("class"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END, '') AS s_name, CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END AS positive FROM supplier")
def to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.to_text(read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("s_name"), (F.col("s_acctbal") > 0).alias("positive")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 NOT IN (SELECT o_orderkey % 10 FROM orders WHERE o_orderkey % 10 < 7)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 10).alias("k"))  # noqa: E741
    parents = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("p")).where("p < 7")
    return joins.orphans(l, parents, {"k": "p"}).drop("k")


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.duplicate_keys(read(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT p_partkey, p_name, concat_ws(', ', CASE WHEN length(p_name) > 8 THEN 'p_name is longer than 8' END, CASE WHEN p_retailprice >= 1000 THEN 'p_retailprice does not fit 5,2' END) AS _error FROM part WHERE length(p_name) > 8 OR p_retailprice >= 999.995")
def length_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.enforce_lengths(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), {"p_name": 8, "p_retailprice": (5, 2)})[1].drop("p_retailprice")


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(38, 2)) AS c_acctbal FROM customer")
def widen_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen_decimals(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal")))


@query("SELECT * FROM (VALUES ('n_nationkey', 'int32', true, 0), ('n_name', 'string', true, 1), ('n_regionkey', 'int32', true, 2)) t(\"column\", type, nullable, ordinal)")
def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_schema(read(spark, sf_dir, "nation")).select("column", "type", "nullable", "ordinal")


# --- table writes and schema changes -----------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    changes = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 10).alias("bal"))
    return tables.update(c, [Operation(col("customer", "c_custkey"), "=", Field("id")), Operation(col("customer", "c_mktsegment"), "!=", "BUILDING")], [Assignment(col("customer", "c_acctbal"), Field("bal"))], changes)


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.update(_customers(spark, sf_dir), [Operation(col("customer", "c_acctbal"), "<", 0)], [Assignment(col("customer", "c_mktsegment"), "DEBT")])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, 'new ' || c_name, NULL, NULL FROM customer WHERE c_custkey % 8 = 0
""")
def upsert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    some = c.where("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(1).alias("seq"))
    extra = some.where("c_custkey % 8 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    older = some.withColumns({"c_name": F.lit("old"), "seq": F.lit(0)})
    return tables.upsert(c, some.unionByName(extra).unionByName(older), "c_custkey", "seq")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 6 <> 0")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return tables.delete_matching(c, c.where("c_custkey % 6 = 0").select("c_custkey", "c_mktsegment"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE NOT (c_acctbal < 0)")
def delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.delete(_customers(spark, sf_dir), [Operation(col("customer", "c_acctbal"), "<", 0)])


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 5000000, c_name, 0, NULL FROM customer")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    new = c.select((F.col("c_custkey") + 5000000).alias("id"), "c_name")
    return tables.insert(c, new, [Assignment(col("customer", "c_custkey"), Field("id")), Assignment(col("customer", "c_name"), Field("c_name")), Assignment(col("customer", "c_acctbal"), 0)])


@query("SELECT s_suppkey, s_name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_suppkey) AS supplier_id FROM supplier")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return tables.assign_ids(s, "supplier_id", tables.next_id(s, "s_suppkey"), "s_suppkey")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def changed_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.changed_between(read(spark, sf_dir, "events"), "ts", datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 12)).select("event_id", "ts")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS active, ' ' AS note, CAST(NULL AS DATE) AS since FROM part")
def align_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.lit("Y")).otherwise(F.lit("false")).alias("active"))
    wanted = T.StructType([T.StructField("p_partkey", T.StringType()), T.StructField("p_size", T.DoubleType()), T.StructField("active", T.IntegerType()), T.StructField("note", T.StringType(), False), T.StructField("since", T.DateType())])
    return evolve.align(p, wanted)


@query("SELECT * FROM (VALUES ('p_partkey', 'none', 'bigint'), ('p_size', 'modify', 'bigint'), ('p_name', 'rebuild', 'int'), ('p_note', 'add', 'string')) t(\"column\", action, type)")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.LongType()), T.StructField("p_name", T.IntegerType()), T.StructField("p_note", T.StringType())])
    return evolve.diff_schema(spark, read(spark, sf_dir, "part").schema, wanted)


# --- sources, sinks and streams: what comes back must be what went in -------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = _fresh(spark, "csv"), read(spark, sf_dir, "customer")
    files.write_csv(c.select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.lit("NA")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")), path)
    return files.scan_csv(spark, path, null_values={"c_mktsegment": "NA"}, schema="c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "json")
    files.write_json(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_json(spark, path, schema="o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = _fresh(spark, "arrow")
    arrow_ipc.write_arrow(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return arrow_ipc.read_arrow(spark, path)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def dataset_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "dataset")
    files.write_dataset(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"], max_rows_per_file=50_000)
    return files.read_dataset(spark, path, columns=["o_orderkey", "o_totalprice", "o_orderstatus"], where="o_orderstatus IN ('F', 'P')")


@query("SELECT o_orderkey, o_custkey, true AS fits FROM orders")
def chunked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the chunks hold them, each with whether its file keeps the bound."""
    path = _fresh(spark, "chunks")
    sizes = files.export_chunks(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, 5000)
    back = spark.read.option("header", True).schema("o_orderkey long, o_custkey long").csv(path).select("*", F.col("_metadata.file_name").alias("file"))
    return back.join(sizes, "file").select("o_orderkey", "o_custkey", (F.col("rows") <= 5000).alias("fits"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, path = "0123456789abcdef0123456789abcdef", _fresh(spark, "encrypted")
    files.write_parquet(files.encrypt_columns(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_name", "c_acctbal"], key), path)
    return files.decrypt_columns(files.read_parquet(spark, path), {"c_name": "string", "c_acctbal": "double"}, key)


@query("SELECT entity, \"column\", type FROM (VALUES ('nation', 'n_nationkey', 'int32'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'int32')) t(entity, \"column\", type)")
def discover_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("nation",), ("absent",)], "entity string")
    return discover.discover(spark, sf_dir, wanted).select("entity", "column", "type")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '!' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier
""")
def migrate_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, s = _fresh(spark, "migrate"), read(spark, sf_dir, "supplier")
    evolve.migrate(spark, {"supplier": s.select("s_suppkey", "s_name")}, base, {"supplier": ["s_suppkey"]})
    evolve.migrate(spark, {"supplier": s.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat("s_name", F.lit("!")).alias("s_name"), "s_acctbal")}, base, {"supplier": ["s_suppkey"]})
    return evolve.latest_version(spark, f"{base}/SUPPLIER")[0].select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day windows of the events as a stream, run to its end; each micro-batch replaces the result."""
    out, kind = _fresh(spark, "stream"), read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = inbound.windowed(stream, "ts", "1 day", {"n": F.count(F.lit(1))}, by=["event_type"])
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/rows"))
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT c_custkey AS mq_id, 'e' || c_custkey AS employee_id, CAST(CASE WHEN c_custkey % 5 = 0 THEN 500 ELSE 202 END AS INTEGER) AS mq_status FROM customer WHERE c_custkey % 7 <> 0")
def stream_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of customers arrive as files of some hundred each and are loaded once; those without an employee are rejects."""
    base = _fresh(spark, "inbound")
    k = F.col("c_custkey")
    message = F.struct(k.alias("mq_id"), F.when(k % 7 != 0, F.concat(F.lit("e"), k)).alias("employee_id"), F.when(k % 5 == 0, F.lit(500)).alias("mq_status"))
    payloads = read(spark, sf_dir, "customer").groupBy(F.floor(k / 200).alias("part")).agg(F.to_json(F.collect_list(message)).alias("value"))
    payloads.select("value").repartition(5, "value").write.option("maxRecordsPerFile", 1).text(f"{base}/in")

    def handle(batch: DataFrame, number: int) -> None:
        mdm.load_json(batch)[0].write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    inbound.process(inbound.inbound_files(spark, f"{base}/in", 40), handle, f"{base}/state", f"{base}/ledger", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("mq_id", "employee_id", "mq_status")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' too long' ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 5 = 0 THEN 'c_key is null' WHEN c_custkey % 2 = 0 THEN 'c_name is longer than 18' END AS _error FROM customer
""")
def write_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written, and what was not with the reason, side by side."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("c_key"))
    source = c.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" too long"))).otherwise(F.col("c_name")))
    good, bad = tables.write_with_rejects(c.limit(0), source, ["c_custkey"], ["c_key"], {"c_name": 18})
    return good.withColumn("_error", F.lit(None).cast("string")).unionByName(bad).drop("c_key")


# --- samples and Python values -------------------------------------------------------------------------


@query('SELECT least(100, count(*)) AS n, least(100, count(*)) AS known FROM orders')
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a sample has is Spark's affair: how many they are, and how many orders they are."""
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    some = rows.sample(o, n=100, seed=7)
    return some.join(o, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("known"))


@query("SELECT c_custkey, reverse(c_name) AS c_name FROM customer")
def python_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return read(spark, sf_dir, "customer").select("c_custkey", reshape.map_values(F.col("c_name"), lambda name: name[::-1], "string").alias("c_name"))
