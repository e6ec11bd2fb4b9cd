"""Frame operators on hand-made rows: ties, nulls, duplicates and empties."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import queries as core
from millrace import queries_verbs  # noqa: F401  it registers its queries in core
from millrace.operators import aggregates, joins, reshape, rows, scans, windows
from millrace.types import CRM_FIELDS, CRM_TYPES, EXCLUDED_CRM_TYPES, ORACLE_COLUMNS, ORACLE_TYPES, oracle_column, outside_type, promote, spark_type, type_id, union_promoted

SF = "/root/testdata/sf0.001"


def D(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_row_index_and_positions(spark):
    df = spark.range(100).repartition(5).select((F.lit(99) - F.col("id")).alias("k"))
    assert [(r["i"], r["k"]) for r in rows.with_row_index(df, "k", "i", 5).orderBy("i").collect()] == [(k + 5, k) for k in range(100)]
    assert {r.k for r in rows.gather_every(df, 30, "k", 2).collect()} == {2, 32, 62, 92}
    assert [r.k for r in rows.tail(df, 2, "k").collect()] == [98, 99]
    assert rows.with_row_index(df.limit(0), "k").count() == 0
    assert rows.sample(df, n=7, seed=1).count() == 7 and rows.sample(df, n=150, replace=True, seed=1).count() == 150
    assert [r.k for r in rows.reverse(df, "k").limit(2).collect()] == [99, 98]
    with pytest.raises(ValueError):
        rows.hstack(df, df.limit(3).toDF("j"), "k", "j")


def test_sort_null_order(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    assert [r.v for r in rows.sort(df, "v").collect()] == [None, 1, 2]
    assert [r.v for r in rows.sort(df, "v", True).collect()] == [None, 2, 1]
    assert [r.v for r in rows.sort_by(df, [("v", "descending")]).collect()] == [2, 1, None]
    assert [r.v for r in rows.top_k(df, 2, "v").collect()] == [2, 1]


def test_joins_kinds_suffixes_and_nulls(spark):
    a = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4)], "k int, v int")
    b = spark.createDataFrame([(None, 10), (1, 20), (3, 30)], "k int, v int")
    got = lambda how, **k: sorted(map(tuple, joins.join(a, b, "k", how=how, **k).collect()), key=repr)
    assert got("inner") == [(1, 2, 20), (1, 3, 20)]
    assert got("full outer") == sorted([(1, 2, 20), (1, 3, 20), (2, 4, None), (3, None, 30), (None, 1, None), (None, None, 10)], key=repr)
    assert got("right") == sorted([(1, 2, 20), (1, 3, 20), (3, None, 30), (None, None, 10)], key=repr)
    assert got("left anti") == sorted([(2, 4), (None, 1)], key=repr) and got("right semi") == [(1, 20)]
    assert joins.join(a, b, "k", suffixes=("_l", "_r")).columns == ["k", "v_l", "v_r"]
    assert joins.join(a, b, "k", coalesce_keys=False, how="inner").columns == ["k", "v", "k_right", "v_right"]
    with pytest.raises(ValueError):
        joins.join(a, b, "k", validate="1:1")
    assert joins.join(a, b, "k", how="left", validate="m:1").count() == 4


def test_asof_ties_gaps_and_tolerance(spark):
    left = spark.createDataFrame([(1, D(1, 6)), (2, D(1, 12)), (3, D(5)), (4, None)], "id int, t timestamp_ntz")
    right = spark.createDataFrame([(D(1, 6), "a"), (D(1, 6), "b"), (D(1, 18), "c"), (None, "n")], "t timestamp_ntz, x string")
    got = lambda *a, **k: {r.id: r.x for r in joins.join_asof(left, right, "t", *a, **k).collect()}
    assert got() == {1: "b", 2: "b", 3: "c", 4: None}
    assert got(strategy="forward") == {1: "b", 2: "c", 3: None, 4: None}
    assert got(strategy="nearest") == {1: "b", 2: "b", 3: "c", 4: None}
    assert got(strategy="nearest", tolerance="1 day") == {1: "b", 2: "b", 3: None, 4: None}
    numbers = joins.join_asof(spark.createDataFrame([(5, "g"), (9, None)], "n int, g string"), spark.createDataFrame([(3, "g", 1), (8, None, 2)], "n int, g string, w int"), "n", "g", tolerance=2)
    assert {(r.n, r.g, r.n_right, r.w) for r in numbers.collect()} == {(5, "g", 3, 1), (9, None, None, None)}


def test_aggregates_by_name(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 3, False), ("a", None, None), ("b", 5, True)], "g string, v int, f boolean")
    out = {r.g: r for r in aggregates.aggregate(df, [("v", "sum"), ("v", "min_max", "mm"), ("f", "any"), ("f", "all", "every"), ("v", "product"), ("v", "distinct"), ("v", "approximate_median", "med")], "g").collect()}
    assert (out["a"].v_sum, out["a"].mm.max, out["a"].f_any, out["a"].every, out["a"].v_product, sorted(out["a"].v_distinct)) == (4, 3, True, False, 3.0, [1, 3])
    with pytest.raises(ValueError):
        aggregates.aggregate(df, [("v", "first")], "g")
    with pytest.raises(ValueError):
        aggregates.aggregate(df, [("v", "mode")], "g")
    assert {r["column"]: r.nulls for r in aggregates.verify_nullable(df, ["g", "v", "f"]).collect()} == {"v": 1, "f": 1}


@pytest.mark.parametrize(("way", "wanted"), [("lower", 1.0), ("higher", 2.0), ("midpoint", 1.5), ("linear", 1.75), ("nearest", 2.0)])
def test_describe_interpolation(spark, way, wanted):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "v double")
    row = aggregates.describe(df, ["v"], (0.25,), way).first()
    assert (row["p25"], row["count"], row["null_count"], row["max"]) == (wanted, 4, 1, 8.0)
    assert aggregates.describe(df.limit(0), ["v"]).first()["p50"] is None


@pytest.mark.parametrize(("closed", "wanted"), [("right", [1, 1, 1]), ("left", [0, 1, 1]), ("both", [1, 2, 2]), ("none", [0, 0, 0])])
def test_rolling_ends(spark, closed, wanted):
    df = spark.createDataFrame([(D(1), 1), (D(2), 2), (D(3), 3)], "t timestamp_ntz, v int")
    out = windows.rolling(df, "t", "1d", {"n": F.count(F.lit(1))}, closed=closed).orderBy("t")
    assert [r.n for r in out.collect()] == wanted
    numbers = windows.rolling(df.select("v"), "v", 2, {"s": F.sum("v")}, closed="right").orderBy("v")
    assert [r.s for r in numbers.collect()] == [1, 3, 5]


def test_calendar_windows(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 31),), (datetime.datetime(2024, 2, 29, 23),), (datetime.datetime(2024, 3, 1),)], "t timestamp_ntz")
    month = windows.group_by_dynamic(df, "t", "1mo", {"n": F.count(F.lit(1))}, include_boundaries=True).orderBy("t").collect()
    assert [(r.t.month, r.n, r._upper_boundary.month) for r in month] == [(1, 1, 2), (2, 1, 3), (3, 1, 4)]
    right = windows.group_by_dynamic(df, "t", "1mo", {"n": F.count(F.lit(1))}, closed="right").orderBy("t").collect()
    assert [(r.t.month, r.n) for r in right] == [(1, 1), (2, 2)]
    two = windows.group_by_dynamic(df, "t", "1mo", {"n": F.count(F.lit(1))}, period="2mo").orderBy("t").collect()
    assert [(r.t.year, r.t.month, r.n) for r in two] == [(2023, 12, 1), (2024, 1, 2), (2024, 2, 2), (2024, 3, 1)]
    week = windows.group_by_dynamic(df, "t", "1w", {"n": F.count(F.lit(1))}).orderBy("t").collect()
    assert [(r.t.date(), r.n) for r in week] == [(datetime.date(2024, 1, 29), 1), (datetime.date(2024, 2, 26), 2)]
    point = windows.group_by_dynamic(df, "t", "1d", {"n": F.count(F.lit(1))}, start_by="datapoint", label="datapoint").orderBy("t").collect()
    assert [r.n for r in point] == [1, 1, 1]
    with pytest.raises(ValueError):
        windows.duration("3 parsecs")


def test_fills(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)], "k int, v double")
    got = lambda d: [r.v for r in d.orderBy("k").collect()]
    assert got(reshape.fill_null(df, strategy="forward", columns=["v"], order_by="k")) == [None, 1, 1, 1, 4, 4]
    assert got(reshape.fill_null(df, strategy="forward", columns=["v"], order_by="k", limit=1)) == [None, 1, 1, None, 4, 4]
    assert got(reshape.fill_null(df, strategy="backward", columns=["v"], order_by="k")) == [1, 1, 4, 4, 4, None]
    assert got(reshape.fill_null(df, strategy="mean", columns=["v"])) == [2.5, 1, 2.5, 2.5, 4, 2.5]
    assert got(reshape.fill_null(df, strategy="one", columns=["v"])) == [1, 1, 1, 1, 4, 1]
    assert got(windows.interpolate(df, ["v"], "k")) == [None, 1, 2, 3, 4, None]
    assert got(windows.shift(df, -1, "k", 9.0)) == [1, None, None, 4, None, 9]
    assert got(reshape.fill_nan(df.withColumn("v", F.when(F.col("k") == 2, F.lit(float("nan"))).otherwise(F.col("v"))), 7.0))[1] == 7


def test_reshape(spark):
    df = spark.createDataFrame([("x", "a", "p", 1), ("x", "b", "p", 2), ("y", "a", "q", 3)], "i string, on1 string, on2 string, v int")
    wide = reshape.pivot(df, ["on1", "on2"], "i", "v", "sum")
    assert wide.columns == ["i", "a_p", "a_q", "b_p"] and {tuple(r) for r in wide.collect()} == {("x", 1, None, 2), ("y", None, 3, None)}
    long = reshape.unpivot(spark.createDataFrame([(1, 2, None)], "k int, a int, b double"), None, "k")
    assert [tuple(r) for r in long.collect()] == [(1, "a", 2.0), (1, "b", None)]
    lists = spark.createDataFrame([(1, [1, 2], ["x"]), (2, None, None), (3, [], [])], "k int, a array<int>, b array<string>")
    assert sorted(map(tuple, reshape.explode(lists, "a", "b").collect()), key=repr) == [(1, 1, "x"), (1, 2, None), (2, None, None), (3, None, None)]
    assert reshape.transpose(spark.createDataFrame([("r", 1, 2)], "n string, a int, b int"), "n").columns[1] == "r"
    with pytest.raises(TypeError):
        reshape.pipe(df, lambda d: 3)


def test_unique_and_equality(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4), (None, 5)], "k int, v int")
    got = lambda **k: sorted([tuple(r) for r in rows.unique(df, ["k"], **k).collect()], key=repr)
    assert got(keep="first", order_by="v") == [(1, 1), (2, 3), (None, 4)] and got(keep="last", order_by="v") == [(1, 2), (2, 3), (None, 5)]
    assert got(keep="none") == [(2, 3)]
    with pytest.raises(ValueError):
        rows.unique(df, ["k"], "first")
    assert rows.frames_equal(df, df.orderBy("v")) and not rows.frames_equal(df, df.limit(2)) and not rows.frames_equal(df, df.toDF("k", "w"))
    with pytest.raises(ValueError):
        rows.concat(df, df.withColumn("v", F.col("v").cast("string")))
    assert rows.cast(spark.createDataFrame([("x",)], "v string"), {"v": "int"}, strict=False).first()[0] is None


def test_promotion():
    ids = list(ORACLE_COLUMNS)
    for a in ids:
        for b in ids:
            assert promote(a, b) == promote(b, a), (a, b)
        assert promote(a, a) == a and promote("null", a) == a
    fixed = {("int8", "int32"): "int32", ("uint8", "int8"): "int16", ("uint32", "int8"): "int64", ("int64", "float32"): "float64", ("float32", "float64"): "float64", ("decimal128", "int32"): "decimal128", ("bool", "int8"): "int8", ("timestamp_us", "timestamp_ns"): "timestamp_ns", ("binary", "large_binary"): "large_binary", ("date32", "int8"): "large_string", ("string", "large_string"): "large_string"}
    fixed |= {("uint8", "int32"): "int64", ("int64", "uint64"): "int64", ("decimal256", "decimal128"): "decimal128", ("decimal128", "bool"): "decimal128", ("date64", "timestamp_s"): "timestamp_s", ("date32", "date64"): "date64"}
    fixed |= {("string", "uuid"): "string", ("string", "json"): "json", ("utf8", "string_view"): "utf8", ("dictionary", "uuid"): "dictionary", ("bool", "json"): "json", ("bool", "float64"): "float64"}
    fixed |= {("bool", x): "large_string" for x in ("date32", "timestamp_us", "binary", "list", "time64_us")} | {("int8", "string"): "large_string", ("time32_s", "time64_us"): "large_string", ("list", "large_list"): "large_string", ("binary", "string"): "large_string"}
    for (a, b), wanted in fixed.items():
        assert promote(a, b) == wanted
    for name in ("bool", "int8", "int64", "float64", "string", "binary", "date32", "decimal128"):
        assert type_id(spark_type(name)) == name
    assert spark_type("list", meta={"element": "int8"}) == T.ArrayType(T.ByteType()) and spark_type("decimal256") == T.DecimalType(38, 18)


def test_union_promoted(spark):
    a, b = spark.createDataFrame([(1, True)], "x int, y boolean"), spark.createDataFrame([(2.5, "s")], "x double, z string")
    out = union_promoted([a, b])
    assert out.dtypes == [("x", "double"), ("y", "boolean"), ("z", "string")] and {tuple(r) for r in out.collect()} == {(1.0, True, None), (2.5, None, "s")}


def test_row_index_plan_has_no_single_partition(spark):
    df = rows.with_row_index(spark.range(50), "id", "i")
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_carry_spreads_any_key(spark):
    rnd = __import__("random").Random(3)
    data = [(k, t, rnd.choice([None, rnd.randint(0, 99)])) for k in ("hot", "hot", "hot", "b", None) for t in rnd.sample(range(1000), 60)]
    data = list({(k, t): (k, t, v) for k, t, v in data}.values())
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(3)
    for onward in (True, False):
        got = {(r.k, r.t): r.c for r in rows.carry(df, ["k"], [F.col("t")], {"c": F.col("v")}, onward).collect()}
        for k in ("hot", "b", None):
            last = None
            for kk, t, v in sorted((x for x in data if x[0] == k), key=lambda x: x[1], reverse=not onward):
                last = v if v is not None else last
                assert got[kk, t] == last
    one = {r.t: r.c for r in rows.carry(df.where("k = 'hot'"), [], [F.col("t")], {"c": F.col("v")}).collect()}
    assert one == {r.t: r.c for r in rows.carry(df.where("k = 'hot'"), ["k"], [F.col("t")], {"c": F.col("v")}).collect()}


def test_spread_asof_equals_plain(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    for strategy in ("backward", "forward", "nearest"):
        a, b = (joins.join_asof(left, right, "ts", "user_id", strategy, spread=s) for s in (False, True))
        assert rows.frames_equal(a, b)
    first = right.agg(F.min("ts")).first()[0]
    out = joins.join_asof(left, right.drop("user_id"), "ts")
    assert out.count() == left.count() and {r.view is None for r in out.where(F.col("ts") < F.lit(first)).collect()} <= {True} and out.where(F.col("ts") >= F.lit(first)).where("view is null").isEmpty()


def test_outside_types():
    assert outside_type("VARCHAR2(80)", ORACLE_TYPES) == "string" and outside_type("Text", CRM_TYPES) is None and outside_type("Currency", CRM_TYPES) == "decimal128"
    assert all(outside_type(t, CRM_TYPES) is None for t in EXCLUDED_CRM_TYPES)
    for known in (ORACLE_TYPES, CRM_TYPES):
        for t in known.values():
            assert spark_type(t) is not None and ORACLE_COLUMNS[t] and CRM_FIELDS[t]
    assert [oracle_column("string", 120), oracle_column("utf8", 10000), oracle_column("string"), oracle_column("decimal128", precision=10, scale=2), oracle_column("timestamp_us", timezone="UTC"), oracle_column("bool")] == ["VARCHAR2(120 CHAR)", "CLOB", "VARCHAR2(4000 CHAR)", "NUMBER(10, 2)", "TIMESTAMP WITH TIME ZONE", "NUMBER(1, 0)"]


def test_windows_over_ranges_equal_those_over_keys(spark, parted):
    rows_ = [(k % 3 if k % 11 else None, None if k % 17 == 0 else (k * 37) % 101, k, float(k % 7) if k % 4 else None) for k in range(160)]
    df = spark.createDataFrame(rows_, "g int, t long, i long, v double")

    def same(make, key="i"):
        a, b = ({r[key]: tuple(r) for r in make(s).collect()} for s in (False, True))
        assert a == b and len(a) == len(rows_)

    for closed in ("left", "right", "both", "none"):
        for offset in (None, -5, 3):
            same(lambda s, closed=closed, offset=offset: windows.rolling(df, "t", 10, {"n": F.count(F.lit(1)), "m": F.max("v")}, offset, closed, ["g"], spread=s))
            scanned = {"n": ("count", None), "c": ("count", "v"), "s": ("sum", "v"), "m": ("mean", "v"), "low": ("min", "i"), "v": ("max", "v")}
            same(lambda s, closed=closed, offset=offset: windows.rolling(df, "t", 10, scanned, offset, closed, ["g"], spread=s))
    for n in (1, -2):
        same(lambda s, n=n: windows.shift(df, n, "i", -1, ["v"], ["g"], spread=s))
    for limit in (None, 1):
        for backward in (False, True):
            same(lambda s, limit=limit, backward=backward: windows.fill_forward(df, ["v"], "i", ["g"], limit, backward, spread=s))
    same(lambda s: windows.interpolate(df, ["v"], "i", ["g"], spread=s))


@pytest.fixture
def parted(spark):
    """Small inputs keep their parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dense_period_is_dealt_over_tasks(spark, parted):
    """One key with all rows in one period, many at one moment: equal to a direct count, and no part holds half of the stream."""
    n = 4000
    values = [(k // 2 if k < 3000 else 5000 + k % 3, (k * 7919) % 1000 - 500) for k in range(n)]
    df = spark.createDataFrame(values, "t long, v int")
    stages = []
    kept = scans.materialize
    scans.materialize = lambda frame, name: stages.append(kept(frame, name)) or stages[-1]
    try:
        out = windows.rolling(df, "t", 100_000, {"n": ("count", None), "s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")})
        got = {(r.t, r.n, r.s, r.low, r.high) for r in out.collect()}
    finally:
        scans.materialize = kept
    wanted = set()
    for t in {t for t, _ in values}:
        seen = [v for u, v in values if u <= t]
        wanted.add((t, len(seen), sum(seen), min(seen), max(seen)))
    assert got == wanted and out.count() == n
    sizes = [r["count"] for r in stages[0].groupBy("_part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_scanned_windows_odd_cases(spark, parted):
    df = spark.createDataFrame([(None, None, None), (None, None, 2), (1, None, 3), (1, 7, None)], "g int, t int, v int").withColumn("v", F.col("v").cast("decimal(10,2)"))
    pairs = {"n": ("count", None), "s": ("sum", "v"), "m": ("mean", "v")}
    made = [windows.rolling(df, "t", 5, pairs, by=["g"], spread=s) for s in (False, True)]
    assert made[0].dtypes == made[1].dtypes and rows.frames_equal(*[m.sort("t") for m in made])
    none = windows.rolling(df, "t", 1, pairs, closed="none", spread=True)
    assert {(r.n, r.s) for r in none.collect()} == {(0, None)}
    assert windows.rolling(df.limit(0), "t", 5, pairs, spread=True).count() == 0
    with pytest.raises(ValueError):
        windows.rolling(df, "t", 5, {"x": ("mode", "v")})


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left semi", "left anti"])
def test_heavy_keys_of_a_conditional_join_are_cut(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "CUT", 10)
    a = spark.createDataFrame([(i, None if i % 9 == 0 else 1 if i % 3 else i % 4 + 2) for i in range(120)], "i int, g int")
    b = spark.createDataFrame([(j, None if j % 8 == 0 else 1 if j % 2 else j % 6 + 2) for j in range(70)], "j int, h int")
    got = joins.join_where(a, b, a.i < b.j, how=how, equal=[("g", "h")])
    want = a.join(b, [a.g == b.h, a.i < b.j], how.replace(" ", "_"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    if how == "inner":
        sizes = sorted(r["count"] for r in got.where("g = 1").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) > 2 and sizes[-1] < sum(sizes) / 2
    assert joins.join_where(a.limit(0), b, a.i < b.j, how="inner", equal=[("g", "h")]).count() == 0


def test_windows_without_keys_are_scanned(spark):
    """A frame of Spark's would add every row of a window up anew for each row, the square of the rows of an hour."""
    out = core.QUERIES["rolling_all"](spark, SF)
    assert "RangeFrame" not in out._jdf.queryExecution().toString() and out.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_parts_of_a_scan_do_not_grow(spark, monkeypatch):
    """Left to Spark, small parts are put together by their bytes, and a task's memory grows with the input."""
    monkeypatch.setattr(scans, "PART", 500)
    df = spark.range(4000).select((F.col("id") * 3).alias("t"), (F.col("id") % 10).alias("v"))
    stages, kept = [], scans.materialize
    monkeypatch.setattr(scans, "materialize", lambda frame, name: stages.append(kept(frame, name)) or stages[-1])
    got = {r.t: (r.n, r.s) for r in windows.rolling(df, "t", 3000, {"n": ("count", None), "s": ("sum", "v")}).collect()}
    assert got == {3 * i: (min(i + 1, 1000), sum(k % 10 for k in range(max(0, i - 999), i + 1))) for i in range(4000)}
    sizes = [r["count"] for r in stages[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 16 and max(sizes) <= 1000


def test_pivot_refuses_too_many_columns(spark):
    with pytest.raises(ValueError):
        reshape.pivot(spark.range(5).withColumn("x", F.lit(1)), "id", "x", "x", most_columns=4)
