"""Range joins, exact ranks, keyed tables and slices against plain Python."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, ranges, rows, tables, windows
from millrace.operators.keyed import KeyedTable
from millrace.session import shared_dir


def _spans(rng, n):
    out = []
    for i in range(n):
        kind, a = rng.choice("psmlnx"), rng.choice([0.0, 1e6, -5.5, 8.0]) + rng.choice([0.0, rng.random() * 100])
        b = {"p": a, "s": a + rng.random() * 0.01, "m": a + rng.random() * 4, "l": a + rng.random() * 300, "n": a, "x": a - 1}[kind]
        out.append((i, None if kind == "n" else a, b, rng.choice([1, 2, None])))
    return [*out, (n, 4.0, 8.0, 1), (n + 1, 8.0, 8.0, 1), (n + 2, float("nan"), float("nan"), 1), (n + 3, -0.0, 0.0, 2)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_overlaps_equal_all_pairs(spark, closed, by):
    rng = random.Random(7)
    left, right = _spans(rng, 90), _spans(rng, 90)
    a, b = spark.createDataFrame(left, "id int, a double, b double, g int"), spark.createDataFrame(right, "id int, c double, d double, g int")

    def sound(x):
        return x[1] is not None and x[1] <= x[2] and (not by or x[3] is not None)

    want = sorted((x[0], y[0]) for x in left for y in right if sound(x) and sound(y) and (not by or x[3] == y[3]) and (x[1] <= y[2] and y[1] <= x[2] if closed else x[1] < y[2] and y[1] < x[2]))
    hit = {x for x, _ in want}
    for salts in (1, 3):
        met = ranges.join_overlap(a, b, ("a", "b"), ("c", "d"), by, closed, salts=salts)
        assert sorted((r["id"], r["id_right"]) for r in met.collect()) == want
        assert "NestedLoop" not in met._jdf.queryExecution().toString()
    one = {how: ranges.join_overlap(a, b, ("a", "b"), ("c", "d"), by, closed, how) for how in ("semi", "anti", "left")}
    assert sorted(r["id"] for r in one["semi"].collect()) == sorted(hit)
    assert sorted(r["id"] for r in one["anti"].collect()) == sorted(x[0] for x in left if x[0] not in hit)
    assert sorted((r["id"], -1 if r["id_right"] is None else r["id_right"]) for r in one["left"].collect()) == sorted([*want, *((x[0], -1) for x in left if x[0] not in hit)])
    assert ranges.join_overlap(a.limit(0), b, ("a", "b"), ("c", "d"), by).count() == 0


def test_rows_meet_only_in_levels_of_the_other_side(spark):
    """Points against bands of one length: a row for each point, two at most for each band; none that can meet nothing."""
    a, b = spark.range(100).select((F.col("id") / 7).alias("x")), spark.range(50).select((F.col("id") / 3).alias("y"))
    made, kept = [], ranges._binned
    ranges._binned = lambda *given: made.append(kept(*given)) or made[-1]
    try:
        assert ranges.join_band(a, b, "x", "y", 0.2, 0.2).count() == sum(abs(i / 7 - k / 3) <= 0.2 for i in range(100) for k in range(50))
    finally:
        ranges._binned = kept
    assert made[0].count() == 100 and made[1].count() <= 100 and "x" not in " ".join(made[1].columns)


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_overlaps_of_few_and_of_many_rows_a_key(spark, monkeypatch, how):
    """Small keys are joined without bins, large ones by bins, both at once or all of them: the same pairs."""
    rng = random.Random(5)
    rows_ = [[(i, a := rng.randrange(500), a + rng.choice([0, 1, 5, 40]), 0 if i % 3 else i % 20) for i in range(150)] for _ in range(2)]
    a, b = (spark.createDataFrame(r, f"id int, {x} int, {y} int, g int") for r, x, y in zip(rows_, "ac", "bd", strict=True))
    asked, kept = [], ranges._levels
    monkeypatch.setattr(ranges, "_levels", lambda df: asked.append(df) or kept(df))
    got = []
    for cheap, scans in ((1000, 0), (10, 2), (0, 2)):
        monkeypatch.setattr(ranges, "CHEAP", cheap)
        asked.clear()
        got.append(sorted(map(tuple, ranges.join_overlap(a, b, ("a", "b"), ("c", "d"), "g", how=how).collect()), key=str))
        assert len(asked) == scans
    plain = a.join(b.toDF("i", "c", "d", "h"), F.expr("g = h AND a <= d AND c <= b"), how)
    assert got[0] == got[1] == got[2] == sorted(map(tuple, plain.collect()), key=str)

def test_overlaps_of_whole_numbers(spark):
    rng = random.Random(3)
    one, two = ([(i, a := rng.randrange(-60, 60), a + rng.choice([0, 1, 2, 3, 4, 7, 8, 16, 31])) for i in range(120)] for _ in range(2))
    a, b = spark.createDataFrame(one, "id int, a long, b long"), spark.createDataFrame(two, "id int, c long, d long")
    got = ranges.join_overlap(a, b, ("a", "b"), ("c", "d"))
    assert sorted((r["id"], r["id_right"]) for r in got.collect()) == sorted((x[0], y[0]) for x in one for y in two if x[1] <= y[2] and y[1] <= x[2])


def test_band_of_times(spark):
    a = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7) AS t FROM range(200)")
    b = spark.sql("SELECT id AS k, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 11) AS u FROM range(100)")
    got = ranges.join_band(a, b, "t", "u", F.expr("interval 5 seconds"), F.expr("interval 9 seconds"))
    assert sorted((r.id, r.k) for r in got.collect()) == sorted((i, k) for i in range(200) for k in range(100) if 11 * k - 5 <= 7 * i <= 11 * k + 9)


@pytest.mark.parametrize("steps,listed", [(500, 5000), (50, 20)])
def test_exact_ranks(spark, monkeypatch, steps, listed):
    monkeypatch.setattr(aggregates, "STEPS", steps)
    monkeypatch.setattr(aggregates, "LISTED", listed)
    rng = random.Random(2)
    values = [rng.choice([0.0, 1.0, rng.gauss(0, 1e9), rng.random() * 1e-9, 7.0]) for _ in range(6000)] + [5.0] * 4000
    df = spark.createDataFrame([(v, float(i % 3), None if i % 5 == 0 else v) for i, v in enumerate(values)], "v double, w double, `x y` double")
    places = [0, 1, 500, 3999, 4000, 4001, 7998, 7999]
    got = aggregates.exact_ranks(df, {c: places for c in df.columns})
    for k, c in enumerate(df.columns):
        held = sorted(r[k] for r in df.collect() if r[k] is not None)
        assert [got[c][p] for p in places] == [held[p] for p in places]
    assert aggregates.exact_ranks(df.limit(0), {"v": []}) == {"v": {}}
    assert aggregates.describe(df.limit(0), ["v", "w"]).select("count", "p50").collect() == [(0, None), (0, None)]


def test_merges_rewrite_only_files_with_their_keys(spark):
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", ["k", "j"], 100)
    base = spark.createDataFrame([*((i, i % 3, f"v{i}") for i in range(1000)), *[(None, 1, "n")] * 5], "k int, j int, v string")
    table.create(base)
    before = {tuple(r) for r in table.files(0).select("write", "file").collect()}
    told = table.merge(0, spark.createDataFrame([(5, 2, "new"), (6, 9, "ins"), (700, 1, "new"), (None, 2, "nn")], "k int, j int, v string"))
    after = {tuple(r) for r in table.files(1).select("write", "file").collect()}
    assert told["files"] == len(before) and 2 <= told["rewritten"] <= 3 and len(before & after) == len(before) - told["rewritten"]
    want = {(i, i % 3): f"v{i}" for i in range(1000)} | {(5, 2): "new", (6, 9): "ins", (700, 1): "new"}
    assert sorted(map(tuple, table.read(1).collect()), key=str) == sorted([*((*k, v) for k, v in want.items()), *[(None, 1, "n")] * 5, (None, 2, "nn")], key=str)
    told = table.merge(1, spark.createDataFrame([(7, 1), (None, 1), (8, 8)], "k int, j int"), delete=True)
    assert told["rewritten"] <= 2 and table.read(2).count() == table.read(1).count() - 1 and table.read(0).count() == 1005
    with pytest.raises(Exception, match="already exists"):
        table.merge(0, base.where("k = 1"))
    with pytest.raises(ValueError):
        table.merge(2, spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "k int, j int, v string"))


def test_a_table_has_as_many_files_as_its_rows_need(spark):
    """A task writes several files one after the other, without a rest each, and whole folders are read as such."""
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", ["k"], 10)
    table.create(spark.range(0, 4000, 2, 7).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    files = table.files(0).collect()
    assert 200 <= len(files) <= 204 and max(r["rows"] for r in files) == 10
    assert len({tuple(r) for r in table.read(0).select(F.spark_partition_id()).distinct().collect()}) <= 204 and len(table.read(0).inputFiles()) == len(files)
    told = table.merge(0, spark.range(1, 4001, 2).select(F.col("id").alias("k"), F.lit("b").alias("v")))
    assert told["files"] == len(files) and table.files(1).count() <= 400 + 7
    assert table.merge(1, spark.createDataFrame([(5, "c"), (1000, "c")], "k long, v string"))["rewritten"] == 2
    assert sorted((r.k, r.v) for r in table.read(2).collect()) == [(k, "c" if k in (5, 1000) else "ab"[k % 2]) for k in range(4000)]

def test_keyed_table_of_texts_and_of_nothing(spark):
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", ["k"], 10)
    rows_ = spark.createDataFrame([(f"k{i:03}", i) for i in range(50)], "k string, v int")
    table.create(rows_.limit(0))
    assert table.read(0).count() == 0
    table.merge(0, rows_)
    assert table.merge(1, rows_.where("v = 7").withColumn("v", F.lit(70)))["rewritten"] == 1
    assert sorted(r.v for r in table.read(2).collect()) == sorted([70, *(i for i in range(50) if i != 7)])


def test_null_keys_of_an_upsert_are_spread(spark):
    target = spark.createDataFrame([(None, "a")] * 40 + [(1, "b")], "k int, v string")
    source = spark.createDataFrame([(None, "c")] * 30 + [(1, "d"), (2, "e")], "k int, v string")
    out = tables.upsert(target, source, "k")
    assert sorted((r.k or 0, r.v) for r in out.collect()) == sorted([(0, "a")] * 40 + [(0, "c")] * 30 + [(1, "d"), (2, "e")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = tables.upsert(target, source, "k").withColumn("p", F.spark_partition_id()).where("k is null").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 70


def test_slices_and_windows_without_a_single_partition(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"), F.lit(1).alias("same"))
    monkeypatch.setattr(rows, "GATHERED", 10)
    for got, want in (
        (rows.slice_rows(df, 480, None, "v"), range(480, 500)), (rows.slice_rows(df, 100, 30, "v"), range(100, 130)),
        (rows.tail(df, 20, "v"), range(480, 500)), (rows.limit(df, 20, 5, "v"), range(5, 25)),
    ):
        assert [r.v for r in got.collect()] == list(want)
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["i"] for r in rows.with_row_index(df, "same", "i").collect()) == list(range(500))
    times = df.select(F.timestamp_seconds(F.col("v") * 600 + 300).alias("t"), F.when(F.col("v") % 2 == 0, 1).alias("g"))
    for by in ([], ["g"]):
        out = windows.group_by_dynamic(times, "t", "1h", {"n": F.count(F.lit(1))}, start_by="datapoint", by=by)
        assert sum(r.n for r in out.collect()) == 500 and {r.n for r in out.collect()} <= {1, 2, 3, 4, 6}
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_keyed_table_follow_the_keys(spark):
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", ["k"], 100)
    table.create(spark.range(20000).selectExpr("pmod(id * 7919, 20000) AS k", "id AS v").repartition(5))
    index = spark.read.parquet(*[f"{table.base}/index/{r['write']}" for r in table.files(0).select("write").distinct().collect()])
    assert index.agg({"rows": "sum"}).first()[0] == 20000 and index.where("high - low + 1 <> rows").isEmpty()
    asked = spark.range(1, 2).selectExpr("id * 500 AS k")
    assert len(table.touched(0, asked.union(asked)).collect()) == 1
