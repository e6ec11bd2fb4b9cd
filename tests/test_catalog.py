"""The query object: its JSON, names, predicates, joins, and how it compiles."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.catalog import Catalog, Column, Entity, Group, Join, Operation, Sort
from millrace.plans.compile import condition, to_dataframe
from millrace.types import quoted


def c(entity, name, **k):
    return Column(entity, name, **k)


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "A%"), (5, "b")], "id int, v string")


@pytest.mark.parametrize(
    ("op", "value", "wanted"),
    [
        ("=", "a", {3}), ("!=", "a", {2, 4, 5}), ("<>", "a", {2, 4, 5}), (">", "a", {5}), ("<", "a", {2, 4}), (">=", "a", {3, 5}), ("<=", "a", {2, 3, 4}),
        ("IN", ["a", "b"], {3, 5}), ("NOT IN", ["a"], {2, 4, 5}), ("IN", [], set()), ("NOT IN", [], {1, 2, 3, 4, 5}), ("IN", "a", set()), ("LIKE", "A%", {4}), ("NOT LIKE", "A%", {2, 3, 5}),
        ("BETWEEN", ["A", "a"], {3, 4}), ("NOT BETWEEN", ["A", "a"], {2, 5}), ("IS NULL", None, {1}), ("IS NOT NULL", None, {2, 3, 4, 5}), ("=", None, set()),
    ],
)
def test_predicates(grid, op, value, wanted):
    assert {r.id for r in grid.where(condition([Operation(c("g", "v"), op, value)], lambda x: F.col(quoted(x.name)))).collect()} == wanted


def test_groups(grid):
    def ids(items):
        where = condition(items, lambda x: F.col(quoted(x.name)))
        return {r.id for r in (grid if where is None else grid.where(where)).collect()}

    a, big = Operation(c("g", "v"), "=", "a"), Operation(c("g", "id"), ">", 3)
    assert ids([Group("NOT", [a, Operation(c("g", "id"), "<", 9)])]) == {2, 4, 5}
    assert ids([Group("OR", [a, big])]) == {3, 4, 5}
    assert ids([Group("AND", []), Group("OR", [Group("AND", [])])]) == {1, 2, 3, 4, 5}
    assert ids([a, big]) == set()


def test_bad_objects():
    with pytest.raises(ValueError):
        Operation(c("g", "v"), "BETWEEN", [1])
    with pytest.raises(ValueError):
        Operation(c("g", "v"), "~", 1)
    with pytest.raises(ValueError):
        Join(c("a", "x"), c("b", "x"), "SEMI")


def two(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "ID int, a string")
    right = spark.createDataFrame([(1, None), (2, "set")], "ID int, b string")
    return {"l": left, "r": right}


def test_filter_above_outer_join_and_name_clash(spark):
    catalog = Catalog([Entity("l", [c("l", "ID"), c("l", "a")]), Entity("r", [c("r", "ID"), c("r", "b")])], [Join(c("l", "ID"), c("r", "ID"), "LEFT")], [Operation(c("r", "b"), "IS NULL")])
    out = to_dataframe(catalog, two(spark))
    assert out.columns == ["l.ID", "a", "r.ID", "b"]
    assert {r["l.ID"] for r in out.collect()} == {1, 3}
    assert Catalog.from_json(catalog.to_json()) == catalog
    typed = Catalog([Entity("l", [c("l", "ID", type="int64", nullable=False)]), Entity("r", [c("r", "ID", type="decimal128", precision=10, scale=2, nullable=False), c("r", "u")])], [Join(c("l", "ID"), c("r", "ID"), "LEFT")])
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in typed.schema()] == [("l.ID", "bigint", False), ("r.ID", "decimal(38,2)", True)]


def test_roots_circles_and_limits(spark):
    t = two(spark)
    both = [Entity("l", [c("l", "a")]), Entity("r", [c("r", "b")])]
    with pytest.raises(ValueError, match="circle"):
        to_dataframe(Catalog(both, [Join(c("l", "ID"), c("r", "ID")), Join(c("r", "ID"), c("l", "ID"))]), t)
    with pytest.raises(ValueError):
        to_dataframe(Catalog(both), t)
    pairs = Catalog(both, [Join(c("l", "ID"), c("r", "ID")), Join(c("l", "a"), c("r", "b"))])
    assert to_dataframe(pairs, t).count() == 0
    one = [Entity("l", [c("l", "ID")])]
    assert to_dataframe(Catalog(one, limit=0), t).count() == 0
    assert [r.ID for r in to_dataframe(Catalog(one, sorts=[Sort(c("l", "ID"), "DESC")], limit=1, offset=1), t).collect()] == [2]
    same = Catalog([Entity("p", [c("p", "ID")]), Entity("q", [c("q", "ID")])])
    assert to_dataframe(same, {"p": t["l"], "q": t["r"]}).count() == 5
    named = t["l"].toDF("l.ID", "a")
    assert to_dataframe(Catalog([Entity("l", [c("l", "ID"), c("l", "gone")])]), {"l": named}).columns == ["ID"]


def test_null_order_and_moments(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    entity = [Entity("t", [c("t", "v")])]
    order = lambda **k: [r.v for r in to_dataframe(Catalog(entity, sorts=[Sort(c("t", "v"), **k)]), {"t": df}).collect()]
    assert order() == [1, 2, None] and order(direction="DESC") == [2, 1, None] and order(nulls_first=True) == [None, 1, 2]
    moments = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 12),)], "v timestamp_ntz")
    zone = datetime.timezone(datetime.timedelta(hours=2))
    where = [Operation(c("t", "v"), "=", datetime.datetime(2024, 1, 1, 14, tzinfo=zone))]
    assert to_dataframe(Catalog(entity, filters=where), {"t": moments}).count() == 1
