"""Joins: eight kinds with suffixes and key coalescing, cardinality checks, and as-of joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import carry, has_large_group
from millrace.session import materialize
from millrace.types import quoted

_KINDS = {
    "inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right", "full": "full", "full outer": "full", "outer": "full",
    "left semi": "left_semi", "semi": "left_semi", "left anti": "left_anti", "anti": "left_anti", "right semi": "right_semi", "right anti": "right_anti", "cross": "cross",
}


def check_unique(df: DataFrame, keys: list[str], side: str) -> None:
    """An error where a key occurs more than once."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"keys {keys} of the {side} side are not unique")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often; null keys are not compared."""
    present = df.dropna(subset=keys)
    return present.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose key is set but has no parent; keys: child column to parent column."""
    there = parent.select(*[F.col(quoted(p)).alias(f"_p{i}") for i, p in enumerate(keys.values())])
    on = [child[quoted(c)] == F.col(f"_p{i}") for i, c in enumerate(keys)]
    return child.dropna(subset=list(keys)).join(there, on, "left_anti")


def join(
    left: DataFrame, right: DataFrame, keys: list[str] | str | None = None, right_keys: list[str] | str | None = None, how: str = "left outer",
    suffixes: tuple[str, str] = ("", "_right"), coalesce_keys: bool = True, validate: str = "m:m",
) -> DataFrame:
    """A join on equal keys; null keys never match. Columns on both sides get the suffixes; keys are coalesced to one column."""
    kind = _KINDS[how]
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    others = [right_keys] if isinstance(right_keys, str) else list(right_keys or keys)
    if kind == "cross":
        keys = others = []
    elif not keys or len(keys) != len(others):
        raise ValueError("keys of both sides are needed, as many each")
    if kind.startswith("right_"):
        return join(right, left, others, keys, kind.replace("right_", "left "), suffixes, coalesce_keys)
    if validate not in ("m:m", "m:1", "1:m", "1:1"):
        raise ValueError(f"unknown validation {validate!r}")
    if validate[0] == "1":
        check_unique(left, keys, "left")
    if validate[2] == "1":
        check_unique(right, others, "right")
    r = right.toDF(*[f"_r{i}" for i in range(len(right.columns))])
    place = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    on = [left[quoted(a)] == r[place[b]] for a, b in zip(keys, others, strict=True)]
    if kind in ("left_semi", "left_anti"):
        return left.join(r, on, kind)
    out = left.crossJoin(r) if kind == "cross" else left.join(r, on, kind)
    merged = dict(zip(keys, others, strict=True)) if coalesce_keys else {}
    gone = set(merged.values())
    shown = [c for c in right.columns if c not in gone]
    clash = set(left.columns) & set(shown)
    columns = []
    for c in left.columns:
        value = left[quoted(c)]
        if c in merged and kind in ("right", "full"):
            value = F.coalesce(value, r[place[merged[c]]])
        columns.append(value.alias(c + suffixes[0] if c in clash else c))
    columns += [r[place[c]].alias(c + suffixes[1] if c in clash else c) for c in shown]
    return out.select(*columns)


#: Rows of each side of a key that meet in one unit of a join on conditions; its square is the pairs that a task compares, about.
CUT = 4_000


def join_where(left: DataFrame, right: DataFrame, *conditions: Column, how: str = "inner", equal: list[tuple[str, str]] = ()) -> DataFrame:
    """A join on any conditions and on equal columns, given as pairs of names; without either equality Spark compares all rows.

    Keys given by `equal` are counted on both sides first. Where they make more than CUT * CUT pairs, rows are dealt over as
    many tasks as the pairs need, and a key of more pairs is cut: every part of its left rows meets every part of its right
    rows once. Outer, semi and anti joins cut only the side whose rows are kept, and full joins neither.
    """
    kind = _KINDS[how]
    if not equal:
        return left.join(right, list(conditions), kind)
    ours, theirs = ([pair[side] for pair in equal] for side in (0, 1))
    names = [f"_h{i}" for i in range(len(equal))]

    def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.dropna(subset=keys).groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(name))

    def parts(rows: str, cut: bool) -> Column:
        return F.ceil(F.col(rows) / CUT).cast("int") if cut else F.lit(1)

    cuts = kind in ("inner", "left", "left_semi", "left_anti"), kind in ("inner", "right")
    pairs = counted(left, ours, "_n").join(counted(right, theirs, "_m"), names).withColumn("_pairs", F.col("_n").cast("double") * F.col("_m"))
    pairs = materialize(pairs, "pairs")
    tasks = math.ceil((pairs.agg(F.sum("_pairs")).first()[0] or 0) / CUT**2)
    same = [left[quoted(a)] == right[quoted(b)] for a, b in equal]
    if tasks <= 1:
        return left.join(right, [*same, *conditions], kind)
    tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = pairs.where(F.col("_pairs") > CUT**2).select(*names, parts("_n", cuts[0]).alias("_left"), parts("_m", cuts[1]).alias("_right"))

    def dealt(df: DataFrame, keys: list[str], side: str, own: str, other: str) -> DataFrame:
        """Each row with its own part, once for each part of the other side; rows with a null key match nothing and are dealt out."""
        none = F.lit(False)
        for k in keys:
            none = none | F.col(quoted(k)).isNull()
        cut = df.withColumn("_i", F.monotonically_increasing_id()).join(heavy, [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left")
        mine = F.pmod("_i", F.when(none, tasks).otherwise(F.coalesce(own, F.lit(1)))).cast("int")
        cut = cut.withColumn(f"{side}{own}", mine).withColumn(f"{side}{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return cut.drop("_i", *names, "_left", "_right").repartition(tasks, *[F.col(quoted(k)) for k in keys], f"{side}_left", f"{side}_right")

    l, r = dealt(left, ours, "_l", "_left", "_right"), dealt(right, theirs, "_r", "_right", "_left")  # noqa: E741
    met = [l["_l_left"] == r["_r_left"], l["_l_right"] == r["_r_right"]]
    return l.join(r, [*same, *met, *conditions], kind).drop("_l_left", "_l_right", "_r_left", "_r_right")


def join_asof(left: DataFrame, right: DataFrame, on: str, by: list[str] | str = (), strategy: str = "backward", tolerance: str | float | None = None, right_on: str | None = None, suffix: str = "_right", spread: bool | None = None) -> DataFrame:
    """For each left row the nearest right row by `on`, within equal `by` keys.

    Both sides go into one ordered stream per key, in which the last (or next) right row is carried
    along, so there is one shuffle and no pairs. Where a key has more than rows.LARGE_GROUP rows, or there
    are no keys (or spread says so), the stream is cut into ranges that pass on what they carry. Equal values match; among equal right values the last
    by all its columns is taken; nearest takes the earlier on equal gaps. tolerance: an interval as
    text for times, a number else. Rows with a null in `on` or `by` match nothing.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    by = [by] if isinstance(by, str) else list(by)
    right_on = right_on or on
    values = [c for c in right.columns if c not in by]
    width = F.expr(f"interval {tolerance}") if isinstance(tolerance, str) else None if tolerance is None else F.lit(tolerance)
    left_part = left.select(*[F.col(quoted(c)).alias(f"_b{i}") for i, c in enumerate(by)], F.col(quoted(on)).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("_l"), F.lit(None).cast(right.select(F.struct(*[F.col(quoted(c)) for c in values])).schema[0].dataType).alias("_r"))
    right_part = right.where(F.col(quoted(right_on)).isNotNull()).dropna(subset=by or None if by else [right_on]).select(*[F.col(quoted(c)).alias(f"_b{i}") for i, c in enumerate(by)], F.col(quoted(right_on)).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left_part.schema["_l"].dataType).alias("_l"), F.struct(*[F.col(quoted(c)) for c in values]).alias("_r"))
    both = left_part.unionByName(right_part)
    keys = [f"_b{i}" for i in range(len(by))]
    known = F.when(F.col("_side") == 0, F.struct("_t", "_r"))
    orders = {"_before": [F.col("_t"), F.col("_side"), F.col("_r")], "_after": [F.col("_t"), F.col("_side").desc(), F.col("_r").desc()]}
    wanted = [n for n in orders if strategy not in ("backward" if n == "_after" else "forward",)]
    if by and spread is None:
        spread = has_large_group(both, keys)
    for name in wanted:
        onward = name == "_before"
        if spread or not by:
            both = carry(both, keys, orders[name], {name: known}, onward)
        else:
            # the opposite order for later rows: a frame up to the last row would be computed anew for every row
            order = orders[name] if onward else [F.col("_t").desc(), F.col("_side"), F.col("_r")]
            window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            both = both.withColumn(name, F.last(known, ignorenulls=True).over(window))
    rows = both.where("_side = 1")

    def within(side: str) -> Column:
        near = F.col(f"{side}._t").isNotNull() & F.col("_t").isNotNull()
        for i in range(len(by)):
            near = near & F.col(f"_b{i}").isNotNull()
        if width is not None:
            near = near & ((F.col("_t") <= F.col(f"{side}._t") + width) if side == "_before" else (F.col(f"{side}._t") <= F.col("_t") + width))
        return F.when(near, F.col(f"{side}._r"))

    if strategy == "backward":
        match = within("_before")
    elif strategy == "forward":
        match = within("_after")
    else:
        one, two = within("_before"), within("_after")
        nearer = (F.col("_t") - F.col("_before._t")) <= (F.col("_after._t") - F.col("_t"))
        match = F.when(one.isNull(), two).when(two.isNull() | nearer, one).otherwise(two)
    rows = rows.withColumn("_m", match)
    clash = set(left.columns)
    return rows.select(*[F.col(f"_l.{quoted(c)}").alias(c) for c in left.columns], *[F.col(f"_m.{quoted(c)}").alias(c + suffix if c in clash else c) for c in values])
