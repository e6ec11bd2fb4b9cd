"""Grouped aggregates by name, null profiles, summary statistics and distinct listings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.types import quoted


def _ordered(kind: Callable) -> Callable:
    def make(c: Column, order: Column | None) -> Column:
        if order is None:
            raise ValueError("first and last need an order")
        return kind(c, order)

    return make


#: Aggregates by the names that queries use; all skip nulls. Deviation and variance are those of a population.
FUNCTIONS: dict[str, Callable[[Column, Column | None], Column]] = {
    "sum": lambda c, o: F.sum(c),
    "mean": lambda c, o: F.avg(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "count": lambda c, o: F.count(c),
    "count_all": lambda c, o: F.count(F.lit(1)),
    "count_distinct": lambda c, o: F.count_distinct(c),
    "distinct": lambda c, o: F.collect_set(c),
    "list": lambda c, o: F.collect_list(c),
    "first": _ordered(F.min_by),
    "last": _ordered(F.max_by),
    "any": lambda c, o: F.bool_or(c),
    "all": lambda c, o: F.bool_and(c),
    "product": lambda c, o: F.product(c),
    "stddev": lambda c, o: F.stddev_pop(c),
    "variance": lambda c, o: F.var_pop(c),
    "stddev_sample": lambda c, o: F.stddev_samp(c),
    "variance_sample": lambda c, o: F.var_samp(c),
    "approximate_median": lambda c, o: F.percentile_approx(c, 0.5),
    "tdigest": lambda c, o: F.percentile_approx(c, 0.5),
    "one": lambda c, o: F.any_value(c),
    "min_max": lambda c, o: F.struct(F.min(c).alias("min"), F.max(c).alias("max")),
    "skew": lambda c, o: F.skewness(c),
    "kurtosis": lambda c, o: F.kurtosis(c),
}


def aggregate(df: DataFrame, aggs: list[tuple], group_by: list[str] | str = (), order_by: str | None = None) -> DataFrame:
    """aggs: (column, function[, alias]); without keys one row. The default name is column_function."""
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    order = None if order_by is None else F.col(quoted(order_by))
    made = []
    for column, function, *alias in aggs:
        if function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {function!r}")
        made.append(FUNCTIONS[function](F.col(quoted(column)) if column else F.lit(1), order).alias(alias[0] if alias else f"{column}_{function}"))
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*made)


def agg(df: DataFrame, by: list[str], *exprs: Column) -> DataFrame:
    return df.groupBy(*[F.col(quoted(k)) for k in by]).agg(*exprs)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, nulls, rows: counted for all columns in one pass."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(quoted(c)).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls"), F.col("_rows").alias("rows")) for i, c in enumerate(columns)])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def verify_nullable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns declared as never null that hold nulls after all."""
    return null_profile(df, columns).where("nulls > 0")


#: Steps of the histograms by which percentiles are found, their relative error, and how many values may be listed at last.
STEPS, ACCURACY, LISTED = 500, 10_000, 5_000


def exact_ranks(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """For each column the values (as doubles) at places in its sorted order, from 0, nulls left out.

    Selection by refining histograms: each scan counts, for all columns and places at once, what is below, at and between
    the two borders known to hold a place, and makes a histogram of equal depths of what is between; its steps around the
    place are the next borders. Each scan leaves less than a hundredth of the values, or an exact tie, and the last one
    lists at most some thousand. Sketches and counts are merged by tasks; no column is sorted or written.
    """
    values = {c: F.col(quoted(c)).cast("double") for c in ranks}
    #: column, place -> lower and upper border, whether what is between can be listed, and the borders before
    open_: dict[tuple[str, int], tuple] = {(c, r): (None, None, False, None) for c, places in ranks.items() for r in places}
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    grid = [k / STEPS for k in range(STEPS + 1)]
    while open_:
        brackets = sorted({(c, *open_[c, r][:3]) for c, r in open_}, key=repr)
        made = []
        for k, (c, low, high, listed) in enumerate(brackets):
            v = values[c]
            inside = v if low is None else F.when((v > low) & (v < high), v)
            made += [
                (F.lit(0) if low is None else F.count_if(v < low)).alias(f"below{k}"), (F.lit(0) if low is None else F.count_if(v == low)).alias(f"at_low{k}"),
                (F.lit(0) if low is None else F.count_if(v == high)).alias(f"at_high{k}"), F.count(inside).alias(f"inside{k}"), F.min(inside).alias(f"least{k}"), F.max(inside).alias(f"most{k}"),
                (F.collect_list(inside) if listed else F.percentile_approx(inside, grid, ACCURACY)).alias(f"seen{k}"),
            ]
        row = df.agg(*made).first()
        seen = {b: {n: row[f"{n}{k}"] for n in ("below", "at_low", "at_high", "inside", "least", "most", "seen")} for k, b in enumerate(brackets)}
        for (c, r), (low, high, listed, before) in list(open_.items()):
            s = seen[c, low, high, listed]
            k = r - s["below"]
            if low is not None and (k < 0 or k >= s["at_low"] + s["inside"] + s["at_high"]):  # the sketch was wrong: look in what lay beside
                open_[c, r] = (before[0], low, False, before) if k < 0 else (high, before[1], False, before)
                continue
            if k < s["at_low"]:
                found[c][r] = low
            elif k >= s["at_low"] + s["inside"]:
                found[c][r] = high
            elif listed:
                found[c][r] = sorted(s["seen"], key=lambda x: (x != x, x))[k - s["at_low"]]
            else:
                k -= s["at_low"]
                step, slack = k * STEPS / s["inside"], 1 + 2 * STEPS / ACCURACY
                one, two = math.floor(step - slack), math.ceil(step + slack)
                borders = (s["least"] if one <= 0 else s["seen"][one], s["most"] if two >= STEPS else s["seen"][two])
                if borders[0] == borders[1]:
                    found[c][r] = borders[0]
                else:
                    open_[c, r] = (*borders, (two - one + 2 * slack) * s["inside"] / STEPS <= LISTED, (s["least"], s["most"]))
                    continue
            del open_[c, r]
    return found


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), interpolation: str = "nearest") -> DataFrame:
    """One row a column: column, count, null_count, mean, std, min, percentiles, max.

    Counts and moments of all columns share one scan. A percentile is the value of rank p (n - 1) in
    the sorted column, ranks between two values by the interpolation; all ranks of all columns are found in the same few scans.
    """
    if interpolation not in ("nearest", "higher", "lower", "midpoint", "linear"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    rows = []
    for name in columns:
        c = F.col(quoted(name)).cast("double")
        rows.append(F.struct(F.lit(name).alias("column"), F.count(c).alias("count"), F.count_if(c.isNull()).alias("null_count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")))
    stats = [r["r"] for r in df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).collect()]
    names = [f"p{round(p * 100):02d}" for p in percentiles]
    places = {s["column"]: [p * (s["count"] - 1) for p in percentiles] if s["count"] else [] for s in stats}
    known = exact_ranks(df, {c: sorted({r for x in xs for r in (math.floor(x), math.ceil(x), math.floor(x + 0.5))}) for c, xs in places.items()})
    out = []
    for s in stats:
        picked: list[float | None] = [None] * len(percentiles)
        at = known[s["column"]]
        for k, x in enumerate(places[s["column"]]):
            low, high = at[math.floor(x)], at[math.ceil(x)]
            picked[k] = {"lower": low, "higher": high, "midpoint": (low + high) / 2, "linear": low + (high - low) * (x - math.floor(x)), "nearest": at[math.floor(x + 0.5)]}[interpolation]
        out.append((s["column"], s["count"], s["null_count"], s["mean"], s["std"], s["min"], *picked, s["max"]))
    schema = "column string, count long, null_count long, mean double, std double, min double, " + "".join(f"{n} double, " for n in names) + "max double"
    return df.sparkSession.createDataFrame(out, schema)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(quoted(column))).distinct().orderBy(F.col(quoted(column)).asc_nulls_last())


def status_summary(df: DataFrame, column: str = "mq_status") -> DataFrame:
    return df.groupBy(F.col(quoted(column))).agg(F.count(F.lit(1)).alias("n"))
