"""Rolling aggregates by scans: no task holds a whole window, however many rows of one key a period has.

Time is cut into buckets exactly as long as the window, so a window that doesn't fill one bucket is the end
of one and the beginning of the next: what is merged from its first moment to the border, and from the border to its last. Both
are running aggregates inside buckets, one backward and one forward. Rows are first merged by moment; moments and the ends of their windows
then form one stream, range-partitioned by key, bucket and moment, so a bucket of any size is dealt over
many tasks. A task scans its own part; what it would have got from other parts of a bucket comes from a table with one row
for each part of each bucket that has several. Nothing is subtracted, so least and greatest values work as sums do, and
sums lose no digits. The cost doesn't depend on how many rows a window has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize
from millrace.types import quoted

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
#: Rows of the stream, in this order at one moment: a window begins, the rows there, a window ends; and rows without a moment.
_BEGIN, _ROWS, _END, _NONE = range(4)

#: Rows of the stream in a part, about, whatever the size of the input.
PART = 250_000

Aggregate = tuple[str, str | Column | None]


def expression(spec: Aggregate) -> Column:
    """(count, sum, mean, min or max; column, or None to count rows) as Spark's aggregate."""
    kind, column = spec
    if kind not in ("count", "sum", "mean", "min", "max") or column is None and kind != "count":
        raise ValueError(f"unknown aggregate {spec!r}")
    value = F.lit(1) if column is None else F.col(quoted(column)) if isinstance(column, str) else column
    return (F.avg if kind == "mean" else getattr(F, kind))(value)


def _pieces(n: int, spec: Aggregate) -> dict[str, tuple[str, Column]]:
    """What has to be merged for an aggregate: names, how they merge, and their values over rows of one moment."""
    kind, column = spec
    if kind == "mean":
        return {f"_p{n}s": ("sum", expression(("sum", column))), f"_p{n}c": ("sum", expression(("count", column)))}
    return {f"_p{n}": ("sum" if kind == "count" else kind, expression(spec))}


def _both(merge: str, a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b) if merge == "sum" else (F.least if merge == "min" else F.greatest)(a, b)


def rolling_scan(df: DataFrame, moment: Column, low: int, high: int, aggs: dict[str, Aggregate], by: list[str] = ()) -> DataFrame:
    """For each row aggregates over the rows of its key whose moment (a whole number) is in [m + low, m + high], both ends in.

    A window without rows gives null, and 0 for counts; rows without a moment form a window of their own in each
    key; null keys are a key. Rows of one moment share a window, and meet it by a join, whose skew is left to Spark.
    """
    kinds = {n: df.agg(expression(spec).alias("x")).schema["x"].dataType for n, spec in aggs.items()}
    size = high - low + 1
    if size <= 0:
        return df.withColumns({n: F.lit(0 if aggs[n][0] == "count" else None).cast(kind) for n, kind in kinds.items()})
    pieces = {p: piece for n, spec in enumerate(aggs.values()) for p, piece in _pieces(n, spec).items()}
    keys = [f"_k{i}" for i in range(len(by))]
    moments = df.withColumn("_t", moment).groupBy(*[F.col(quoted(c)).alias(k) for c, k in zip(by, keys, strict=True)], "_t").agg(*[value.alias(p) for p, (_, value) in pieces.items()])

    def bucket(at: Column) -> Column:
        return F.call_function("div", at - F.pmod(at, F.lit(size)), F.lit(size)) if size > 1 else at

    t = F.col("_t")
    first, last = bucket(t + low), bucket(t + high)

    def entry(at: Column, kind: int) -> Column:
        return F.struct(bucket(at).cast("long").alias("_b"), at.cast("long").alias("_at"), F.lit(kind).alias("_kind"))

    known = F.array(entry(t + low, _BEGIN), entry(t, _ROWS), F.when(first != last, entry(t + high, _END)))
    entries = F.when(t.isNull(), F.array(entry(t, _NONE))).otherwise(F.array_compact(known))
    stream = moments.withColumn("_e", F.explode(entries)).select(*keys, "_t", "_e.*", *[F.when(F.col("_e._kind").isin(_ROWS, _NONE), F.col(p)).alias(p) for p in pieces])
    most = math.ceil(3 * df.count() / PART)  # three entries a moment at most, and no more moments than rows
    placed = stream.repartitionByRange(*([most] if most > 1 else []), *keys, "_b", "_at", "_kind", "_t")
    placed = materialize(placed.withColumn("_part", F.spark_partition_id()), "rolling")

    def merged(window, suffix: str) -> dict[str, Column]:
        return {f"{p}{suffix}": _MERGE[merge](p).over(window) for p, (merge, _) in pieces.items()}

    # the backward scan runs forward over the opposite order: a frame that ends at the last row is computed anew for every row
    local, up, down = Window.partitionBy("_part", *keys, "_b"), ["_at", "_kind"], [F.desc("_at"), F.desc("_kind")]
    so_far = (Window.unboundedPreceding, 0)
    scanned = placed.withColumns(merged(local.orderBy(*up).rowsBetween(*so_far), "f")).withColumns(merged(local.orderBy(*down).rowsBetween(*so_far), "r"))

    parts = placed.where(F.col("_b").isNotNull()).groupBy("_part", *keys, "_b").agg(*[_MERGE[merge](p).alias(p) for p, (merge, _) in pieces.items()])
    whole, others = Window.partitionBy(*keys, "_b"), (Window.unboundedPreceding, -1)
    many = parts.withColumn("_parts", F.count(F.lit(1)).over(whole)).where("_parts > 1")
    many = many.withColumns(merged(whole.orderBy("_part").rowsBetween(*others), "b")).withColumns(merged(whole.orderBy(F.desc("_part")).rowsBetween(*others), "a"))
    sent = many.select(F.col("_part").alias("_jpart"), F.col("_b").alias("_jb"), *[F.col(k).alias(f"_j{k}") for k in keys], *[f"{p}{s}" for p in pieces for s in "ba"])
    on = [F.col("_part") == F.col("_jpart"), F.col("_b") == F.col("_jb"), *[F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys]]
    ends = scanned.where(F.col("_kind") != _ROWS).join(sent, on, "left")

    def share(p: str, merge: str) -> Column:
        behind, ahead = _both(merge, F.col(f"{p}f"), F.col(f"{p}b")), _both(merge, F.col(f"{p}r"), F.col(f"{p}a"))
        return F.when(F.col("_kind") == _BEGIN, ahead).when(F.col("_kind") == _END, behind).otherwise(F.col(p))

    windows = ends.groupBy(*[F.col(k).alias(f"_w{k}") for k in keys], F.col("_t").alias("_wt")).agg(*[_MERGE[merge](share(p, merge)).alias(p) for p, (merge, _) in pieces.items()])

    def result(n: int, name: str) -> Column:
        kind = aggs[name][0]
        if kind == "mean":
            return F.when(F.col(f"_p{n}c") > 0, F.col(f"_p{n}s") / F.col(f"_p{n}c"))
        return F.coalesce(F.col(f"_p{n}"), F.lit(0)) if kind == "count" else F.col(f"_p{n}")

    same = [F.col("_t").eqNullSafe(F.col("_wt")), *[F.col(quoted(c)).eqNullSafe(F.col(f"_w{k}")) for c, k in zip(by, keys, strict=True)]]
    out = df.withColumn("_t", moment).join(windows, same, "left").withColumns({name: result(n, name).cast(kinds[name]) for n, name in enumerate(aggs)})
    return out.select(*[F.col(quoted(c)) for c in dict.fromkeys([*df.columns, *aggs])])
