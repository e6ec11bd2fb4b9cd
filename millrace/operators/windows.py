"""Rolling and dynamic windows, shifts, fills, interpolation, and thresholds over time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.rows import carry, has_large_group, sort_keys, with_row_index
from millrace.operators.scans import Aggregate, expression, rolling_scan
from millrace.types import quoted

# Microseconds in the units of fixed length, and months in those of the calendar.
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_MONTHS = {"mo": 1, "q": 3, "y": 12}


def duration(text: str) -> tuple[int, int]:
    """A duration such as 1d12h, -2w or 1mo as (months, microseconds)."""
    sign = -1 if text.startswith("-") else 1
    plain = text.lstrip("+-")
    parts = re.findall(r"(\d+)(us|ms|mo|[smhdwqy])", plain)
    if not parts or "".join(n + u for n, u in parts) != plain:
        raise ValueError(f"not a duration: {text!r}")
    return sign * sum(int(n) * _MONTHS[u] for n, u in parts if u in _MONTHS), sign * sum(int(n) * _MICROS[u] for n, u in parts if u in _MICROS)


def micros(c: Column) -> Column:
    """A moment as microseconds since 1970, its wall clock taken as UTC."""
    return F.unix_micros(c.cast("timestamp_ltz"))


def _number(df: DataFrame, index: str) -> tuple[Column, bool]:
    kind = df.schema[index].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return (micros(F.col(quoted(index))) if timed else F.col(quoted(index)).cast("long")), timed


def rolling(df: DataFrame, index: str, period: str | int, aggs: dict[str, Column | Aggregate], offset: str | int | None = None, closed: str = "right", by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """For each row aggregates over the rows of its group whose index lies in a window that ends at the row.

    The window is (t + offset, t + offset + period] and, by default, offset is minus the period; closed
    says which ends belong to it. Indexes are moments (durations of fixed length) or integers.

    Where a key has more than rows.LARGE_GROUP rows, or there are no keys (or spread says so), aggregates given as
    pairs, such as ("sum", "price") or ("count", None), are scanned: a period of any number of rows is
    dealt over tasks. For other aggregates time is cut into buckets as long as the period: a window reaches into two of them, so every
    row goes to its own bucket and the one before, and no task holds more of a key than two periods; their cost is that of all rows of
    all windows, which pairs spare.
    """
    value, timed = _number(df, index)

    def length(x: str | int) -> int:
        if not timed:
            return int(x)
        months, us = duration(x)
        if months:
            raise ValueError("rolling windows need a fixed length")
        return us

    size = length(period)
    low = -size if offset is None else length(offset)
    high = low + size
    if closed not in ("left", "right", "both", "none"):
        raise ValueError(f"unknown closed {closed!r}")
    keys = [F.col(quoted(c)) for c in by]
    frame = (low + (closed in ("right", "none")), high - (closed in ("left", "none")))
    pairs = all(isinstance(a, tuple) for a in aggs.values())
    given, aggs = aggs, {n: expression(a) if isinstance(a, tuple) else a for n, a in aggs.items()}
    if not (spread if spread is not None else not by or has_large_group(df, by)):
        window = Window.partitionBy(*keys).orderBy("_t").rangeBetween(*frame)
        return df.withColumn("_t", value).withColumns({n: e.over(window) for n, e in aggs.items()}).drop("_t")
    if pairs:
        return rolling_scan(df, value, *frame, given, by)
    width = max(1, size)
    timed_rows = df.withColumn("_t", value)
    # the row's own window begins in bucket _own; a row at t is needed by windows that begin in bucket(t) or the one before
    placed = timed_rows.withColumns({"_own": F.floor((F.col("_t") + low) / F.lit(width)), "_at": F.floor(F.col("_t") / F.lit(width))})
    copies = placed.withColumn("_b", F.explode(F.array_distinct(F.array(F.coalesce("_own", F.lit(0)), *[F.coalesce("_at", F.lit(0)) - k for k in (0, 1)]))))
    window = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(*frame)
    out = copies.withColumns({n: e.over(window) for n, e in aggs.items()})
    return out.where(F.col("_b") == F.coalesce("_own", F.lit(0))).drop("_t", "_own", "_at", "_b")


def group_by_dynamic(
    df: DataFrame, index: str, every: str, aggs: dict[str, Column], period: str | None = None, offset: str | None = None, closed: str = "left",
    label: str = "left", start_by: str = "window", include_boundaries: bool = False, by: list[str] = (),
) -> DataFrame:
    """Aggregates over windows that start every so often and last for a period, the same unless given.

    Starts are multiples of `every` from 1970-01-01 (weeks from a Monday; months and years by the
    calendar) plus the offset; start_by datapoint counts them from each group's first moment instead.
    A row falls into every window that covers it: which ends count is closed; label names a window by
    its left or right end or by its first row. Windows without rows are not listed.
    """
    if closed not in ("left", "right", "both", "none") or label not in ("left", "right", "datapoint") or start_by not in ("window", "datapoint"):
        raise ValueError("unknown closed, label or start_by")
    months, us = duration(every)
    period_months, period_us = duration(period or every)
    offset_months, offset_us = duration(offset) if offset else (0, 0)
    if months and us or months < 0 or us < 0 or not (months or us) or offset_months and not months or period_months and not months:
        raise ValueError("every must be a positive length of one sort, offset and period likewise")
    keys = [F.col(quoted(c)) for c in by]
    kind = df.schema[index].dataType
    rows = df.where(F.col(quoted(index)).isNotNull()).withColumn("_t", micros(F.col(quoted(index))))

    def moment(m: Column) -> Column:
        return F.timestamp_micros(m)

    # windows that cover t start in (t - period, t], one step more on either side for the ends
    if months:
        if start_by == "datapoint":
            raise ValueError("windows by the calendar start by window")
        number = (F.year(moment(F.col("_t"))) - 1970) * 12 + F.month(moment(F.col("_t"))) - 1
        reach = (period_months + (period_us > 0) * (period_us // (28 * _MICROS["d"]) + 1) + abs(offset_months) + (offset_us != 0) * (abs(offset_us) // (28 * _MICROS["d"]) + 1) + months - 1) // months + 1
        step = F.floor(number / months).cast("int")
        rows = rows.withColumn("_k", F.explode(F.sequence(step - reach, step + reach)))

        def border(extra_months: int, extra_us: int) -> Column:
            start = F.add_months(F.lit("1970-01-01").cast("date"), F.col("_k") * months + offset_months + extra_months).cast("timestamp_ltz")
            return F.unix_micros(start) + F.lit(offset_us + extra_us)

        rows = rows.withColumn("_low", border(0, 0)).withColumn("_high", border(period_months, period_us))
    else:
        # weeks start on Mondays: 1970-01-05 was one
        origin = F.lit(4 * _MICROS["d"] if us % _MICROS["w"] == 0 else 0)
        if start_by == "datapoint":
            firsts = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_t").alias("_first"))
            rows = rows.join(firsts, _keys_equal(by)).drop(*[f"_k{i}" for i in range(len(keys))]) if keys else rows.crossJoin(F.broadcast(firsts))  # one row
            origin = F.col("_first")
        origin = origin + F.lit(offset_us)
        step = F.floor((F.col("_t") - origin) / us)
        back = -(-period_us // us)
        rows = rows.withColumn("_o", origin).withColumn("_k", F.explode(F.sequence(step - back, step + 1)))
        rows = rows.withColumn("_low", F.col("_o") + F.col("_k") * us).withColumn("_high", F.col("_o") + F.col("_k") * us + period_us)
        if start_by == "datapoint":
            rows = rows.where("_k >= 0")
    left = F.col("_t") >= F.col("_low") if closed in ("left", "both") else F.col("_t") > F.col("_low")
    right = F.col("_t") <= F.col("_high") if closed in ("right", "both") else F.col("_t") < F.col("_high")
    plain = isinstance(kind, (T.TimestampNTZType, T.DateType))

    def shown(m: str) -> Column:
        return moment(F.col(m)).cast(kind if plain else "timestamp_ltz")

    out = rows.where(left & right).groupBy(*keys, "_low", "_high").agg(F.min("_t").alias("_at"), *[e.alias(n) for n, e in aggs.items()])
    named = {"left": "_low", "right": "_high", "datapoint": "_at"}[label]
    edges = [shown("_low").alias("_lower_boundary"), shown("_high").alias("_upper_boundary")] if include_boundaries else []
    return out.select(*keys, *edges, shown(named).alias(index), *[F.col(quoted(n)) for n in aggs])


def _keys_equal(by: list[str]) -> list[Column]:
    return [F.col(quoted(c)).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]


def shift(df: DataFrame, n: int, order_by: list[str] | str, fill=None, columns: list[str] | None = None, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Columns moved n rows down (up for negative n); rows that come free get the fill value.

    Where a key has more than rows.LARGE_GROUP rows, or there are no keys (or spread says so), rows get global numbers by key and
    order and meet the row n before them by a join, so no task walks a whole key.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    moved = columns or [c for c in df.columns if c not in order and c not in by]
    if not (spread if spread is not None else not by or has_large_group(df, by)):
        window = Window.partitionBy(*[F.col(quoted(c)) for c in by]).orderBy(*sort_keys(order))
        move = F.lag if n >= 0 else F.lead
        return df.withColumns({c: move(F.col(quoted(c)), abs(n), fill).over(window) for c in moved})
    numbered = with_row_index(df, [*by, *order], "_i")
    source = numbered.select((F.col("_i") + n).alias("_j"), *[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(by)], *[F.col(quoted(c)).alias(f"_m{k}") for k, c in enumerate(moved)])
    joined = numbered.join(source, [F.col("_i") == F.col("_j"), *_keys_equal(by)], "left")
    place = {c: F.when(F.col("_j").isNotNull(), F.col(f"_m{k}")).otherwise(F.lit(fill)).cast(df.schema[c].dataType) for k, c in enumerate(moved)}
    return joined.select(*[place.get(c, F.col(quoted(c))).alias(c) for c in df.columns])


def fill_forward(df: DataFrame, columns: list[str], order_by: list[str] | str, by: list[str] = (), limit: int | None = None, backward: bool = False, spread: bool | None = None) -> DataFrame:
    """Nulls become the last (backward: the next) value, over at most `limit` rows.

    Without `by`, or with a key of more than rows.LARGE_GROUP rows (or if spread says so), ranges of rows pass values on.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not (spread if spread is not None else not by or has_large_group(df, by)):
        # backward is forward over the opposite order: a frame up to the last row would be computed anew for every row
        window = Window.partitionBy(*[F.col(quoted(c)) for c in by]).orderBy(*sort_keys(order, backward, not backward))
        window = window.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
        return df.withColumns({c: F.last(F.col(quoted(c)), ignorenulls=True).over(window) for c in columns})
    numbered = with_row_index(df, [*by, *order], "_i")
    known = {f"_v{k}": F.when(F.col(quoted(c)).isNotNull(), F.struct("_i", F.col(quoted(c)).alias("v"))) for k, c in enumerate(columns)}
    out = carry(numbered, list(by), [F.col("_i")], known, not backward)

    def value(k: int):
        near = F.col(f"_v{k}.v")
        return near if limit is None else F.when(F.abs(F.col("_i") - F.col(f"_v{k}._i")) <= limit, near)

    return out.withColumns({c: value(k) for k, c in enumerate(columns)}).select(*[F.col(quoted(c)) for c in df.columns])


def interpolate(df: DataFrame, columns: list[str], order_by: list[str] | str, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Inner nulls become points on the line between the values around them, by row position; spread as for fill_forward."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    known = {f"{side}{k}": F.when(F.col(quoted(c)).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(quoted(c)).cast("double").alias("v"))) for k, c in enumerate(columns) for side in ("_a", "_b")}
    if not (spread if spread is not None else not by or has_large_group(df, by)):
        base = Window.partitionBy(*[F.col(quoted(c)) for c in by]).orderBy(*sort_keys(order))
        out = df.withColumn("_n", F.row_number().over(base))
        numbered = Window.partitionBy(*[F.col(quoted(c)) for c in by])
        before, after = [numbered.orderBy(n).rowsBetween(Window.unboundedPreceding, 0) for n in (F.asc("_n"), F.desc("_n"))]
        out = out.withColumns({n: F.last(v, ignorenulls=True).over(before if n[1] == "a" else after) for n, v in known.items()})
    else:
        out = with_row_index(df, [*by, *order], "_n")
        out = carry(out, list(by), [F.col("_n")], {n: v for n, v in known.items() if n[1] == "a"})
        out = carry(out, list(by), [F.col("_n")], {n: v for n, v in known.items() if n[1] == "b"}, False)

    def value(k: int, c: str) -> Column:
        a, b = f"_a{k}", f"_b{k}"
        line = F.col(f"{a}.v") + (F.col(f"{b}.v") - F.col(f"{a}.v")) * (F.col("_n") - F.col(f"{a}.n")) / (F.col(f"{b}.n") - F.col(f"{a}.n"))
        return F.when(F.col(quoted(c)).isNotNull(), F.col(quoted(c)).cast("double")).otherwise(line)

    return out.withColumns({c: value(k, c) for k, c in enumerate(columns)}).select(*[F.col(quoted(c)) for c in df.columns])


def failure_threshold(df: DataFrame, failed: Column, keys: list[str], ts: str, minutes: int = 15, most: int = 5, spread: bool | None = None) -> DataFrame:
    """Each row with the failures of its keys in the minutes up to it, and whether they reach the most allowed."""
    out = rolling(df, ts, f"{minutes}m", {"n_failed": ("count", F.when(failed, 1))}, closed="both", by=keys, spread=spread)
    return out.withColumn("locked", F.col("n_failed") >= most)


def active_at(df: DataFrame, ts, active: str = "is_active", expires: str = "expires_at") -> DataFrame:
    """Rows that are active and not yet expired at a moment."""
    return df.where(F.col(quoted(active)) & (F.col(quoted(expires)) > F.lit(ts)))


def expire(df: DataFrame, ts, active: str = "is_active", expires: str = "expires_at") -> DataFrame:
    """All rows, those that have expired by a moment no longer active."""
    return df.withColumn(active, F.col(quoted(active)) & ~F.coalesce(F.col(quoted(expires)) <= F.lit(ts), F.lit(False)))
