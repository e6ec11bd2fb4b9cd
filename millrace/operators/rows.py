"""Row numbers, positions and order. Positional operators take an explicit order, since Spark rows have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialize
from millrace.types import quoted


def sort_keys(by: list[str] | str, descending: bool | list[bool] = False, nulls_last: bool | list[bool] = True) -> list[Column]:
    by = [by] if isinstance(by, str) else list(by)
    down = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    last = [nulls_last] * len(by) if isinstance(nulls_last, bool) else list(nulls_last)
    if not len(by) == len(down) == len(last):
        raise ValueError("one direction and null order for each key")
    return [getattr(F.col(quoted(c)), ("desc" if d else "asc") + ("_nulls_last" if n else "_nulls_first"))() for c, d, n in zip(by, down, last, strict=True)]


def with_row_index(df: DataFrame, order_by: list[str] | str, name: str = "index", offset: int = 0, descending: bool | list[bool] = False, nulls_last: bool | list[bool] = True) -> DataFrame:
    """Consecutive numbers in an order, without gathering all rows in one task.

    Rows are range-partitioned by the order and numbered inside each partition; the numbers of rows in
    earlier partitions, one small row a partition, are added. The partitioned rows are written once,
    so both passes see the same partitions. Ties are numbered in an arbitrary but single order.
    """
    keys = sort_keys(order_by, descending, nulls_last)
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    # rows that tie in the order are dealt out by number
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").withColumn("_part", F.spark_partition_id()).drop("_tie") if keys else df.withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "index")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row a partition
    starts, total = [], offset
    for row in sizes:
        starts.append((row["_part"], total))
        total += row["n"]
    base = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    window = Window.partitionBy("_part").orderBy(*keys)
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_start") + F.row_number().over(window) - 1).select(name, *[F.col(quoted(c)) for c in df.columns])


def running_totals(df: DataFrame, order_by: list[str] | str, sums: dict[str, Column]) -> DataFrame:
    """For each name the total of its values in all earlier rows of an order (nulls count as 0), without one task for all rows.

    As in with_row_index, rows are range-partitioned and written once, ties in one arbitrary order, and totals of earlier partitions
    are added. The names must be new.
    """
    if taken := [c for c in sums if c in df.columns]:
        raise ValueError(f"columns {taken} exist")
    keys = sort_keys(order_by)
    valued = df.withColumns({f"_value_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()}).withColumn("_tie", F.monotonically_increasing_id())
    placed = materialize(valued.repartitionByRange(*keys, "_tie").withColumn("_part", F.spark_partition_id()), "totals")
    parts = placed.groupBy("_part").agg(*[F.sum(f"_value_{n}").alias(n) for n in sums]).orderBy("_part").collect()  # one row a partition
    starts, before = [], dict.fromkeys(sums, 0)
    for row in parts:
        starts.append((row["_part"], *before.values()))
        before = {n: v + row[n] for n, v in before.items()}
    base = df.sparkSession.createDataFrame(starts, ", ".join(["_part int"] + [f"{quoted('_start_' + n)} long" for n in sums]))
    window = Window.partitionBy("_part").orderBy(*keys, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    totals = {n: F.col(quoted(f"_start_{n}")) + F.coalesce(F.sum(f"_value_{n}").over(window), F.lit(0)) for n in sums}
    return placed.join(F.broadcast(base), "_part").withColumns(totals).select(*[F.col(quoted(c)) for c in [*df.columns, *sums]])


def gather_every(df: DataFrame, n: int, order_by: list[str] | str, offset: int = 0) -> DataFrame:
    """Every n-th row from an offset."""
    return with_row_index(df, order_by, "_index").where((F.col("_index") >= offset) & ((F.col("_index") - offset) % n == 0)).drop("_index")


def sort(df: DataFrame, by: list[str] | str, descending: bool | list[bool] = False, nulls_last: bool | list[bool] = False) -> DataFrame:
    """Sorted rows; nulls come first both ways unless nulls_last."""
    return df.orderBy(*sort_keys(by, descending, nulls_last))


def sort_by(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sorted by (column, "ascending" | "descending") with nulls at the end."""
    return df.orderBy(*sort_keys([k for k, _ in keys], [d.startswith("desc") for _, d in keys], True))


def top_k(df: DataFrame, k: int, by: list[str] | str) -> DataFrame:
    return df.orderBy(*sort_keys(by, True, True)).limit(k)


def bottom_k(df: DataFrame, k: int, by: list[str] | str) -> DataFrame:
    return df.orderBy(*sort_keys(by, False, True)).limit(k)


def head(df: DataFrame, n: int = 5, order_by: list[str] | str | None = None) -> DataFrame:
    return (df.orderBy(*sort_keys(order_by)) if order_by else df).limit(n)


#: Rows that a sort may gather in one partition; slices and tails beyond it are taken by row numbers.
GATHERED = 100_000


def _numbered_slice(df: DataFrame, first: int, end: int | None, order_by: list[str] | str) -> DataFrame:
    """Rows by their numbers in an order, sorted by them: ranges, counts and a filter, no partition for all of them."""
    at = F.col("_slice")
    kept = with_row_index(df, order_by, "_slice").where(at >= first if end is None else (at >= first) & (at < end))
    return kept.orderBy("_slice").drop("_slice")


def tail(df: DataFrame, n: int, order_by: list[str] | str) -> DataFrame:
    """The last n rows, in order."""
    by = [order_by] if isinstance(order_by, str) else order_by
    if n > GATHERED:
        return _numbered_slice(df, max(0, df.count() - n), None, by)
    return df.orderBy(*sort_keys(by, True, False)).limit(n).orderBy(*sort_keys(by))


def slice_rows(df: DataFrame, offset: int, length: int | None, order_by: list[str] | str) -> DataFrame:
    if length is None or offset + length > GATHERED:
        return _numbered_slice(df, offset, None if length is None else offset + length, order_by)
    return df.orderBy(*sort_keys(order_by)).offset(offset).limit(length)


def limit(df: DataFrame, n: int, offset: int = 0, order_by: list[str] | str | None = None) -> DataFrame:
    if order_by and offset + n > GATHERED:
        return _numbered_slice(df, offset, offset + n, order_by)
    return (df.orderBy(*sort_keys(order_by)) if order_by else df).offset(offset).limit(n)


def reverse(df: DataFrame, order_by: list[str] | str) -> DataFrame:
    return df.orderBy(*sort_keys(order_by, True, False))


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, replace: bool = False, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """A fraction of rows, or exactly n; n with replacement draws row numbers and joins them."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    if fraction is not None:
        out = df.sample(withReplacement=replace, fraction=fraction, seed=seed)
    elif not replace:
        return df.orderBy(F.rand(seed)).limit(n)
    else:
        total = df.count()
        if not total:
            return df
        numbered = with_row_index(df, df.columns, "_index")
        drawn = df.sparkSession.range(n).select(F.floor(F.rand(seed) * total).alias("_index"))
        out = drawn.join(numbered, "_index").drop("_index")
    return out.orderBy(F.rand(seed + 1)) if shuffle else out


def hstack(a: DataFrame, b: DataFrame, order_a: list[str] | str, order_b: list[str] | str) -> DataFrame:
    """Columns of both side by side, row by row in their orders; the row counts must be equal."""
    if set(a.columns) & set(b.columns):
        raise ValueError(f"columns on both sides: {sorted(set(a.columns) & set(b.columns))}")
    left, right = with_row_index(a, order_a, "_index"), with_row_index(b, order_b, "_index")
    sizes = [x.agg(F.count(F.lit(1))).first()[0] for x in (left, right)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"row counts differ: {sizes[0]} and {sizes[1]}")
    return left.join(right, "_index").drop("_index")


def unique(df: DataFrame, subset: list[str] | None = None, keep: str = "any", order_by: list[str] | str | None = None) -> DataFrame:
    """Distinct rows by subset: any, first or last in an order, or none of those that repeat.

    Each is an aggregate with a partial step before the shuffle, so a key of any size is one row a task.
    A null in the order comes last.
    """
    keys = subset or df.columns
    if keep == "any":
        return df.dropDuplicates(keys)
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    if keep == "none":
        picked, alone = F.any_value(row), F.count(F.lit(1)) == 1
    elif keep in ("first", "last"):
        if order_by is None:
            raise ValueError("first and last need an order")
        place = F.struct(*[x for c in ([order_by] if isinstance(order_by, str) else order_by) for x in (F.col(quoted(c)).isNull(), F.col(quoted(c)))])
        picked, alone = (F.min_by if keep == "first" else F.max_by)(row, place), F.lit(True)
    else:
        raise ValueError(f"unknown keep {keep!r}")
    found = df.groupBy(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(picked.alias("_row"), alone.alias("_alone"))
    return found.where("_alone").select("_row.*")


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str] | str) -> DataFrame:
    return unique(df, keys, "last", order_by)


def concat(*frames: DataFrame) -> DataFrame:
    """UNION ALL of frames of one schema."""
    out = frames[0]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema] != [(f.name, f.dataType) for f in out.schema]:
            raise ValueError("schemas differ")
        out = out.union(other)
    return out


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and types, and the same rows as often."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        return False
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def select(df: DataFrame, columns: list[str | int]) -> DataFrame:
    return df.select(*[F.col(quoted(df.columns[c] if isinstance(c, int) else c)) for c in columns])


def select_expr(df: DataFrame, *exprs: Column, **named: Column) -> DataFrame:
    return df.select(*exprs, *[e.alias(n) for n, e in named.items()])


def with_columns(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def filter_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of df that are in names, in the order of df."""
    wanted = set(names)
    return df.select(*[F.col(quoted(c)) for c in df.columns if c in wanted])


def cast(df: DataFrame, kinds: dict[str, T.DataType | str] | T.StructType, strict: bool = True) -> DataFrame:
    """Columns cast to types; strict: a bad value is an error, else it becomes null."""
    wanted = {f.name: f.dataType for f in kinds} if isinstance(kinds, T.StructType) else kinds

    def one(name: str) -> Column:
        c = F.col(quoted(name))
        return ((c.cast if strict else c.try_cast)(wanted[name]) if name in wanted else c).alias(name)

    return df.select(*[one(c) for c in df.columns])


#: Rows of one key that one task should walk at most.
LARGE_GROUP = 5_000_000


def has_large_group(df: DataFrame, by: list[str], most: int | None = None) -> bool:
    """Whether a key has more rows than one task should walk: counted with a partial step, one number reaches the driver."""
    largest = df.groupBy(*[F.col(quoted(c)) for c in by]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return largest > (LARGE_GROUP if most is None else most)


def carry(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], onward: bool = True) -> DataFrame:
    """Adds for each value its last non-null one at or before the row (onward false: its first one at or after it), per key.

    Rows are range-partitioned by key and order, so a key of any size, or none at all, is spread over
    many tasks. Each task carries values along its own rows; what it would have got from the parts of its
    key before it comes from a small table with one row for each part that shares a key with another.
    """
    keys = [F.col(quoted(c)) for c in by]
    placed = df.repartitionByRange(*keys, *order) if keys or order else df
    placed = materialize(placed.withColumn("_part", F.spark_partition_id()), "carry")
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    placed = placed.withColumn("_at", F.row_number().over(local))
    # backward is forward over the opposite order: a frame up to the last row would be computed anew for every row
    window = Window.partitionBy("_part", *keys).orderBy(F.asc("_at") if onward else F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_own_{n}": F.last(v, ignorenulls=True).over(window) for n, v in values.items()})
    # the parts whose key goes on in another one: at most two for each border between parts
    parts = placed.groupBy("_part", *keys).agg(*[(F.max_by if onward else F.min_by)(v, F.when(v.isNotNull(), F.col("_at"))).alias(f"_end_{n}") for n, v in values.items()])
    spread = Window.partitionBy(*keys)
    parts = parts.withColumn("_parts", F.count(F.lit(1)).over(spread)) if keys else parts.withColumn("_parts", F.lit(2))
    many = parts.where("_parts > 1")
    before = spread.orderBy(F.asc("_part") if onward else F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = many.select("_part", *[k.alias(f"_k{i}") for i, k in enumerate(keys)], *[F.last(F.col(f"_end_{n}"), ignorenulls=True).over(before).alias(f"_in_{n}") for n in values])
    on = [out["_part"] == ends["_part"], *[k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    joined = out.join(ends.withColumnRenamed("_part", "_p"), [F.col("_part") == F.col("_p"), *on[1:]], "left")
    return joined.select(*[F.col(quoted(c)) for c in df.columns], *[F.coalesce(F.col(f"_own_{n}"), F.col(f"_in_{n}")).alias(n) for n in values])
