"""Long to wide and back, transposes, lists and JSON to rows, nulls, and SQL over named frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import FUNCTIONS
from millrace.operators.windows import fill_forward
from millrace.types import promote_types, quoted


#: New columns that a pivot may make; more are an error, since each is a column of the plan.
MOST_PIVOTED = 10_000


def pivot(df: DataFrame, on: list[str] | str, index: list[str] | str, values: list[str] | str, agg: str = "first", separator: str = "_", sort_columns: bool = True, order_by: str | None = None, most_columns: int = MOST_PIVOTED) -> DataFrame:
    """One column for each value of `on` (several joined by the separator) and each values column; more than most_columns are an error."""
    on, index, values = ([x] if isinstance(x, str) else list(x) for x in (on, index, values))
    name = F.concat_ws(separator, *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("null")) for c in on])
    keyed = df.withColumn("_on", name)
    found = [r[0] for r in keyed.select("_on").distinct().limit(most_columns // len(values) + 1).collect()]  # column names of the result
    if len(found) * len(values) > most_columns:
        raise ValueError(f"the pivot would make more than {most_columns} columns")
    if sort_columns:
        found.sort()
    order = None if order_by is None else F.col(quoted(order_by))
    if agg == "first" and order is None:
        make = lambda c: F.min(c)  # noqa: E731  one value a cell, or the least, so that results don't depend on row order
    else:
        make = lambda c: FUNCTIONS[agg](c, order)
    single = len(values) == 1
    cells = [make(F.when(F.col("_on") == v, F.col(quoted(c)))).alias(v if single else f"{c}{separator}{v}") for c in values for v in found]
    return keyed.groupBy(*[F.col(quoted(c)) for c in index]).agg(*cells)


def unpivot(df: DataFrame, on: list[str] | str | None, index: list[str] | str, variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """One row for each row and column of `on`, nulls kept; values cast to one type that holds all."""
    index = [index] if isinstance(index, str) else list(index)
    on = [c for c in df.columns if c not in index] if on is None else [on] if isinstance(on, str) else list(on)
    kind = df.schema[on[0]].dataType
    for c in on[1:]:
        kind = promote_types(kind, df.schema[c].dataType)
    ready = df.select(*[F.col(quoted(c)) for c in index], *[F.col(quoted(c)).cast(kind).alias(c) for c in on])
    return ready.unpivot([F.col(quoted(c)) for c in index], [F.col(quoted(c)) for c in on], variable_name, value_name)


def transpose(df: DataFrame, header_col: str) -> DataFrame:
    """Rows to columns, named by a column; for small tables."""
    return df.transpose(F.col(quoted(header_col)))


def explode(df: DataFrame, *columns: str) -> DataFrame:
    """List columns to rows, several in step; a null or empty list gives a row of nulls."""
    if len(columns) == 1:
        return df.withColumn(columns[0], F.explode_outer(F.col(quoted(columns[0]))))
    zipped = df.withColumn("_z", F.explode_outer(F.arrays_zip(*[F.col(quoted(c)) for c in columns])))
    return zipped.withColumns({c: F.col(f"_z.{quoted(c)}") for c in columns}).drop("_z")


def explode_json(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects in each row to rows with typed columns; other columns stay."""
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    rest = [F.col(quoted(c)) for c in df.columns if c != column]
    rows = df.select(*rest, F.explode(F.from_json(F.col(quoted(column)), T.ArrayType(kind))).alias("_r"))
    return rows.select(*rest, "_r.*")


def to_json_rows(df: DataFrame, name: str = "json", pretty: bool = False) -> DataFrame:
    """Each row as one JSON document, nulls written out."""
    return df.select(F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias(name))


def fill_null(df: DataFrame, value=None, strategy: str | None = None, columns: list[str] | None = None, order_by: list[str] | str | None = None, by: list[str] = (), limit: int | None = None) -> DataFrame:
    """Nulls to a value (in columns of its sort) or by strategy: forward, backward, min, max, mean, zero, one."""
    if strategy is None:
        return df.fillna(value, subset=columns)
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if strategy in ("zero", "one"):
        return df.fillna({"zero": 0, "one": 1}[strategy], subset=[c for c in columns or numbers if c in numbers])
    if strategy in ("forward", "backward"):
        if order_by is None:
            raise ValueError("forward and backward need an order")
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        return fill_forward(df, columns or [c for c in df.columns if c not in order and c not in by], order, by, limit, strategy == "backward")
    chosen = columns or numbers
    found = df.agg(*[{"min": F.min, "max": F.max, "mean": F.avg}[strategy](F.col(quoted(c))).alias(c) for c in chosen]).first()  # one row
    return df.withColumns({c: F.coalesce(F.col(quoted(c)), F.lit(found[c])) for c in chosen if found[c] is not None})


def fill_nan(df: DataFrame, value: float | None, columns: list[str] | None = None) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(F.isnan(F.col(quoted(c))), F.lit(value)).otherwise(F.col(quoted(c))) for c in floats})


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def sql(df: DataFrame, text: str, name: str = "frame") -> DataFrame:
    """A statement over one frame, under a name."""
    return sql_multi(text, {name: df})


def sql_multi(text: str, frames: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """A statement over several named frames, with named parameters."""
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(_braced(text, list(frames)), args=args, **frames)


def _braced(text: str, names: list[str]) -> str:
    """Frame names in a statement put in braces, as the session's formatter reads them."""
    import re

    return re.sub(r"(?<![\w.{'\"])(" + "|".join(map(re.escape, names)) + r")(?![\w}])", lambda m: "{" + m[1] + "}", text)


def pipe(df: DataFrame, fn: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """fn(df, ...), which must return a frame."""
    out = fn(df, *args, **kwargs)
    if not isinstance(out, DataFrame):
        raise TypeError(f"the function returned {type(out).__name__}, not a frame")
    return out


def map_values(column: Column, fn: Callable, kind: str) -> Column:
    """A Python function over the values of a column, in Arrow batches; built-in functions are faster where they exist."""
    import pandas as pd

    def batch(values):
        return values.map(fn, na_action="ignore")

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)(column)
