"""Cell values: cleaning, typing and printing of text columns, hashes and keys, and column names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.types import quoted

_NUL = "\\u0000"
# Formats of moments in text, tried in this order.
_MOMENTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]", "yyyy-MM-dd")


def strip_nul_column(c: Column) -> Column:
    return F.regexp_replace(c, _NUL, "")


def strip_nul(df: DataFrame) -> DataFrame:
    """NUL characters out of all text columns."""
    return df.withColumns({f.name: strip_nul_column(F.col(quoted(f.name))) for f in df.schema if isinstance(f.dataType, T.StringType)})


def blank_to_null(c: Column) -> Column:
    plain = F.trim(strip_nul_column(c))
    return F.when(plain != "", plain)


def number(c: Column, precision: int = 38, scale: int = 9) -> Column:
    """Text with thousands commas to a decimal, null where it is none."""
    return F.regexp_replace(c, ",", "").try_cast(T.DecimalType(precision, scale))


def date(c: Column) -> Column:
    """The first ten characters as an ISO date, null where they are none."""
    return F.substring(c, 1, 10).try_cast("date")


def moment(c: Column) -> Column:
    """Text to a moment without a zone: an offset or Z at the end is left out, three formats are tried."""
    plain = F.regexp_replace(c, r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in _MOMENTS]).cast("timestamp_ntz")


def normalize(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text cells to NUMBER, DATE, TIMESTAMP or TEXT; blanks are null, and _bad lists the columns whose cell didn't fit."""
    made, bad = {}, []
    for name, kind in kinds.items():
        c = blank_to_null(F.col(quoted(name)))
        made[name] = {"NUMBER": number, "DATE": date, "TIMESTAMP": moment, "TEXT": lambda x: x}[kind](c)
        bad.append(F.when(c.isNotNull() & made[name].isNull(), F.lit(name)))
    return df.select(*[(made[c] if c in made else F.col(quoted(c))).alias(c) for c in df.columns], F.array_compact(F.array(*bad)).alias("_bad"))


def parse_typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text of a CRM export to int, double, decimal, boolean, date, datetime, time or text; empty is null, _bad lists misfits."""
    ways = {
        "int": lambda c: c.try_cast("long"),
        "double": lambda c: c.try_cast("double"),
        "decimal": lambda c: c.try_cast(T.DecimalType(38, 9)),
        "boolean": lambda c: F.lower(c) == "true",
        "date": date,
        "datetime": lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "Z$", "+00:00"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")), F.try_to_timestamp(c)),
        "time": lambda c: F.regexp_extract(c, r"^([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)Z?$", 1),
        "text": lambda c: c,
    }
    made, bad = {}, []
    for name, kind in kinds.items():
        c = F.when(F.col(quoted(name)) != "", F.col(quoted(name)))
        value = ways[kind](c)
        made[name] = F.when(value != "", value) if kind == "time" else value
        bad.append(F.when(c.isNotNull() & made[name].isNull(), F.lit(name)))
    return df.select(*[(made[c] if c in made else F.col(quoted(c))).alias(c) for c in df.columns], F.array_compact(F.array(*bad)).alias("_bad"))


def to_text(df: DataFrame) -> DataFrame:
    """All columns as text: null is empty, booleans in lower case, ISO dates and moments, nested values as JSON."""

    def one(f: T.StructField) -> Column:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[one(f) for f in df.schema])


def prepare_patch(df: DataFrame, clear: list[str] = ()) -> DataFrame:
    """Adds _set, the columns that a write changes: those with a value, and those in clear, which it sets to null."""
    marks = [F.when(F.lit(c in set(clear)) | F.col(quoted(c)).isNotNull(), F.lit(c)) for c in df.columns]
    return df.withColumn("_set", F.array_compact(F.array(*marks)))


def bool_flag(c: Column) -> Column:
    """true, 1, Y and the like to 1; false, 0, N to 0; anything else to null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "y"), F.lit(1)).when(text.isin("false", "0", "n"), F.lit(0))


def row_hash(*columns: Column) -> Column:
    """MD5 in upper-case hex over fields joined by character 30; null and empty are both character 0."""
    fields = [F.coalesce(F.when(c.cast("string") != "", c.cast("string")), F.lit("\x00")) for c in columns]
    return F.upper(F.md5(F.concat_ws("\x1e", *fields)))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def md5_key(c: Column, n: int = 8) -> Column:
    return F.substring(F.md5(c), 1, n)


def md5_digits(c: Column, n: int = 7) -> Column:
    """A number made of the first n hex digits of the MD5."""
    return F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")


def code_class(c: Column) -> Column:
    """The class of an HTTP status: 200 for 204."""
    return (F.floor(c / 100) * 100).cast("int")


def date_literal(text: str) -> Column:
    """ISO text as a moment in UTC without fractions of a second."""
    return F.date_trunc("second", F.to_timestamp(F.lit(text)))


# Words that name neither columns nor tables.
RESERVED = frozenset({
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "IS", "AS", "HAVING", "ORDER", "GROUP", "BY", "DISTINCT", "ALL", "ANY", "UNION", "INTERSECT", "MINUS", "EXCEPT",
    "CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME", "COMMENT", "TABLE", "VIEW", "INDEX", "SYNONYM", "SEQUENCE", "TRIGGER", "PROCEDURE", "FUNCTION", "PACKAGE", "TYPE", "CLUSTER",
    "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE", "MERGE",
    "JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "FULL", "CROSS", "NATURAL", "USING", "ON", "EXISTS", "WITH",
    "COMMIT", "ROLLBACK", "SAVEPOINT", "GRANT", "REVOKE", "START", "CONNECT", "RESOURCE", "PUBLIC", "IDENTIFIED",
    "NULL", "TRUE", "FALSE", "ROWID", "ROWNUM", "LEVEL",
})
_BORDER = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def snake_name(name: str, suffix: str = "_COL", reserved: frozenset = RESERVED, max_len: int = 128) -> str:
    """Words parted where a capital follows a small letter or a digit meets a letter, other characters to _, in upper case.

    A leading digit gets C_ before it and a reserved word the suffix (_TBL for tables), which a cut to
    max_len keeps; nothing at all is named like the suffix.
    """
    plain = re.sub(r"[^A-Za-z0-9_]+", "_", _BORDER.sub("_", name.strip())).strip("_").upper()
    if not plain:
        return suffix.strip("_")
    if plain[0].isdigit():
        plain = f"C_{plain}"
    if plain in reserved:
        plain += suffix
    if len(plain) <= max_len:
        return plain
    end = suffix if plain.endswith(suffix) else ""
    return plain[: max_len - len(end)].rstrip("_") + end


def snake_columns(df: DataFrame, reserved: frozenset = RESERVED, max_len: int = 128) -> DataFrame:
    names = [snake_name(c, reserved=reserved, max_len=max_len) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several columns would be named {twice}")
    return df.toDF(*names)


def enforce_not_null(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are all set, and the others with _error."""
    bad = reduce(lambda a, b: a | b, [F.col(quoted(c)).isNull() for c in columns])
    why = F.concat_ws(", ", *[F.when(F.col(quoted(c)).isNull(), F.lit(f"{c} is null")) for c in columns])
    return df.where(~bad), df.where(bad).withColumn("_error", why)


def enforce_lengths(df: DataFrame, limits: dict[str, int | tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Text no longer than n characters, numbers that fit (precision, scale); the others with _error."""
    marks = []
    for name, most in limits.items():
        c = F.col(quoted(name))
        if isinstance(most, tuple):
            marks.append(F.when(c.isNotNull() & c.try_cast(T.DecimalType(*most)).isNull(), F.lit(f"{name} does not fit {most[0]},{most[1]}")))
        else:
            marks.append(F.when(F.char_length(c) > most, F.lit(f"{name} is longer than {most}")))
    why = F.concat_ws(", ", *marks)
    return df.where(why == ""), df.where(why != "").withColumn("_error", why)
