"""Joins of intervals that overlap, of points and intervals, and within a band, by dyadic bins and without comparing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialize
from millrace.types import quoted

#: The level of a point, below that of any interval.
POINT = -2000


def _place(c: Column, kind: T.DataType) -> Column:
    """A number in the order of the values: equal or rounded alike, never swapped."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp_ltz")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"no ranges over {kind.simpleString()}")
    return c.cast("double") + 0.0  # so that there is one zero


def _levels(df: DataFrame) -> list[int]:
    """The levels in use: exponents of doubles, so some two thousand at most."""
    return sorted(r["_level"] for r in df.where("_level is not null").select("_level").distinct().collect())


def _binned(df: DataFrame, side: str, kept: list[str], own: list[int], others: list[int], salts: int) -> DataFrame:
    """The kept columns in a row for each bin and role in which it meets rows of the other side, if any there can be of its level.

    Two rows meet at the higher of their levels, in bins as wide as the longer one at least, so each is in two bins at
    most. Role 0: both are of that level; 1: the left one is, and the right one is of a lower level; 2: the other way round.
    _place is level and role in one number, _first whether the bin is that of the row's beginning.
    """
    mine, theirs = (1, 2) if side == "l" else (2, 1)
    level, shared = F.col("_level"), sorted(set(own) & set(others))

    def whole(x: Column) -> Column:
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # larger doubles are whole

    def meeting(role: int, k: Column) -> Column:
        width = F.pow(F.lit(2.0), k)
        first = F.when(k == POINT, F.col("_low")).otherwise(whole(F.col("_low") / width))
        last = F.when(k == POINT, F.col("_low")).otherwise(whole(F.col("_high") / width))
        return F.struct((k * 3 + role).cast("int").alias("place"), first.alias("first"), last.alias("last"))

    def of_some(levels: list[int], entry: Column) -> list[Column]:
        return [] if not levels else [entry] if len(levels) == len(own) else [F.when(level.isin(levels), entry)]

    entries = of_some(shared, meeting(0, level)) + of_some([k for k in own if others and POINT < k > min(others)], meeting(mine, level))
    for k in others:
        entries += of_some([x for x in own if x < k], meeting(theirs, F.lit(k)))
    if not entries:
        entries = [meeting(0, level)]  # meets nothing
    out = df.withColumn("_m", entries[0] if len(entries) == 1 else F.explode(F.array(*entries))).where("_m IS NOT NULL")
    out = out.withColumn("_bin", F.explode(F.array_distinct(F.array("_m.first", "_m.last"))) if own[-1:] > [POINT] else F.col("_m.first"))
    salt = F.lit(0)
    if salts > 1:
        role = F.pmod(F.col("_m.place"), F.lit(3))
        alone = F.pmod(F.xxhash64("_low", "_high", "_id"), F.lit(salts)).cast("int")
        salt = F.explode(F.when(role == mine, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.when(role == theirs, alone).otherwise(F.lit(0)))))
    first = F.col("_bin") == F.col("_m.first") if own[-1:] > [POINT] else F.lit(True)
    return out.select(*kept, *[c.alias(f"{side}{n}") for n, c in (("_place", F.col("_m.place")), ("_bin", F.col("_bin")), ("_first", first), ("_salt", salt))])


#: Pairs a row of the two sides of a key below which all its pairs are compared, as that costs less than bins.
CHEAP = 64


def join_overlap(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[str] | str = (), closed: bool = True,
    how: str = "inner", suffix: str = "_right", salts: int = 1,
) -> DataFrame:
    """Pairs whose spans (first and last column, the same one for points) overlap, within equal `by` keys.

    closed: spans that only touch overlap too. how: inner, left, semi or anti. Spans with a null, or a NaN, or
    whose end is before their beginning, and null keys, match nothing.

    Every span has the level of its length: the least power of two that isn't smaller. Rows meet by an equality on
    bins of the higher level of the two, and every pair in one bin only, that of the later beginning, so nothing is
    compared twice and long spans aren't cut into many pieces; the columns themselves decide at last. A
    bin with many rows of lower levels can be dealt out under salts, which copies the few long spans instead.
    Keys are counted first: those of few rows (CHEAP) are joined as they are, without bins.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"unknown join {how!r}")
    by = [by] if isinstance(by, str) else list(by)

    def spans(df: DataFrame, span: tuple[str, str], side: str) -> tuple[DataFrame, dict[str, str]]:
        place = {c: f"{side}{i}" for i, c in enumerate(df.columns)}
        low, high = (F.col(place[c]) for c in span)
        kinds = [df.schema[c].dataType for c in span]
        out = df.select(*[F.col(quoted(c)).alias(n) for c, n in place.items()], F.monotonically_increasing_id().alias("_id"))
        if how != "inner" and side == "l":
            out = materialize(out, "spans")  # its ids are joined once more
        out = out.withColumns({"_low": _place(low, kinds[0]), "_high": _place(high, kinds[1])})
        size = F.col("_high") - F.col("_low")
        sound = (low <= high) & ~F.isnan("_low") & ~F.isnan("_high")
        for c in by:
            sound = sound & F.col(place[c]).isNotNull()
        power = F.ceil(F.log2(size)).cast("int")
        power = power + (F.pow(F.lit(2.0), power) < size).cast("int")  # a logarithm may be rounded down
        return out.withColumn("_level", F.when(sound, F.when(size > 0, power).otherwise(F.lit(POINT)))), place

    (a, ours), (b, theirs) = spans(left, left_span, "l"), spans(right, right_span, "r")
    l, r = a.where("_level IS NOT NULL"), b.where("_level IS NOT NULL")  # noqa: E741
    (l_from, l_to), (r_from, r_to) = [ours[c] for c in left_span], [theirs[c] for c in right_span]
    keys = [F.col(ours[c]) == F.col(theirs[c]) for c in by]
    touch = [F.col(l_from) <= F.col(r_to), F.col(r_from) <= F.col(l_to)] if closed else [F.col(l_from) < F.col(r_to), F.col(r_from) < F.col(l_to)]
    kept = [*ours.values(), "l_id"] if how != "inner" else list(ours.values())

    def plain(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
        return l.withColumn("l_id", F.col("_id")).select(*kept).join(r.select(*theirs.values()), [*keys, *touch])

    def by_bins(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
        one, two = _levels(l), _levels(r)
        l = _binned(l.withColumn("l_id", F.col("_id")), "l", kept, one, two, salts)  # noqa: E741
        r = _binned(r, "r", list(theirs.values()), two, one, salts)
        same = [F.col(f"l{c}") == F.col(f"r{c}") for c in ("_place", "_bin", "_salt")]
        return l.join(r, [*keys, *same, *touch, F.col("l_first") | F.col("r_first")])

    if by:
        names = [f"_b{i}" for i in range(len(by))]

        def counted(df: DataFrame, place: dict[str, str], name: str) -> DataFrame:
            return df.groupBy(*[F.col(place[c]).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.count(F.lit(1)).cast("double").alias(name))

        many = counted(l, ours, "_n").join(counted(r, theirs, "_m"), names).where((F.col("_n") * F.col("_m")) > CHEAP * (F.col("_n") + F.col("_m")))
        many = materialize(many.select(*names), "keys")
    if by and many.isEmpty():
        pairs = plain(l, r)
    elif by:
        few, dense = ([d.join(many, [F.col(place[c]) == F.col(n) for c, n in zip(by, names, strict=True)], kind) for d, place in ((l, ours), (r, theirs))] for kind in ("left_anti", "left_semi"))
        pairs = plain(*few).select(*kept, *theirs.values()).unionByName(by_bins(*dense).select(*kept, *theirs.values()))
    else:
        pairs = by_bins(l, r)
    clash = set(left.columns)
    own = [F.col(n).alias(c) for c, n in ours.items()]
    other = [F.col(n).alias(c + suffix if c in clash else c) for c, n in theirs.items()]
    if how == "inner":
        return pairs.select(*own, *other)
    if how in ("semi", "anti"):
        return a.join(pairs.select(F.col("l_id").alias("_id")).distinct(), "_id", f"left_{how}").select(*own)
    return a.join(pairs.select(F.col("l_id").alias("_id"), *theirs.values()), "_id", "left").select(*own, *other)


def join_band(left: DataFrame, right: DataFrame, left_on: str, right_on: str, below: Column | float, above: Column | float, by: list[str] | str = (), how: str = "inner", suffix: str = "_right", salts: int = 1) -> DataFrame:
    """Pairs with right_on - below <= left_on <= right_on + above. Intervals for times, numbers else."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (below, above))
    at = F.col(quoted(right_on))
    out = join_overlap(left, right.withColumns({"_band_low": at - low, "_band_high": at + high}), (left_on, left_on), ("_band_low", "_band_high"), by, True, how, suffix, salts)
    return out.drop("_band_low", "_band_high")
