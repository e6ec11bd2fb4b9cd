"""A query object to one lazy DataFrame; everything after that is Catalyst's."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Catalog, Column, Field, Group, Operation
from millrace.types import quoted

Resolve = Callable[[Column], SparkColumn]


def literal(value) -> SparkColumn:
    """A bound literal; moments with a zone are taken to UTC, without fractions of a second."""
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)
    return F.lit(value)


def predicate(op: Operation, column: Resolve, field: Callable[[Field], SparkColumn] | None = None) -> SparkColumn:
    left = column(op.left)

    def value(x) -> SparkColumn:
        if isinstance(x, Column):
            return column(x)
        if isinstance(x, Field):
            if field is None:
                raise ValueError(f"no incoming rows for field {x.name!r}")
            return field(x)
        return literal(x)

    kind, right = op.operator, op.right
    if kind == "IS NULL":
        return left.isNull()
    if kind == "IS NOT NULL":
        return left.isNotNull()
    if kind in ("IN", "NOT IN"):
        if not isinstance(right, (list, tuple)) or not right:
            return F.lit(kind == "NOT IN")
        found = left.isin(*[value(x) for x in right])
        return ~found if kind == "NOT IN" else found
    if kind in ("BETWEEN", "NOT BETWEEN"):
        found = left.between(value(right[0]), value(right[1]))
        return ~found if kind == "NOT BETWEEN" else found
    if kind in ("LIKE", "NOT LIKE"):
        found = F.like(left, value(right))
        return ~found if kind == "NOT LIKE" else found
    other = value(right)
    return {"=": left == other, "!=": left != other, ">": left > other, "<": left < other, ">=": left >= other, "<=": left <= other}[kind]


def condition(items: list, column: Resolve, field=None) -> SparkColumn | None:
    """The AND of operations and groups; None where nothing is left of them."""
    parts = []
    for item in items:
        if isinstance(item, Group):
            inner = [x for x in (condition([y], column, field) for y in item.items) if x is not None]
            if inner:
                joined = reduce((lambda a, b: a | b) if item.condition == "OR" else (lambda a, b: a & b), inner)
                parts.append(~joined if item.condition == "NOT" else joined)
        else:
            parts.append(predicate(item, column, field))
    return reduce(lambda a, b: a & b, parts) if parts else None


def _bind(catalog: Catalog, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each entity's frame, its columns named entity.column; Entity.Col and Col both name a source column, absent ones are skipped."""
    bound = {}
    for e in catalog.entities:
        name = e.alias or e.name
        source = tables[name] if name in tables else tables[e.name]
        bare = {(c.split(".", 1)[1] if c.startswith((f"{e.name}.", f"{name}.")) else c): c for c in source.columns}
        wanted = {c.name for c in e.columns} or set(bare)
        for j in catalog.joins:
            wanted |= {x.name for x in (j.left, j.right) if x.entity == name}
        wanted |= {x.name for x in _columns(catalog.filters) if x.entity == name} | {s.column.name for s in catalog.sorts if s.column.entity == name}
        bound[name] = source.select(*[F.col(quoted(bare[c])).alias(f"{name}.{c}") for c in bare if c in wanted])
    return bound


def _columns(items: list) -> list[Column]:
    out = []
    for x in items:
        if isinstance(x, Group):
            out += _columns(x.items)
        elif isinstance(x, Operation):
            values = x.right if isinstance(x.right, (list, tuple)) else [x.right]
            out += [x.left, *(v for v in values if isinstance(v, Column))]
    return out


def _joined(catalog: Catalog, bound: dict[str, DataFrame]) -> DataFrame:
    """Entities joined from the first that is on no right side; pairs of the same two entities make one compound key."""
    rights = {j.right.entity for j in catalog.joins}
    roots = [n for n in bound if n not in rights]
    if not catalog.joins:
        if len(bound) == 1:
            return next(iter(bound.values()))
        raise ValueError("entities without joins: give one, or several of one schema")
    if not roots:
        raise ValueError("the joins form a circle")
    if len(roots) > 1:
        raise ValueError(f"entities {roots[1:]} are not joined")
    merged: dict[tuple[str, str], list] = {}
    for j in catalog.joins:
        merged.setdefault((j.left.entity, j.right.entity), []).append(j)
    out, inside, todo = bound[roots[0]], {roots[0]}, dict(merged)
    while todo:
        key = next((k for k in todo if k[0] in inside and k[1] not in inside), None)
        if key is None:
            raise ValueError(f"joins {sorted(todo)} can't be reached from {roots[0]}")
        pairs = todo.pop(key)
        kinds = {j.type for j in pairs}
        if len(kinds) > 1:
            raise ValueError(f"joins of {key} have different types")
        right = bound[key[1]]
        on = [out[quoted(f"{j.left.entity}.{j.left.name}")] == right[quoted(f"{j.right.entity}.{j.right.name}")] for j in pairs]
        out = out.join(right, on, {"INNER": "inner", "LEFT": "left", "OUTER": "full"}[kinds.pop()])
        inside.add(key[1])
    return out


def to_dataframe(catalog: Catalog, tables: dict[str, DataFrame], rows: DataFrame | None = None) -> DataFrame:
    """Joins, then filters, then sorts and limits, then the output names.

    Filters stand above the joins and Catalyst pushes them as far as an outer join allows. Null order
    is last unless a sort says otherwise; a limit of 0 gives no rows, None all.
    """
    bound = _bind(catalog, tables)
    if not catalog.joins and len(bound) > 1:
        schemas = {tuple(c.split(".", 1)[1] for c in f.columns) for f in bound.values()}
        if len(schemas) > 1:
            raise ValueError("entities without joins must have one schema")
        if catalog.filters or catalog.sorts:
            raise ValueError("filters and sorts over several entities without joins are ambiguous")
        out = reduce(DataFrame.union, [f.toDF(*[c.split(".", 1)[1] for c in f.columns]) for f in bound.values()])
    else:
        out = _joined(catalog, bound)

        def column(c: Column) -> SparkColumn:
            return F.col(quoted(f"{c.entity}.{c.name}"))

        where = condition(catalog.filters, column)
        if where is not None:
            out = out.where(where)
        if catalog.sorts:
            keys = []
            for s in catalog.sorts:
                c = column(s.column)
                down = s.direction.upper() == "DESC"
                keys.append((c.desc_nulls_first() if down else c.asc_nulls_first()) if s.nulls_first else (c.desc_nulls_last() if down else c.asc_nulls_last()))
            out = out.orderBy(*keys)
        chosen = [(e.alias or e.name, c) for e in catalog.entities for c in e.columns]
        if chosen:
            names = catalog.output_names()
            have = set(out.columns)
            out = out.select(*[F.col(quoted(f"{n}.{c.name}")).alias(names[n, c.name]) for n, c in chosen if f"{n}.{c.name}" in have])
        else:
            bare: dict[str, int] = {}
            for c in out.columns:
                bare[c.split(".", 1)[1]] = bare.get(c.split(".", 1)[1], 0) + 1
            out = out.toDF(*[c.split(".", 1)[1] if bare[c.split(".", 1)[1]] == 1 else c for c in out.columns])
    if catalog.offset:
        out = out.offset(catalog.offset)
    return out if catalog.limit is None else out.limit(catalog.limit)
