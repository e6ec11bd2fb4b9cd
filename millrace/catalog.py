"""The query object: entities with columns, joins, nested filters, sorts, limits and assignments, as JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.types import spark_type, type_id

OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "IN", "NOT IN", "LIKE", "NOT LIKE", "BETWEEN", "NOT BETWEEN", "IS NULL", "IS NOT NULL")


@dataclass
class Locator:
    """Where rows come from: a named source with a table, or a file with its format."""

    source: str = ""
    namespace: str = ""
    entity: str = ""
    is_file: bool = False
    options: dict = field(default_factory=dict)


@dataclass
class Column:
    entity: str
    name: str
    alias: str | None = None
    type: str | None = None
    meta: dict = field(default_factory=dict)
    primary_key: bool = False
    unique: bool = False
    foreign_key: str | None = None
    nullable: bool = True
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    timezone: str | None = None
    values: list | None = None
    ordinal: int | None = None
    locator: Locator | None = None

    def spark_type(self) -> T.DataType | None:
        return None if self.type is None else spark_type(self.type, self.precision, self.scale, self.timezone, self.meta)


@dataclass
class Field:
    """An operand whose value comes from the incoming rows."""

    name: str


@dataclass
class Entity:
    name: str
    columns: list[Column] = field(default_factory=list)
    alias: str | None = None
    locator: Locator = field(default_factory=Locator)
    properties: dict = field(default_factory=dict)


@dataclass
class Operation:
    left: Column
    operator: str
    right: Any = None

    def __post_init__(self):
        self.operator = "!=" if self.operator == "<>" else self.operator.upper()
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if "BETWEEN" in self.operator and not (isinstance(self.right, (list, tuple)) and len(self.right) == 2):
            raise ValueError(f"{self.operator} needs a list of two values")


@dataclass
class Group:
    """AND, OR or NOT over operations and groups; NOT is that of all items together."""

    condition: str
    items: list = field(default_factory=list)

    def __post_init__(self):
        self.condition = self.condition.upper()
        if self.condition not in ("AND", "OR", "NOT"):
            raise ValueError(f"unknown condition {self.condition!r}")


@dataclass
class Join:
    left: Column
    right: Column
    type: str = "INNER"

    def __post_init__(self):
        self.type = self.type.upper()
        if self.type not in ("INNER", "LEFT", "OUTER"):
            raise ValueError(f"unknown join type {self.type!r}")


@dataclass
class Sort:
    column: Column
    direction: str = "ASC"
    nulls_first: bool | None = None


@dataclass
class Assignment:
    column: Column
    value: Any = None


@dataclass
class Catalog:
    entities: list[Entity] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    filters: list = field(default_factory=list)
    sorts: list[Sort] = field(default_factory=list)
    assignments: list[Assignment] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    name: str | None = None

    def entity(self, name: str) -> Entity:
        for e in self.entities:
            if name in (e.alias, e.name):
                return e
        raise KeyError(name)

    def to_json(self) -> str:
        def plain(x):
            if dataclasses.is_dataclass(x):
                return {"kind": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
            if isinstance(x, (list, tuple)):
                return [plain(y) for y in x]
            if hasattr(x, "isoformat"):
                return {"kind": type(x).__name__, "value": x.isoformat()}
            return x

        return json.dumps(plain(self))

    @staticmethod
    def from_json(text: str) -> Catalog:
        import datetime
        import inspect

        kinds = {c.__name__: c for c in (Locator, Column, Field, Entity, Operation, Group, Join, Sort, Assignment, Catalog)}

        def build(x):
            if isinstance(x, list):
                return [build(y) for y in x]
            if isinstance(x, dict) and x.get("kind") in kinds:
                cls = kinds[x["kind"]]
                names = inspect.signature(cls).parameters
                return cls(**{k: build(v) for k, v in x.items() if k in names})
            if isinstance(x, dict) and x.get("kind") in ("date", "datetime"):
                return getattr(datetime, x["kind"]).fromisoformat(x["value"])
            return x

        return build(json.loads(text))

    def output_names(self) -> dict[tuple[str, str], str]:
        """Names of result columns: bare, or Entity.Column where a name occurs in more than one entity."""
        seen: dict[str, int] = {}
        for e in self.entities:
            for name in {c.alias or c.name for c in e.columns}:
                seen[name] = seen.get(name, 0) + 1
        return {(e.alias or e.name, c.name): (c.alias or c.name) if seen[c.alias or c.name] == 1 else f"{e.alias or e.name}.{c.alias or c.name}" for e in self.entities for c in e.columns}

    def schema(self) -> T.StructType:
        """The declared result schema: sides that a join may leave empty are nullable, untyped columns are left out, decimals have precision 38."""
        loose = {x.entity for j in self.joins for x in ((j.right,) if j.type == "LEFT" else (j.left, j.right) if j.type == "OUTER" else ())}
        names = self.output_names()
        fields = []
        for e in self.entities:
            for c in e.columns:
                kind = c.spark_type()
                if kind is not None:
                    kind = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
                    fields.append(T.StructField(names[e.alias or e.name, c.name], kind, c.nullable or (e.alias or e.name) in loose, {"type_id": c.type}))
        return T.StructType(fields)


def entity_of(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> Entity:
    """The entity that describes a frame."""
    columns = []
    for k, f in enumerate(df.schema):
        kind = f.dataType
        columns.append(
            Column(
                name, f.name, type=f.metadata.get("type_id") or type_id(kind), nullable=f.nullable, ordinal=k, primary_key=f.name in keys,
                precision=getattr(kind, "precision", None), scale=getattr(kind, "scale", None), timezone="UTC" if isinstance(kind, T.TimestampType) else None,
                meta=_nested(kind),
            )
        )
    return Entity(name, columns)


def _nested(kind: T.DataType) -> dict:
    if isinstance(kind, T.ArrayType):
        return {"element": type_id(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"key": type_id(kind.keyType), "value": type_id(kind.valueType)}
    if isinstance(kind, T.StructType):
        return {"fields": {f.name: type_id(f.dataType) for f in kind}}
    return {}


def describe_schema(df: DataFrame) -> DataFrame:
    """One row a column: column, type, nullable, precision, scale, ordinal."""
    rows = [(c.name, c.type, c.nullable, c.precision, c.scale, c.ordinal) for c in entity_of(df, "frame").columns]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean, precision int, scale int, ordinal int")
