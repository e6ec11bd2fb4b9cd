"""Table writes as new versions of a table: insert, update, upsert and delete, with audit columns and keys.

Stock Spark tables have no MERGE, so each verb returns the next version as a lazy frame, from joins that
keep every target row in at most one output row. save_version() writes it to a fresh path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Assignment, Catalog, Field, Group, Operation
from millrace.catalog import Column as Named
from millrace.operators.joins import duplicate_keys
from millrace.operators.rows import keep_columns, latest_per_key, with_row_index
from millrace.plans.compile import condition, literal, to_dataframe
from millrace.session import materialize
from millrace.types import quoted

AUDIT = ("created_at", "created_by", "updated_at", "updated_by")


@dataclass
class Audit:
    """Who writes and when; on insert all four columns are set, on update the last two."""

    user: str
    now: object = None

    def column(self, name: str) -> Column:
        return F.lit(self.user) if name.endswith("_by") else F.current_timestamp() if self.now is None else F.lit(self.now)


def _conform(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of target in its order and types; missing ones null, unknown ones an error."""
    extra = [c for c in df.columns if c not in target.columns]
    if extra:
        raise ValueError(f"the target has no columns {extra}")
    return df.select(*[(F.col(quoted(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])


def _assigned(value, field) -> Column:
    return field(value) if isinstance(value, (Field, Named)) else literal(value)


def with_audit(rows: DataFrame, audit: Audit | None, columns: list[str], update: bool = False) -> DataFrame:
    names = [c for c in columns if c.lower() in (AUDIT[2:] if update else AUDIT)] if audit else []
    return rows.withColumns({c: audit.column(c.lower()) for c in names})


def insert(target: DataFrame, rows: DataFrame, assignments: list[Assignment] | None = None, audit: Audit | None = None) -> DataFrame:
    """target with rows added. Assignments name the columns and their literals, source fields or columns; audit columns come from audit only."""
    if assignments:
        rows = rows.select(*[_assigned(a.value, lambda f: F.col(quoted(f.name))).alias(a.column.name) for a in assignments])
    if audit:
        rows = rows.drop(*[c for c in rows.columns if c.lower() in AUDIT])
    return target.unionByName(_conform(with_audit(rows, audit, target.columns), target))


def update(target: DataFrame, where: list, assignments: list[Assignment] | None = None, rows: DataFrame | None = None, order_by: list[str] | str | None = None, audit: Audit | None = None) -> DataFrame:
    """target with the columns of matching rows set.

    where: operations and groups; without any the call is refused. With rows, equality of target columns
    and fields of the rows is the join key, further conditions apply to the target; several rows of one
    key need an order, of which the last counts. Without assignments all columns of the rows are set.
    """
    if not where:
        raise ValueError("an update needs a filter")
    if rows is None:
        hit = condition(where, lambda c: F.col(quoted(c.name)))
        made = {a.column.name: _assigned(a.value, lambda f: F.col(quoted(f.name))) for a in assignments or []}
        if audit:
            made |= {c: audit.column(c.lower()) for c in target.columns if c.lower() in AUDIT[2:]}
        hit = F.coalesce(hit, F.lit(False))
        return target.select(*[F.when(hit, made[f.name]).otherwise(F.col(quoted(f.name))).cast(f.dataType).alias(f.name) if f.name in made else F.col(quoted(f.name)) for f in target.schema])
    keys, rest = _key_pairs(where)
    if not keys:
        raise ValueError("an update with rows needs an equality of a column and a field")
    source = single_source(rows, list(keys.values()), order_by)
    s = source.toDF(*[f"_s{i}" for i in range(len(source.columns))])
    place = {c: f"_s{i}" for i, c in enumerate(source.columns)}
    s = s.withColumn("_hit", F.lit(True)).dropna(subset=[place[f] for f in keys.values()])
    joined = target.join(s, [target[quoted(c)] == s[place[f]] for c, f in keys.items()], "left")
    hit = F.col("_hit").isNotNull()
    if rest:
        hit = hit & F.coalesce(condition(rest, lambda c: F.col(quoted(c.name)), lambda f: F.col(place[f.name])), F.lit(False))
    if assignments:
        made = {a.column.name: F.col(place[a.value.name]) if isinstance(a.value, Field) else _assigned(a.value, lambda f: F.col(quoted(f.name))) for a in assignments}
    else:
        made = {c: F.col(place[c]) for c in source.columns if c in target.columns and c not in keys}
    if audit:
        made |= {c: audit.column(c.lower()) for c in target.columns if c.lower() in AUDIT[2:]}
    return joined.select(*[F.when(hit, made[f.name]).otherwise(F.col(quoted(f.name))).cast(f.dataType).alias(f.name) if f.name in made else F.col(quoted(f.name)) for f in target.schema])


def _key_pairs(where: list) -> tuple[dict[str, str], list]:
    """Equalities of a column and a field at the top level, and the other conditions."""
    keys, rest = {}, []
    for item in where:
        if isinstance(item, Group) and item.condition == "AND":
            more, left = _key_pairs(item.items)
            keys |= more
            rest += left
        elif isinstance(item, Operation) and item.operator == "=" and isinstance(item.right, Field):
            keys[item.left.name] = item.right.name
        else:
            rest.append(item)
    return keys, rest


def single_source(rows: DataFrame, keys: list[str], order_by: list[str] | str | None) -> DataFrame:
    """Rows with each non-null key once: the last in the order; without an order a repeated key is an error."""
    if order_by is not None:
        complete = rows.dropna(subset=keys)
        return latest_per_key(complete, keys, order_by).unionByName(rows.where(" OR ".join(f"{quoted(k)} IS NULL" for k in keys)))
    if not duplicate_keys(rows, keys).isEmpty():
        raise ValueError(f"several rows of one key {keys}: give order_by, the last one counts")
    return rows


def upsert(target: DataFrame, rows: DataFrame, on: list[str] | str | None, order_by: list[str] | str | None = None, audit: Audit | None = None) -> DataFrame:
    """Rows of known keys update the target's other columns, the rest are inserted; null keys never match. Without keys it is an insert."""
    if not on:
        return insert(target, rows, audit=audit)
    on = [on] if isinstance(on, str) else list(on)
    given = [c for c in rows.columns if c in target.columns and not (audit and c.lower() in AUDIT)]
    source = keep_columns(single_source(rows, on, order_by), given)
    s = source.toDF(*[f"_s{i}" for i in range(len(given))]).withColumn("_new", F.lit(True))
    place = {c: f"_s{i}" for i, c in enumerate(source.columns)}
    t = target.withColumn("_old", F.lit(True))
    # rows with a null key never match; they are dealt out by number, as their keys would all go to one task
    t, s = _dealt(t, on, "_t_deal"), _dealt(s, [place[k] for k in on], "_s_deal")
    joined = t.join(s, [*[t[quoted(k)] == s[place[k]] for k in on], t["_t_deal"] == s["_s_deal"]], "full")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = []
    for f in target.schema:
        own = F.col(quoted(f.name))
        if audit and f.name.lower() in AUDIT:
            fresh = audit.column(f.name.lower())
            value = F.when(new & ((~old) if f.name.lower() in AUDIT[:2] else F.lit(True)), fresh).otherwise(own)
        elif f.name in on:
            value = F.when(old, own).otherwise(F.col(place[f.name]))
        elif f.name in place:
            value = F.when(new, F.col(place[f.name])).otherwise(own)
        else:
            value = own
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(*out)


def _dealt(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    incomplete = F.lit(False)
    for k in keys:
        incomplete = incomplete | F.col(quoted(k)).isNull()
    return df.withColumn(name, F.when(incomplete, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))


def upsert_external(target: DataFrame, rows: DataFrame, external_id: str | None = None, catalog: Catalog | None = None, order_by: list[str] | str | None = None, audit: Audit | None = None) -> DataFrame:
    """An upsert by an external id: the argument, else the entity's property, else its first unique column that is no primary key."""
    if external_id is None and catalog is not None:
        entity = catalog.entities[0]
        external_id = entity.properties.get("external_id") or next((c.name for c in entity.columns if c.unique and not c.primary_key), None)
    if external_id is None:
        raise ValueError("no external id")
    return upsert(target, rows, external_id, order_by, audit)


def delete(target: DataFrame, where: list | None = None, all_rows: bool = False) -> DataFrame:
    """target without matching rows; a condition that is null keeps its row."""
    if not where:
        if not all_rows:
            raise ValueError("a delete needs a filter, or all_rows=True")
        return target.limit(0)
    return target.where(~F.coalesce(condition(where, lambda c: F.col(quoted(c.name))), F.lit(False)))


def delete_matching(target: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """target without rows that equal a given row in every listed column."""
    columns = columns or [c for c in rows.columns if c in target.columns]
    if not columns:
        raise ValueError("no columns to compare")
    s = rows.select(*[F.col(quoted(c)).alias(f"_s{i}") for i, c in enumerate(columns)])
    return target.join(s, [target[quoted(c)] == s[f"_s{i}"] for i, c in enumerate(columns)], "left_anti")


def assign_ids(df: DataFrame, name: str, start: int, order_by: list[str] | str) -> DataFrame:
    """A new key column, counted on from start."""
    return with_row_index(df, order_by, name, start)


def next_id(target: DataFrame, name: str) -> int:
    return (target.agg(F.max(F.col(quoted(name)))).first()[0] or 0) + 1


def target_of(catalog: Catalog) -> str:
    """The one entity that is written: that of the assignments, else the root of the joins."""
    named = {a.column.entity for a in catalog.assignments}
    if len(named) > 1:
        raise ValueError(f"several targets: {sorted(named)}")
    if named:
        return named.pop()
    rights = {j.right.entity for j in catalog.joins}
    roots = [e.alias or e.name for e in catalog.entities if (e.alias or e.name) not in rights]
    if len(roots) != 1:
        raise ValueError(f"the target is not clear: {roots}")
    return roots[0]


def delete_joined(catalog: Catalog, tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the write target go when the joined and filtered entities hold their key."""
    name = target_of(catalog)
    hit = to_dataframe(Catalog([e if (e.alias or e.name) != name else type(e)(e.name, [Named(name, k) for k in keys], e.alias) for e in catalog.entities], catalog.joins, catalog.filters), tables)
    names = [k if k in hit.columns else f"{name}.{k}" for k in keys]
    return delete_matching(tables[name], hit.select(*[F.col(quoted(n)).alias(k) for n, k in zip(names, keys, strict=True)]).distinct(), keys)


def ingest(target: DataFrame, rows: DataFrame, verb: str, creatable: list[str], updatable: list[str], key: str, order_by: list[str] | str | None = None) -> DataFrame:
    """A write with only the columns that its verb may set: insert the creatable, update the updatable and the key, delete the key."""
    if verb == "insert":
        return insert(target, keep_columns(rows, creatable))
    if verb == "update":
        part = keep_columns(rows, [*updatable, key, *([order_by] if isinstance(order_by, str) else order_by or [])])
        made = [Assignment(Named("", c), Field(c)) for c in updatable if c in part.columns and c in target.columns]
        return update(target, [Operation(Named("", key), "=", Field(key))], made, part, order_by)
    if verb == "upsert":
        return upsert(target, keep_columns(rows, [*updatable, *creatable, key]), key, order_by)
    if verb == "delete":
        return delete_matching(target, keep_columns(rows, [key]), [key])
    raise ValueError(f"unknown verb {verb!r}")


def include_deleted(df: DataFrame, include: bool, column: str = "is_deleted") -> DataFrame:
    return df if include else df.where(~F.coalesce(F.col(quoted(column)), F.lit(False)))


def changed_between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows changed at or after start and before end."""
    return df.where((F.col(quoted(column)) >= F.lit(start)) & (F.col(quoted(column)) < F.lit(end)))


def save_version(df: DataFrame, base: str, version: int) -> DataFrame:
    """The frame written as base/version and read back; a version is written once."""
    path = f"{base}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """A version that later steps read several times, written once in the shared folder."""
    return materialize(df, "table")


def write_with_rejects(target: DataFrame, rows: DataFrame, on: list[str] | None = None, required: list[str] = (), limits: dict | None = None, order_by: list[str] | str | None = None, audit: Audit | None = None) -> tuple[DataFrame, DataFrame]:
    """The next version of target with all rows that keep its rules, and the others with _error: one bad row doesn't stop the rest."""
    from millrace.functions.cells import enforce_lengths, enforce_not_null

    ok, rejects = enforce_not_null(rows, list(required)) if required else (rows, None)
    if limits:
        ok, long = enforce_lengths(ok, limits)
        rejects = long if rejects is None else rejects.unionByName(long)
    if rejects is None:
        rejects = rows.limit(0).withColumn("_error", F.lit(None).cast("string"))
    return upsert(target, ok, on, order_by, audit), rejects
