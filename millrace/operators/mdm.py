"""Master data: inbound JSON messages are enriched, compared by row hashes, classified and applied as sets.

Tables are plain frames by the names of FIXTURES.md; each step returns frames, so the same functions
serve a batch and a micro-batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import enforce_not_null, row_hash
from millrace.operators.rows import latest_per_key, with_row_index
from millrace.operators.tables import Audit, next_id, upsert

# The fields of the inbound message, in order.
MESSAGE = (
    "mq_id long, demographic_id long, employee_id string, first_name string, middle_name string, last_name string, name_prefix_id long, name_prefix string, "
    "name_suffix_id long, name_suffix string, birthdate date, dt_of_death date, email_addr string, email_type string, gender_id long, gender string, "
    "mar_status_id long, mar_status string, ssn string, mq_demographic_hash string, phone_id long, phone string, phone_type_id long, phone_type string, mq_phone_hash string, "
    "address_id long, address1 string, address2 string, address3 string, address4 string, city string, county string, state string, postal string, country string, "
    "address_type_id long, address_type string, mq_address_hash string, integration_id string, mq_status int, created_at timestamp, created_by string, updated_at timestamp, updated_by string"
)
# What each row hash covers, in order.
HASHED = {
    "demographic": ("first_name", "middle_name", "last_name", "name_prefix_id", "name_suffix_id", "birthdate", "dt_of_death", "gender_id", "mar_status_id", "email_addr"),
    "phone": ("phone", "phone_type_id"),
    "address": ("address1", "address2", "address3", "address4", "city", "county", "state", "postal", "country", "address_type_id"),
}
WAITING, PRIORITY, DONE, SAME, UNKNOWN, FAILED = 202, 201, 200, 304, 404, 500


@dataclass
class Code:
    """A looked-up code of a message: its id and label columns, its category and the label that stands in for a missing one."""

    id: str
    label: str
    category: str
    default: str | None = None


CODES = (
    Code("name_prefix_id", "name_prefix", "NAME_PREFIX"),
    Code("name_suffix_id", "name_suffix", "NAME_SUFFIX"),
    Code("gender_id", "gender", "GENDER", "UNKNOWN"),
    Code("mar_status_id", "mar_status", "MAR_STATUS", "UNKNOWN"),
    Code("phone_type_id", "phone_type", "PHONE_TYPE", "MAIN"),
    Code("address_type_id", "address_type", "ADDRESS_TYPE", "HOME"),
)


def hashes(df: DataFrame) -> DataFrame:
    """The three row hashes as mq_<domain>_hash; dates enter as ISO text."""
    return df.withColumns({f"mq_{d}_hash": row_hash(*[F.col(c) for c in fields]) for d, fields in HASHED.items()})


def _labels(lookups: DataFrame, category: str | None, key: str, label: str) -> DataFrame:
    rows = lookups if category is None else lookups.where(F.col("category") == category)
    return rows.select(F.col("lookup_id").cast("long").alias(key), F.col("lookup_desc").alias(label))


def _of_type(df: DataFrame, lookups: DataFrame, column: str, category: str, label: str) -> DataFrame:
    """Rows whose type is the one of a label; the lookup side is one row, so Spark broadcasts it by its own size check."""
    return df.join(lookups.where((F.col("category") == category) & (F.col("lookup_desc") == label)).select(F.col("lookup_id").cast("long").alias(column)), column, "left_semi")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """People as the source has them: active demographics with their employee, labels, MAIN phone, HOME address and hashes."""
    lookups = tables["mq_lookup"]
    d = _of_type(tables["demographic"], lookups, "deleted_status", "DELETED_STATUS", "ACTIVE")
    d = d.select("demographic_id", "employee_id", "first_name", "middle_name", "last_name", F.col("prefix_id").alias("name_prefix_id"), F.col("suffix_id").alias("name_suffix_id"), "birthdate", "dt_of_death", "email_addr", "gender_id", "mar_status_id", "deleted_status")
    out = d.join(tables["employee"].select("employee_id", "ssn"), "employee_id")
    phones = _of_type(tables["phone"], lookups, "phone_type_id", "PHONE_TYPE", "MAIN").select("demographic_id", "phone_id", "phone", "phone_type_id")
    homes = _of_type(tables["address"], lookups, "address_type_id", "ADDRESS_TYPE", "HOME").select("demographic_id", "address_id", *HASHED["address"])
    out = out.join(phones, "demographic_id", "left").join(homes, "demographic_id", "left")
    for code in CODES:
        out = out.join(_labels(lookups, None, code.id, code.label), code.id, "left")
    return hashes(out)


def load_json(df: DataFrame, column: str = "payload", schema: str = MESSAGE) -> tuple[DataFrame, DataFrame]:
    """Messages of JSON arrays: (rows, rejects). Payloads that are no JSON and messages without an employee are rejects; a null status is 202."""
    kind = T.ArrayType(df.sparkSession.createDataFrame([], schema).schema)
    parsed = df.withColumn("_p", F.from_json(F.col(column), kind, {"mode": "PERMISSIVE"}))
    bad = parsed.where(F.col("_p").isNull()).select(F.col(column).alias("json_record"), F.lit("not a JSON array of messages").alias("error_message"))
    rows = parsed.where(F.col("_p").isNotNull()).select(F.explode("_p").alias("_r"))
    empty = rows.where(F.col("_r").isNull()).select(F.lit(None).cast("string").alias("json_record"), F.lit("not a message").alias("error_message"))
    rows = rows.where(F.col("_r").isNotNull()).select("_r.*")
    ok, missing = enforce_not_null(rows, ["employee_id"])
    missing = missing.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("json_record"), F.col("_error").alias("error_message"))
    ok = ok.withColumn("mq_status", F.coalesce("mq_status", F.lit(WAITING)))
    return ok, bad.unionByName(empty).unionByName(missing)


def enrich(inbound: DataFrame, lookups: DataFrame, people: DataFrame, codes: tuple[Code, ...] = CODES) -> DataFrame:
    """Ids from labels (in upper case, or the default), labels from given ids, and keys from the employee's snapshot.

    A label is looked up by the id as it came, so where both are missing the label stays null. Phone and
    address are found by the person that the employee resolves to.
    """
    out = inbound
    for k, code in enumerate(codes):
        # one id for each label of a category: the smallest, so a repeated label doesn't multiply rows
        by_label = lookups.where(F.col("category") == code.category).groupBy(F.col("lookup_desc").alias(f"_l{k}")).agg(F.min(F.col("lookup_id").cast("long")).alias(f"_i{k}"))
        by_id = _labels(lookups, code.category, f"_j{k}", f"_d{k}").dropDuplicates([f"_j{k}"])
        wanted = F.upper(F.col(code.label)) if code.default is None else F.coalesce(F.upper(F.col(code.label)), F.lit(code.default))
        out = out.join(by_label, wanted == F.col(f"_l{k}"), "left").join(by_id, F.col(code.id) == F.col(f"_j{k}"), "left")
        out = out.withColumns({code.id: F.coalesce(F.col(code.id), F.col(f"_i{k}")), code.label: F.coalesce(F.col(code.label), F.col(f"_d{k}"))}).drop(f"_l{k}", f"_i{k}", f"_j{k}", f"_d{k}")
    keys = [c for c in ("demographic_id", "phone_id", "address_id") if c in inbound.columns]
    known = people.select("employee_id", *[F.col(c).alias(f"_s_{c}") for c in keys], *[F.col(f"mq_{d}_hash").alias(f"source_{d}_hash") for d in HASHED if f"mq_{d}_hash" in people.columns], F.lit(True).alias("known"))
    out = out.join(known, "employee_id", "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_s_{c}")) for c in keys})
    return out.drop(*[f"_s_{c}" for c in keys]).withColumn("known", F.coalesce("known", F.lit(False)))


def delta(enriched: DataFrame, domains: dict[str, tuple[str, ...]] = HASHED) -> DataFrame:
    """The message's own hashes, and for each domain whether it changed; a missing source hash counts as changed."""
    out = enriched.withColumns({f"mq_{d}_hash": row_hash(*[F.col(c) for c in fields]) for d, fields in domains.items()})
    return out.withColumns({f"{d}_changed": F.coalesce(F.col(f"mq_{d}_hash") != F.col(f"source_{d}_hash"), F.lit(True)) for d in domains})


def classify(changes: DataFrame, error: Column | None = None, domains: tuple[str, ...] = tuple(HASHED)) -> DataFrame:
    """404 without such an employee, 500 with a row error, 200 where a domain changed, else 304."""
    changed = F.lit(False)
    for d in domains:
        changed = changed | F.col(f"{d}_changed")
    status = F.when(~F.col("known"), UNKNOWN)
    if error is not None:
        status = status.when(F.coalesce(error, F.lit(False)), FAILED)
    return changes.withColumn("mq_status", status.when(changed, DONE).otherwise(SAME))


def apply(classified: DataFrame, demographic: DataFrame, address: DataFrame, phone: DataFrame, audit: Audit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next versions of the three tables: of several messages for one employee the one of the highest mq_id counts."""
    last = latest_per_key(classified.where(F.col("mq_status") == DONE), ["employee_id"], "mq_id")
    names = {"name_prefix_id": "prefix_id", "name_suffix_id": "suffix_id"}
    people = last.where("demographic_changed").select("demographic_id", *[F.col(c).alias(names.get(c, c)) for c in HASHED["demographic"]])
    known = people.join(demographic.select("demographic_id"), "demographic_id", "left_semi")
    new_people = upsert(demographic, known, "demographic_id", audit=audit)

    def place(table: DataFrame, domain: str) -> DataFrame:
        key = f"{domain}_id"
        rows = last.where(f"{domain}_changed").select(key, "demographic_id", *HASHED[domain])
        kept = rows.where(F.col(key).isNotNull())
        fresh = with_row_index(rows.where(F.col(key).isNull()).drop(key), "demographic_id", key, next_id(table, key))
        return upsert(table, kept.unionByName(fresh, allowMissingColumns=True), key, audit=audit)

    return new_people, place(address, "address"), place(phone, "phone")


def refresh_census(census: DataFrame, classified: DataFrame, audit: Audit) -> DataFrame:
    """The census rows of changed people, set from their last message in the columns that both have."""
    last = latest_per_key(classified.where(F.col("mq_status") == DONE), ["employee_id"], "mq_id")
    shared = [c for c in census.columns if c in last.columns and c not in ("census_id", "demographic_id", "created_at", "created_by", "updated_at", "updated_by")]
    rows = last.select("demographic_id", *shared).join(census.select("demographic_id"), "demographic_id", "left_semi")
    return upsert(census, rows, "demographic_id", audit=audit)


def write_back(inbound: DataFrame, classified: DataFrame, audit: Audit) -> DataFrame:
    """inbound with ids, labels, hashes and status of the classified messages; unknown employees get their status only."""
    fields = [x for c in CODES for x in (c.id, c.label)] + ["demographic_id", "phone_id", "address_id"] + [f"mq_{d}_hash" for d in HASHED]
    fields = [f for f in fields if f in inbound.columns and f in classified.columns]
    known = F.col("known")
    rows = classified.select("mq_id", F.col("mq_status").alias("_status"), *[F.when(known, F.col(f)).alias(f"_n_{f}") for f in fields], known.alias("_known"))
    joined = inbound.join(rows, "mq_id", "left")
    done = F.col("_status").isNotNull()
    made = {f: F.when(done & F.col("_known"), F.col(f"_n_{f}")).otherwise(F.col(f)).cast(inbound.schema[f].dataType) for f in fields}
    made["mq_status"] = F.coalesce(F.col("_status"), F.col("mq_status")).cast(inbound.schema["mq_status"].dataType)
    for name in ("updated_at", "updated_by"):
        if name in inbound.columns:
            made[name] = F.when(done, audit.column(name)).otherwise(F.col(name))
    return joined.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in inbound.columns])


def take(inbound: DataFrame, status: int = WAITING, chunk: int | None = None, slices: int = 4) -> DataFrame:
    """Waiting messages by slices of the hash of their id, of each slice the first of its share of the chunk, in one scan."""
    rows = inbound.where(F.col("mq_status") == status).withColumn("slice", F.pmod(F.xxhash64("mq_id"), F.lit(slices)).cast("int"))
    if not chunk:
        return rows
    share = -(-chunk // slices)
    if share <= int(inbound.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        # each task keeps the first of each slice before the shuffle
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("slice").orderBy("mq_id"))).where(F.col("_n") <= share).drop("_n")
    placed = with_row_index(rows, ["slice", "mq_id"], "_n", nulls_last=False)
    first = placed.groupBy(F.col("slice").alias("_slice")).agg(F.min("_n").alias("_first"))
    return placed.join(first, F.col("slice") == F.col("_slice")).where(F.col("_n") - F.col("_first") < share).select(*rows.columns)


def outbound(people: DataFrame, present: DataFrame | None = None, reload: bool = False) -> DataFrame:
    """The snapshot behind what is there already, or in its place."""
    return people if present is None or reload else present.unionByName(people, allowMissingColumns=True)


def tag(inbound: DataFrame, ids: list[int] | DataFrame, status: int = PRIORITY) -> DataFrame:
    """Messages of a list or a frame of mq_id get a status."""
    if isinstance(ids, DataFrame):
        hit = ids.select("mq_id").distinct().withColumn("_hit", F.lit(True))
        marked = inbound.join(hit, "mq_id", "left").withColumn("mq_status", F.when(F.col("_hit"), status).otherwise(F.col("mq_status")))
        return marked.select(*inbound.columns)
    return inbound.withColumn("mq_status", F.when(F.col("mq_id").isin(ids), status).otherwise(F.col("mq_status")))


def reprocess(inbound: DataFrame, failed: int = FAILED, waiting: int = WAITING) -> DataFrame:
    return inbound.withColumn("mq_status", F.when(F.col("mq_status") == failed, waiting).otherwise(F.col("mq_status")))


def errors(rejects: DataFrame, procedure: str, now=None) -> DataFrame:
    """Rejects as rows of the error log."""
    return rejects.select("json_record", "error_message", F.lit(FAILED).alias("mq_status_code"), F.lit(procedure).alias("error_location"), (F.current_timestamp() if now is None else F.lit(now)).alias("created_at"))


def errors_since(log: DataFrame, ts) -> DataFrame:
    return log.where(F.col("created_at") >= F.lit(ts))


def clear(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)
