"""Registered queries of the master-data steps, over people, phones and addresses made of customers.

Every tenth customer is deleted; every twentieth from the first on has no phone. Messages: each fourth
customer from the third on is unknown, each fourth from the first on has a new name (after an older
message), the others say what is known.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Column, Entity
from millrace.operators import aggregates, evolve, mdm, rows
from millrace.operators.tables import Audit
from millrace.queries import query, read
from millrace.session import materialize

NOW = datetime.datetime(2024, 5, 1)
_AUDIT = {"created_at": "timestamp", "created_by": "string", "updated_at": "timestamp", "updated_by": "string"}
_SEGMENTS = "(SELECT segment, row_number() OVER (ORDER BY segment) AS id FROM (SELECT DISTINCT upper(c_mktsegment) AS segment FROM customer))"
_LOOKUPS = [(110, "MAR_STATUS", "UNKNOWN"), (141, "ADDRESS_TYPE", "HOME"), (151, "PHONE_TYPE", "MAIN"), (152, "PHONE_TYPE", "WORK"), (161, "DELETED_STATUS", "ACTIVE"), (162, "DELETED_STATUS", "GONE")]


def master(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables of the master data."""
    c = read(spark, sf_dir, "customer")
    segments = c.select(F.upper("c_mktsegment").alias("lookup_desc")).distinct()
    genders = rows.with_row_index(segments, "lookup_desc", "lookup_id", 1).select("lookup_id", F.lit("GENDER").alias("category"), "lookup_desc")
    lookups = genders.unionByName(spark.createDataFrame(_LOOKUPS, "lookup_id long, category string, lookup_desc string"))
    key, employee = F.col("c_custkey"), F.concat(F.lit("e"), F.col("c_custkey"))
    no, audit = (lambda kind: F.lit(None).cast(kind)), [F.lit(None).cast(k).alias(n) for n, k in _AUDIT.items()]
    people = c.join(genders, F.upper("c_mktsegment") == F.col("lookup_desc")).select(
        key.alias("demographic_id"), employee.alias("employee_id"), F.col("c_name").alias("first_name"), no("string").alias("middle_name"), F.concat(F.lit("L"), "c_nationkey").alias("last_name"),
        no("long").alias("prefix_id"), no("long").alias("suffix_id"), F.date_add(F.lit("1980-01-01").cast("date"), (key % 1000).cast("int")).alias("birthdate"), no("date").alias("dt_of_death"),
        F.col("lookup_id").alias("gender_id"), F.lit(110).cast("long").alias("mar_status_id"), no("string").alias("email_addr"), F.when(key % 10 == 0, 162).otherwise(161).cast("long").alias("deleted_status"), *audit,
    )
    phone = c.withColumn("kind", F.explode(F.array(F.lit(151), F.lit(152)))).where((F.col("kind") == 152) | (key % 20 != 1))
    phone = phone.select((2 * key + F.col("kind") - 151).alias("phone_id"), key.alias("demographic_id"), F.concat(F.lit("555-"), key).alias("phone"), no("string").alias("phone_ext"), F.col("kind").cast("long").alias("phone_type_id"), *audit)
    address = c.select(key.alias("address_id"), key.alias("demographic_id"), F.lit("Main St").alias("address1"), *[no("string").alias(f"address{k}") for k in (2, 3, 4)], F.concat(F.lit("City "), "c_nationkey").alias("city"), *[no("string").alias(n) for n in ("county", "state", "postal", "country")], F.lit(141).cast("long").alias("address_type_id"), *audit)
    return {"mq_lookup": lookups, "employee": c.select(employee.alias("employee_id"), F.lpad(key.cast("string"), 9, "0").alias("ssn")), "demographic": people, "phone": phone, "address": address}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of one JSON array for each customer; every seventh is broken."""
    key, k = F.col("c_custkey"), F.col("c_custkey") % 4

    def message(number, name):
        return F.struct(
            number.alias("mq_id"), F.when(k == 3, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit("e"), key)).alias("employee_id"), name.alias("first_name"), F.concat(F.lit("L"), "c_nationkey").alias("last_name"),
            F.date_add(F.lit("1980-01-01").cast("date"), (key % 1000).cast("int")).cast("string").alias("birthdate"), F.lower("c_mktsegment").alias("gender"), F.when(key % 20 == 1, F.concat(F.lit("777-"), key)).otherwise(F.concat(F.lit("555-"), key)).alias("phone"),
            F.lit("Main St").alias("address1"), F.concat(F.lit("City "), "c_nationkey").alias("city"),
        )

    last, older = message(2 * key + 1, F.when(k == 1, F.concat(F.lit("New "), "c_name")).otherwise(F.col("c_name"))), message(2 * key, F.concat(F.lit("Older "), "c_name"))
    payload = F.when(key % 7 == 0, F.lit("broken")).when(k == 1, F.to_json(F.array(last, older))).otherwise(F.to_json(F.array(last)))
    return read(spark, sf_dir, "customer").select(payload.alias("payload"))


def classified(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables, the messages as they came, and the messages with ids, hashes and status."""
    tables = master(spark, sf_dir)
    inbound, _ = mdm.load_json(messages(spark, sf_dir))
    people = mdm.snapshot(tables)
    return tables, inbound, materialize(mdm.classify(mdm.delta(mdm.enrich(inbound, tables["mq_lookup"], people))), "classified")


_HASHES = """
upper(md5(first_name || chr(30) || chr(0) || chr(30) || 'L' || c_nationkey || chr(30) || chr(0) || chr(30) || chr(0) || chr(30) || birthdate || chr(30) || chr(0) || chr(30) || id || chr(30) || '110' || chr(30) || chr(0))) AS mq_demographic_hash,
upper(md5(coalesce(phone, chr(0)) || chr(30) || CASE WHEN phone IS NULL THEN chr(0) ELSE '151' END)) AS mq_phone_hash,
upper(md5('Main St' || chr(30) || chr(0) || chr(30) || chr(0) || chr(30) || chr(0) || chr(30) || 'City ' || c_nationkey || chr(30) || chr(0) || chr(30) || chr(0) || chr(30) || chr(0) || chr(30) || chr(0) || chr(30) || '141')) AS mq_address_hash
"""


@query(f"""
SELECT 'e' || c_custkey AS employee_id, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ssn, first_name, segment AS gender, phone, 'City ' || c_nationkey AS city, {_HASHES}
FROM (SELECT *, c_name AS first_name, CAST(DATE '1980-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS DATE) AS birthdate, CASE WHEN c_custkey % 20 <> 1 THEN '555-' || c_custkey END AS phone FROM customer WHERE c_custkey % 10 <> 0)
JOIN {_SEGMENTS} ON upper(c_mktsegment) = segment
""")
def mdm_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdm.snapshot(master(spark, sf_dir)).select("employee_id", "ssn", "first_name", "gender", "phone", "city", "mq_demographic_hash", "mq_phone_hash", "mq_address_hash")


_MESSAGES = "(SELECT *, 2 * c_custkey + 1 AS mq_id, c_custkey % 4 = 1 AS changed, c_custkey % 4 <> 3 AND c_custkey % 10 <> 0 AS known FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT *, 2 * c_custkey, true, true FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 4 = 1)"
_STATUS = "CASE WHEN NOT known THEN 404 WHEN changed THEN 200 ELSE 304 END"


@query(f"SELECT CAST({_STATUS} AS INTEGER) AS mq_status, count(*) AS n FROM {_MESSAGES} GROUP BY 1")
def mdm_delta_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.status_summary(classified(spark, sf_dir)[2])


@query("""
SELECT 'demographic' AS kind, c_custkey AS id, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 7 <> 0 THEN 'New ' || c_name ELSE c_name END AS value, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 7 <> 0 THEN 'worker' END AS updated_by FROM customer
UNION ALL SELECT 'phone', 2 * c_custkey, '555-' || c_custkey, NULL FROM customer WHERE c_custkey % 20 <> 1
UNION ALL SELECT 'phone', 2 * c_custkey + 1, '555-' || c_custkey, NULL FROM customer
UNION ALL SELECT 'phone', (SELECT max(2 * c_custkey + 1) FROM customer) + row_number() OVER (ORDER BY c_custkey), '777-' || c_custkey, 'worker' FROM customer WHERE c_custkey % 20 = 1 AND c_custkey % 7 <> 0
UNION ALL SELECT 'address', c_custkey, 'City ' || c_nationkey, NULL FROM customer
""")
def mdm_apply_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next versions of the three tables, in one list of kind, key and value."""
    tables, _, done = classified(spark, sf_dir)
    demographic, address, phone = mdm.apply(done, tables["demographic"], tables["address"], tables["phone"], Audit("worker", NOW))
    parts = (("demographic", demographic, "demographic_id", "first_name"), ("phone", phone, "phone_id", "phone"), ("address", address, "address_id", "city"))
    return rows.concat(*[f.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(value).alias("value"), "updated_by") for kind, f, key, value in parts])


@query("SELECT c_custkey AS census_id, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 7 <> 0 THEN 'New ' || c_name ELSE 'Census ' || c_name END AS first_name, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 7 <> 0 THEN 'worker' END AS updated_by FROM customer")
def mdm_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, _, done = classified(spark, sf_dir)
    census = tables["demographic"].select(F.col("demographic_id").alias("census_id"), "demographic_id", "employee_id", F.concat(F.lit("Census "), "first_name").alias("first_name"), "updated_at", "updated_by")
    return mdm.refresh_census(census, done, Audit("worker", NOW)).select("census_id", "first_name", "updated_by")


@query(f"""
SELECT mq_id, CAST({_STATUS} AS INTEGER) AS mq_status, CASE WHEN known THEN c_custkey END AS demographic_id, CASE WHEN known THEN id END AS gender_id, CASE WHEN known AND c_custkey % 20 <> 1 THEN 2 * c_custkey END AS phone_id, 'worker' AS updated_by
FROM {_MESSAGES} JOIN {_SEGMENTS} ON upper(c_mktsegment) = segment
""")
def mdm_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, inbound, done = classified(spark, sf_dir)
    return mdm.write_back(inbound, done, Audit("worker", NOW)).select("mq_id", "mq_status", "demographic_id", "gender_id", "phone_id", "updated_by")


@query("SELECT 'e' || c_custkey AS employee_id, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 3 = 0) GROUP BY 1")
def mdm_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot behind what an earlier run left there."""
    people = mdm.snapshot(master(spark, sf_dir))
    return mdm.outbound(people, people.where("demographic_id % 3 = 0").drop("ssn")).groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'broken' AS json_record, 'load' AS error_location, 500 AS mq_status_code, count(*) AS n, 0 AS n_cleared FROM customer WHERE c_custkey % 7 = 0")
def mdm_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = mdm.load_json(messages(spark, sf_dir))
    log = mdm.errors(rejects, "load", NOW)
    found = mdm.errors_since(log, NOW).unionByName(mdm.errors_since(log, NOW + datetime.timedelta(1)))
    counted = found.groupBy("json_record", "error_location", "mq_status_code").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(mdm.clear(log).agg(F.count(F.lit(1)).cast("int").alias("n_cleared")))


@query("SELECT o_orderkey AS mq_id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 201 WHEN o_orderkey % 5 IN (1, 3) THEN 202 ELSE 200 + o_orderkey % 5 * 100 END AS INTEGER) AS mq_status FROM orders")
def mdm_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed messages wait again; some get priority."""
    k = F.col("o_orderkey") % 5
    status = F.when(k == 1, F.lit(500)).when(k == 3, F.lit(500)).otherwise(200 + k * 100).cast("int")
    inbound = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mq_id"), status.alias("mq_status"))
    return mdm.tag(mdm.reprocess(inbound), inbound.where("mq_id % 10 = 0").select("mq_id"))


def _waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mq_id"), F.when(F.col("o_orderkey") % 3 == 0, 202).otherwise(200).alias("mq_status"))


@query("SELECT o_orderkey AS mq_id, CAST(202 AS INTEGER) AS mq_status FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderkey LIMIT 60")
def mdm_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdm.take(_waiting(spark, sf_dir), chunk=60, slices=1).drop("slice")


@query("SELECT slice, 15 AS n, 15 AS first_ones FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS slice)")
def mdm_take_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slice's share of the chunk, and how many of them are among the first of their slice by another count."""
    waiting = _waiting(spark, sf_dir)
    ranked = rows.with_row_index(mdm.take(waiting), ["slice", "mq_id"], "place")
    first = ranked.groupBy("slice").agg(F.min("place").alias("first"))
    early = ranked.join(first, "slice").where(F.col("place") - F.col("first") < 15).select("mq_id", F.lit(1).alias("early"))
    taken = mdm.take(waiting, chunk=60, slices=4).join(early, "mq_id", "left")
    return taken.groupBy("slice").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("early").cast("int").alias("first_ones"))


@query(f"SELECT CAST(CASE WHEN NOT known THEN 404 WHEN mq_id % 11 = 0 THEN 500 WHEN changed THEN 200 ELSE 304 END AS INTEGER) AS mq_status, count(*) AS n FROM {_MESSAGES} GROUP BY 1")
def mdm_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that fail on their way, by a condition on their id, have status 500 unless their employee is unknown."""
    tables = master(spark, sf_dir)
    inbound, _ = mdm.load_json(messages(spark, sf_dir))
    changes = mdm.delta(mdm.enrich(inbound, tables["mq_lookup"], mdm.snapshot(tables)))
    return aggregates.status_summary(mdm.classify(changes, F.col("mq_id") % 11 == 0))


@query("SELECT mq_id, CAST(202 AS INTEGER) AS mq_status FROM (SELECT o_orderkey AS mq_id, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0) WHERE n <= 3000")
def mdm_take_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk past the bound up to which each task keeps the first rows: by row numbers."""
    return mdm.take(_waiting(spark, sf_dir), chunk=3000, slices=1).drop("slice")


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(s_suppkey AS BIGINT) AS code FROM supplier")
def align_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only columns that are there already are changed: one widened, one from text to number; the new one isn't added."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_suppkey").cast("string").alias("code"))
    wanted = T.StructType([T.StructField("s_nationkey", T.LongType()), T.StructField("code", T.LongType()), T.StructField("added", T.DoubleType())])
    return evolve.align(s, wanted, add=False)


@query("SELECT 'wh' AS namespace, 'CUSTOMER' AS entity, 0 AS n_keys, c_custkey, c_name FROM customer")
def retargeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the entity names them in its new place: keys cleared, the column without a type left out."""
    columns = [Column("customer", "c_custkey", type="int64", primary_key=True, unique=True), Column("customer", "c_name", type="string"), Column("customer", "c_mktsegment")]
    moved = evolve.retarget(Entity("customer", columns), "wh")
    n_keys = sum(c.primary_key or c.unique for c in moved.columns)
    place = [F.lit(moved.locator.namespace).alias("namespace"), F.lit(moved.name).alias("entity"), F.lit(n_keys).alias("n_keys")]
    return read(spark, sf_dir, "customer").select(*place, *[c.name for c in moved.columns])
