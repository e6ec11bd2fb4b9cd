"""Cells, table writes, schema changes, master data, and registered queries on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Assignment, Catalog, Column, Entity, Field, Join, Operation
from millrace.functions import cells
from millrace.operators import evolve, mdm, tables
from millrace.operators.tables import Audit

NOW = datetime.datetime(2024, 5, 1)


def c(name):
    return Column("t", name)


def test_normalize_and_parse(spark):
    df = spark.createDataFrame([("1,234.50", "2024-02-30", "2024-01-01T00:00:00.5Z", " a\x00b "), ("x", "2024-02-29T01", "2024-01-01 02:03:04+02:00", "  "), (None, "", None, None)], "n string, d string, t string, s string")
    out = cells.normalize(df, {"n": "NUMBER", "d": "DATE", "t": "TIMESTAMP", "s": "TEXT"}).collect()
    assert [None if r.n is None else float(r.n) for r in out] == [1234.5, None, None]
    assert [r.d for r in out] == [None, datetime.date(2024, 2, 29), None]
    assert [r.t for r in out] == [datetime.datetime(2024, 1, 1, 0, 0, 0, 500000), datetime.datetime(2024, 1, 1, 2, 3, 4), None]
    assert [r.s for r in out] == ["ab", None, None] and [r._bad for r in out] == [["d"], ["n"], []]
    crm = spark.createDataFrame([("7", "TRUE", "2024-01-02T03:04:05.000+0000", "10:00:00Z", "1.5"), ("", "no", "bad", "x", "")], "i string, b string, m string, t string, x string")
    one, two = cells.parse_typed(crm, {"i": "int", "b": "boolean", "m": "datetime", "t": "time", "x": "decimal"}).collect()
    assert (one.i, one.b, one.t, float(one.x)) == (7, True, "10:00:00", 1.5) and one.m is not None
    assert (two.i, two.b, two.m, two.t, sorted(two._bad)) == (None, False, None, None, ["m", "t"])


def test_names_and_checks(spark):
    assert [cells.snake_name(n) for n in ("accountName", "HTTPStatus2Code", "Address1Line", "2nd", "order", "a  b!", " ", "a__b", "date", "size")] == ["ACCOUNT_NAME", "HTTPSTATUS_2_CODE", "ADDRESS_1_LINE", "C_2_ND", "ORDER_COL", "A_B", "COL", "A__B", "DATE", "SIZE"]
    assert [cells.snake_name("minus", "_TBL"), cells.snake_name("joinedOrders", max_len=7), cells.snake_name("procedure", max_len=9)] == ["MINUS_TBL", "JOINED", "PROCE_COL"]
    with pytest.raises(ValueError):
        cells.snake_columns(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))
    ok, bad = cells.enforce_not_null(spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), ["k", "v"])
    assert [r.k for r in ok.collect()] == [2] and [(r.k, r._error) for r in bad.collect()] == [(1, "v is null")]
    ok, bad = cells.enforce_lengths(spark.createDataFrame([("ab", "1.23"), ("abcd", "1234.5"), (None, None)], "s string, n string"), {"s": 3, "n": (4, 2)})
    assert ok.count() == 2 and bad.first()._error == "s is longer than 3, n does not fit 4,2"
    patch = cells.prepare_patch(spark.createDataFrame([(1, None, None)], "a int, b int, c int"), ["c"]).first()
    assert patch._set == ["a", "c"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "a", None, "me", None, "me"), (2, "b", None, "me", None, "me"), (None, "n", None, "me", None, "me")], "id int, v string, created_at timestamp, created_by string, updated_at timestamp, updated_by string")


def rows_of(df):
    return sorted([(r.id, r.v) for r in df.collect()], key=repr)


def test_upsert_rules(spark, table):
    source = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1), (None, "m", 1)], "id int, v string, seq int")
    out = tables.upsert(table, source, "id", "seq", Audit("you", NOW))
    assert rows_of(out) == sorted([(1, "a"), (2, "new"), (3, "c"), (None, "n"), (None, "m")], key=repr)
    by = {r.v: (r.created_by, r.updated_by, r.updated_at) for r in out.collect()}
    assert by["new"] == ("me", "you", NOW) and by["c"] == ("you", "you", NOW) and by["a"] == ("me", "me", None)
    with pytest.raises(ValueError, match="order_by"):
        tables.upsert(table, source, "id")
    assert tables.upsert(table, source.select("id", "v"), None).count() == 7
    entity = Entity("t", [Column("t", "id", primary_key=True), Column("t", "v", unique=True)])
    assert tables.upsert_external(table, spark.createDataFrame([(9, "a")], "id int, v string"), catalog=Catalog([entity])).where("v = 'a'").first().id == 9


def test_update_insert_delete(spark, table):
    with pytest.raises(ValueError):
        tables.update(table, [], [Assignment(c("v"), "x")])
    assert rows_of(tables.update(table, [Operation(c("id"), ">", 1)], [Assignment(c("v"), c("created_by"))])) == sorted([(1, "a"), (2, "me"), (None, "n")], key=repr)
    source = spark.createDataFrame([(1, "z"), (5, "y")], "key int, v string")
    assert rows_of(tables.update(table, [Operation(c("id"), "=", Field("key"))], None, source)) == sorted([(1, "z"), (2, "b"), (None, "n")], key=repr)
    assert rows_of(tables.delete(table, [Operation(c("id"), ">", 1)])) == sorted([(1, "a"), (None, "n")], key=repr)
    with pytest.raises(ValueError):
        tables.delete(table)
    assert tables.delete(table, all_rows=True).count() == 0
    assert rows_of(tables.delete_matching(table, spark.createDataFrame([(1, "a"), (2, "x")], "id int, v string"))) == sorted([(2, "b"), (None, "n")], key=repr)
    new = tables.insert(table, spark.createDataFrame([("q",)], "w string"), [Assignment(c("v"), Field("w")), Assignment(c("id"), 7)], Audit("you", NOW)).where("id = 7").first()
    assert (new.v, new.created_by, new.updated_at) == ("q", "you", NOW)
    with pytest.raises(ValueError):
        tables.insert(table, spark.createDataFrame([(1,)], "unknown int"))
    assert rows_of(tables.ingest(table, source.withColumnRenamed("key", "id"), "update", [], ["v"], "id")) == sorted([(1, "z"), (2, "b"), (None, "n")], key=repr)
    assert tables.ingest(table, source.withColumnRenamed("key", "id"), "delete", [], [], "id").count() == 2
    joined = Catalog([Entity("t"), Entity("o", [Column("o", "x")])], [Join(c("id"), Column("o", "x"))], [Operation(Column("o", "x"), "=", 2)], assignments=[Assignment(c("v"), None)])
    assert rows_of(tables.delete_joined(joined, {"t": table, "o": spark.createDataFrame([(2,), (1,)], "x int")}, ["id"])) == sorted([(1, "a"), (None, "n")], key=repr)


def test_alignment(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, "Y"), ("x", None, "false")], "a string, b int, f string")
    wanted = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.LongType(), False), T.StructField("f", T.BooleanType()), T.StructField("d", T.DateType(), False)])
    assert {(r.a, r.b, r.f, r.d) for r in evolve.align(df, wanted).collect()} == {(1, 5, True, datetime.date(1970, 1, 1)), (None, 0, False, datetime.date(1970, 1, 1))}
    assert evolve.align(df, wanted, add=False).columns == ["a", "b", "f"]
    text = lambda n: T.StructField("a", T.StringType(), True, {"max_length": n})
    assert (evolve.column_action(text(5), text(9)), evolve.column_action(text(9), text(5)), evolve.column_action(T.StructField("a", T.StringType()), text(5))) == ("modify", "none", "none")
    with pytest.raises(ValueError):
        evolve.drop_column(df, "a")
    with pytest.raises(ValueError):
        evolve.drop_column(df.withColumn("created_by", F.lit(1)), "created_by", confirm=True)
    assert evolve.upsert_column(df, T.StructField("z", T.IntegerType(), False)).first().z == 0
    entity = evolve.retarget(Entity("acc", [Column("acc", "id", type="int64", primary_key=True), Column("acc", "odd")]), "ns")
    assert entity.name == "ACC" and [x.name for x in entity.columns] == ["id"] and not entity.columns[0].primary_key
    good, base = spark.createDataFrame([(1, "a")], "id int, v string"), str(tmp_path / "wh")
    first = evolve.migrate(spark, {"good": good, "bad": good.unionAll(good), "skipped": good}, base, {"good": ["id"], "bad": ["id"]}, ["GOOD", "bad"])
    assert {r.entity: r.status for r in first.collect()} == {"good": "ok", "bad": "error"} and evolve.fan_out_status(first) == 207
    evolve.migrate(spark, {"good": spark.createDataFrame([(1, "b", 2.0), (2, "c", None)], "id int, v string, w double")}, base, {"good": ["id"]})
    assert {tuple(r) for r in evolve.latest_version(spark, f"{base}/GOOD")[0].select("id", "v", "w").collect()} == {(1, "b", 2.0), (2, "c", None)}
    objects = spark.createDataFrame([("Account", True, True, True, False), ("AccountHistory", True, True, True, True), ("Hidden", True, True, False, False)], "name string, queryable boolean, retrieveable boolean, layoutable boolean, searchable boolean")
    assert [r.name for r in evolve.migratable(objects).collect()] == ["Account"]


@pytest.fixture(scope="module")
def master(spark):
    lookup = [(1, "GENDER", "MALE"), (2, "GENDER", "UNKNOWN"), (10, "MAR_STATUS", "UNKNOWN"), (21, "NAME_PREFIX", "DR"), (41, "ADDRESS_TYPE", "HOME"), (51, "PHONE_TYPE", "MAIN"), (52, "PHONE_TYPE", "WORK"), (61, "DELETED_STATUS", "ACTIVE"), (62, "DELETED_STATUS", "GONE")]
    t = {"mq_lookup": spark.createDataFrame(lookup, "lookup_id long, category string, lookup_desc string")}
    t["employee"] = spark.createDataFrame([("e1", "111"), ("e2", "222"), ("e3", "333")], "employee_id string, ssn string")
    people = [(1, "e1", "Ann", 61), (2, "e2", "Bob", 61), (3, "e3", "Cid", 62)]
    t["demographic"] = spark.createDataFrame(
        [(i, e, n, None, "L", None, None, datetime.date(1980, 1, 2), None, 2, 10, None, s, None, None, None, None) for i, e, n, s in people],
        "demographic_id long, employee_id string, first_name string, middle_name string, last_name string, prefix_id long, suffix_id long, birthdate date, dt_of_death date, gender_id long, mar_status_id long, email_addr string, deleted_status long, created_at timestamp, created_by string, updated_at timestamp, updated_by string",
    )
    t["phone"] = spark.createDataFrame([(7, 1, "555", None, 51, None, None, None, None), (8, 1, "556", None, 52, None, None, None, None)], "phone_id long, demographic_id long, phone string, phone_ext string, phone_type_id long, created_at timestamp, created_by string, updated_at timestamp, updated_by string")
    t["address"] = spark.createDataFrame([(5, 1, "S", None, None, None, "C", None, None, None, None, 41, None, None, None, None)], "address_id long, demographic_id long, address1 string, address2 string, address3 string, address4 string, city string, county string, state string, postal string, country string, address_type_id long, created_at timestamp, created_by string, updated_at timestamp, updated_by string")
    return t


def test_master_data(spark, master):
    people = mdm.snapshot(master)
    assert {(r.employee_id, r.phone, r.city, r.gender) for r in people.collect()} == {("e1", "555", "C", "UNKNOWN"), ("e2", None, None, "UNKNOWN")}
    same = '"first_name":"Ann","last_name":"L","birthdate":"1980-01-02","phone":"555","address1":"S","city":"C"'
    payload = [
        f'[{{"mq_id":1,"employee_id":"e1",{same}}}, {{"mq_id":2,"employee_id":"nobody"}}]',
        '[{"mq_id":3,"employee_id":"e2","first_name":"Rob","last_name":"L","phone":"777","name_prefix":"Dr"}]',
        '[{"mq_id":4,"employee_id":"e2","first_name":"Robert","last_name":"L","phone":"778","mq_status":500}]',
        "not json",
        '[{"mq_id":5}]',
    ]
    inbound, rejects = mdm.load_json(spark.createDataFrame([(p,) for p in payload], "payload string"))
    assert rejects.count() == 2 and {r.mq_id: r.mq_status for r in inbound.collect()} == {1: 202, 2: 202, 3: 202, 4: 500}
    assert {r.mq_status for r in mdm.reprocess(inbound).collect()} == {202}
    done = mdm.classify(mdm.delta(mdm.enrich(inbound, master["mq_lookup"], people)))
    status = {r.mq_id: (r.mq_status, r.demographic_id, r.phone_id, r.gender_id, r.gender, r.name_prefix_id) for r in done.collect()}
    assert status == {1: (304, 1, 7, 2, None, None), 2: (404, None, None, 2, None, None), 3: (200, 2, None, 2, None, 21), 4: (200, 2, None, 2, None, None)}
    demographic, address, phone = mdm.apply(done, master["demographic"], master["address"], master["phone"], Audit("job", NOW))
    assert {(r.demographic_id, r.first_name, r.updated_by) for r in demographic.collect()} == {(1, "Ann", None), (2, "Robert", "job"), (3, "Cid", None)}
    assert sorted((r.phone_id, r.demographic_id, r.phone) for r in phone.collect()) == [(7, 1, "555"), (8, 1, "556"), (9, 2, "778")]
    assert sorted(r.address_id for r in address.collect()) == [5, 6]
    back = {r.mq_id: r for r in mdm.write_back(inbound, done, Audit("job", NOW)).collect()}
    assert (back[3].mq_status, back[3].name_prefix_id, back[2].mq_status, back[2].gender_id) == (200, 21, 404, None) and back[1].mq_demographic_hash
    census = spark.createDataFrame([(1, 2, "e2", "Bob", None, None)], "census_id long, demographic_id long, employee_id string, first_name string, updated_at timestamp, updated_by string")
    assert mdm.refresh_census(census, done, Audit("job", NOW)).first().first_name == "Robert"
    assert mdm.classify(mdm.delta(mdm.enrich(inbound, master["mq_lookup"], people)), F.col("mq_id") == 3).where("mq_status = 500").count() == 1
    assert mdm.take(inbound, 202, 2, 2).count() <= 2 and mdm.take(inbound).count() == 3
    log = mdm.errors(rejects, "load", NOW)
    assert mdm.errors_since(log, NOW).count() == 2 and mdm.clear(log).count() == 0
    assert mdm.outbound(people, people).count() == 4 and mdm.outbound(people, people, reload=True).count() == 2


def test_registered_queries_have_one_name_each():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
