"""The pipeline on driver rows, each stage held against the operator's own verdicts, and on odd rows."""

import corpus_pipeline as pipeline
from conftest import SF

from millrace.llm import decontaminate, jaccard, pseudonyms, toxicity


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count(), name
        before = spark.createDataFrame(after.collect(), after.schema)
    assert before.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    assert before.where("n_chars <> char_length(text)").isEmpty()
    encoded = pipeline.STAGES[-1][1](spark, before, SF)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert len(rows) == before.count() and all(len(r.ids) == r.n_tokens for r in rows.values())


def test_replacing_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.example", 3, "x"), (2, None, 4, "y")], "doc_id long, text string, n_chars long, id string")
    out = {r.doc_id: r for r in pseudonyms.replace_in(df, b"k", length_col="n_chars").collect()}
    assert out[1].text.endswith("@b.example") and out[1].id == "x" and out[1].n_chars == 16 and out[2].text is None


ODD = [(1, "a b c d e f g h i j k l m"), (1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l m"), (3, None), (4, ""), (None, "bad idiot"), (5, "bad idiot"), (6, "x " * 30000), (7, "n o p q r s t u v w x y z aa bb")]
CLASH = "doc_id long, text string, id string, _id long, tx long, component_id long, n_chars long"


def _odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "z", 1, 2, 3, 0) for i, t in rows], CLASH)


def test_filters_on_odd_rows(spark):
    model = toxicity.fit(["bad idiot"] * 9 + ["good day"] * 9, [1] * 9 + [0] * 9)
    bench = spark.createDataFrame([(1, "n o p q r s t u v w x y z"), (2, None), (3, "")], "item_id long, text string")
    for make, gone in ((lambda d: toxicity.filter_toxic(d, model), {None, 5}), (lambda d: decontaminate.drop_leaks(d, bench), {7})):
        out = make(_odd(spark))
        assert out.columns == _odd(spark).columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i, _ in ODD if i not in gone)
        assert make(_odd(spark, [])).count() == 0
    kept = jaccard.keep_one(_odd(spark))
    assert kept.columns == _odd(spark).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7]
    assert jaccard.keep_one(_odd(spark, [])).count() == 0


def test_filters_judge_rows_and_not_ids(spark):
    model = toxicity.fit(["bad idiot"] * 9 + ["good day"] * 9, [1] * 9 + [0] * 9)
    bench = spark.createDataFrame([(1, "n o p q r s t u v w x y z")], "item_id long, text string")
    good, bad, leak = "good day", "bad idiot", "n o p q r s t u v w x y z aa bb"
    df = _odd(spark, [(1, good), (1, bad), (1, leak), (None, good), (None, bad), (None, leak)])
    assert sorted((r.doc_id or 0, r.text) for r in toxicity.filter_toxic(df, model).collect()) == sorted((i, t) for i in (0, 1) for t in (good, leak))
    for chars in (8_000_000, 5):
        assert sorted((r.doc_id or 0, r.text) for r in decontaminate.drop_leaks(df, bench, block_chars=chars).collect()) == sorted((i, t) for i in (0, 1) for t in (good, bad))
