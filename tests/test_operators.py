"""Edge cases of curation, feedback, synthesis, judges, reports, charts and sources that the queries' data lack."""

import json

import pytest
from pyspark.sql import functions as F

from qaspark.functions import prompts as P
from qaspark.operators import badcases, board, charts, curation, feedback, report, synthesis
from qaspark.operators import open_judges as O
from qaspark.sources import tables

PATH = "array<struct<dim: string, split: string>>"


def test_labels_without_any_phase_row(spark):
    samples = spark.createDataFrame([(1,), (2,)], "row_id long")
    trials = spark.createDataFrame([(1, "all_failed")], "row_id long, bucket string")
    none = spark.createDataFrame([], "row_id long, answerable boolean")
    assert {r["row_id"]: (r["label"], r["repair_type"]) for r in curation.labelled(samples, trials, none, None).collect()} == {1: ("bad", "unanswerable"), 2: ("bad", "unanswerable")}
    assert {r["label"] for r in curation.labelled(samples, None, None, None).collect()} == {"medium"}
    assert curation.labelled(samples.limit(0), trials, none, None).isEmpty()


def test_repair_keeps_history(spark):
    one = F.struct(F.array(F.lit("a")).alias("correct_answers"), F.array().cast("array<string>").alias("wrong_answers"))
    asked = spark.range(2).select(F.col("id").alias("row_id"), F.lit("s").alias("story"), F.lit("q").alias("question"), one.alias("answer"), F.lit("easy").alias("repair_type"), F.expr("array(named_struct('iter', 1, 'repair_type', 'shortcut'))").alias("history"), F.lit("x").alias("_rank"))
    replies = spark.createDataFrame([(0, "S", "Q", ["r"], None), (1, "S", "Q", [], ["w"])], "row_id long, story string, question string, correct_answers array<string>, wrong_answers array<string>")
    rows = curation.repaired(asked, replies, 2).collect()
    assert [(r["row_id"], r["story"], r["answer"]["wrong_answers"], [h["iter"] for h in r["history"]], r["_rank"]) for r in rows] == [(0, "S", [], [1, 2], "x")]


def test_feedback_edges(spark):
    p = spark.createDataFrame([("m", -1, "a", 0, "A"), ("m", None, "b", 0, "A"), ("m", 3, "c", 0, None)], "model string, sample_index long, sample_id string, repeat int, content string").withColumn("correct_letters", F.array(F.lit("a")))
    kept = feedback.aligned(p)
    assert [r["sample_id"] for r in kept.collect()] == ["c"]
    said = spark.createDataFrame([("m", "c", 0, True), ("m", "c", 0, False)], "model string, sample_id string, repeat int, is_correct boolean")
    assert [r["difficulty"] for r in feedback.wrong_cases(feedback.judged(kept, said)).collect()] == [1]
    assert feedback.drop_rates(spark.createDataFrame([], "drop_reason string")).first()["test_drop_rate"] == 0.0


def test_shapes_of_nothing(spark):
    row = spark.createDataFrame([("1", "s", "no options here", "b", None)], "meta_id string, story string, question string, correct_letter string, meta_ability string")
    got = synthesis.shaped(row, "inline").first()
    assert got["answer"]["correct_answers"] == ["B"] and got["answer"]["wrong_answers"] == []
    with pytest.raises(ValueError):
        synthesis.shaped(row, "unheard of")
    assert spark.range(1).select(synthesis.likeliest(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(1.0)))).first()[0] == "a"


def test_structured_replies(spark):
    rows = spark.createDataFrame([('{"score": 7, "reason": "x"}',), ('{"score": "7", "reason": "x"}',), ("```\n{\"score\": 7.5, \"reason\": \"y\"}\n```",), ("[1]",), (None,), ('{"score": 7}',)], "c string")
    got = [r["s"] and r["s"]["score"] for r in rows.select(O.structured(F.col("c"), "score double, reason string").alias("s")).collect()]
    assert got == [7.0, None, 7.5, None, None, None]


def test_judge_contexts():
    for wrong in ({"mode": "mind"}, {"mode": "llm_simple"}, {"mode": "rubric", "ask": lambda r, k: r}):
        with pytest.raises(ValueError):
            O.Context(**wrong)


def test_paired_triples_and_schema_text(spark):
    from pyspark.sql.types import StringType, StructField, StructType

    answer = F.struct(F.array(F.lit("y")).alias("correct_answers"), F.array(F.lit("n")).alias("wrong_answers"))
    s = spark.createDataFrame([("1", "g", "cause"), ("2", "g", "emotion"), ("3", None, None)], "sample_id string, g string, k string")
    s = s.select("sample_id", F.lit("s").alias("story"), F.concat(F.lit("q"), "sample_id").alias("question"), answer.alias("answer"), F.to_variant_object(F.struct(F.col("g").alias("paired_group_id"), F.col("k").alias("question_subtype"))).alias("meta"))
    got = {r["sample_id"]: (r["question"], [x["subtype"] for x in r["sub_questions"] or []]) for r in P.paired(s, "d").collect()}
    assert got == {"g": ("q2 || q1", ["emotion", "cause"]), "3": ("q3", [])}
    schema = StructType([StructField("label", StringType(), False, {"comment": "what it is"}), StructField("note", StringType())])
    assert P.schema_text(schema, {"label": ("a", "b")}) == "Schema:\n  label: one of a, b, required - what it is\n  note: string, optional"


def test_signatures(spark):
    rows = spark.createDataFrame([("{}",), ('{"id": 3}',), ('{"b": [1, 2], "a": null, "dimension": []}',)], "m string").withColumn("meta", F.parse_json("m"))
    got = [tuple(r) for r in rows.select(badcases.signature(F.col("meta")), badcases.shown(F.col("meta"))).collect()]
    assert got[:2] == [("unknown", "unknown")] * 2 and got[2][0].startswith("a=None|b=") and got[2][1] == got[2][0]


def long_metrics(spark, rows):
    return spark.createDataFrame(rows, f"dataset string, model string, path {PATH}, acc double, n long")


def test_board_document(spark):
    m = long_metrics(spark, [("d", "m", [], 0.5, 4), ("d", "m", [("dim1", "a")], 0.25, 4)])
    text = board.document(board.entries(m, spark.createDataFrame([("d", "m", "2"), ("d", "a", "1")], "dataset string, model string, run_timestamp string")), "now")
    value = json.loads(text)
    assert [e["model"] for e in value["entries"]] == ["a", "m"]
    assert value["entries"][1]["breakdowns"]["dimension_level_1"]["items"] == [{"id": "a", "name": "a", "score": 0.25, "count": 4}]


def test_heat_needs_one_child(spark):
    m = long_metrics(spark, [("d", "m", [("x", "a")], 1.0, 1), ("d", "m", [("x", "a"), ("y", "1")], 1.0, 1), ("d", "m", [("x", "b")], 1.0, 1)])
    assert charts.heat_cells(m).isEmpty()
    m = m.unionByName(long_metrics(spark, [("d", "m", [("x", "b"), ("y", "2")], 0.0, 1)]))
    assert {(r["row"], r["column"]) for r in charts.heat_cells(m).collect()} == {("a", "1"), ("b", "2")}


def test_merged_table_text(spark):
    cells = lambda rows: spark.createDataFrame(rows, "row string, row_no int, column string, column_no int, cell string")
    new, old = cells([("r", 1, "new", 1, "1|2")]), cells([("r", 1, "old", 1, "3"), ("q", 2, "old", 1, "4")])
    assert report.as_table(report.merged_table(new, old), "m").splitlines() == ["| m | old | new |", "|---|---|---|", "| r | 3 | 1\\|2 |", "| q | 4 | - |"]


def test_arrow_folders_and_documents(spark, tmp_path):
    import pyarrow as pa

    for k, folder in enumerate(("a", "b/c")):
        path = tmp_path / "set" / folder
        path.mkdir(parents=True)
        table = pa.table({"x": [k, k + 10], "t": [["u"], None]})
        new = pa.ipc.new_stream if k else pa.ipc.new_file
        with pa.OSFile(str(path / "data.arrow"), "wb") as sink, new(sink, table.schema) as writer:
            writer.write_table(table)
    rows = tables.read_split(spark, str(tmp_path / "set"))
    assert sorted((r["x"], r["t"]) for r in rows.collect()) == [(0, ["u"]), (1, ["u"]), (10, None), (11, None)]
    assert tables.subsets(spark, str(tmp_path)) == ["set/a", "set/b/c"]
    (tmp_path / "ok.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert [tables.read_document(spark, str(tmp_path / n)) for n in ("ok.json", "bad.json", "none.json")] == [{"a": 1}, {}, {}]
    assert tables.located(spark, str(tmp_path / "nowhere")) == []


def test_checked_samples_raise(spark):
    good = "named_struct('correct_answers', array('x'), 'wrong_answers', array())"
    s = spark.sql(f"SELECT '1' AS sample_id, 's' AS story, 'q' AS question, {good} AS answer")
    assert tables.checked(s).count() == 1
    with pytest.raises(Exception, match="question_empty"):
        tables.checked(s.withColumn("question", F.lit(" "))).collect()


@pytest.mark.parametrize("dataset", sorted(P.HEADINGS))
def test_headed_bodies(spark, dataset):
    row = "'s' AS story, {} AS question, array({}) AS options, 'en' AS lang"
    some = spark.sql("SELECT " + row.format("'q'", "named_struct('letter', 'A', 'text', 'x')"))
    nothing = spark.sql("SELECT " + row.format("CAST(NULL AS string)", "")).withColumn("options", F.array().cast("array<struct<letter: string, text: string>>"))
    story, question, options, between = P.HEADINGS[dataset]
    body = P.HOOKS[dataset].body()
    assert some.select(body).first()[0] == f"{story}s{between}{question}q{between}{options}A. x"
    assert nothing.select(body).first()[0] == f"{story}s{between}{question}"


def test_report_has_every_bad_case(spark, tmp_path):
    from qaspark.plans import reporting

    orders = spark.range(100_500).select(F.col("id").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.when(F.col("id") % 500 == 0, "F").otherwise("O").alias("o_orderstatus"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert reporting.bad_case_report(spark, str(tmp_path)).count() == 100_500 - 201


def test_four_places_are_those_of_c(spark):
    ratios = [k / n for n in (32, 160, 800, 2000, 4000, 20000, 977) for k in range(n)]
    values = [*ratios, 0.99995, 0.99996, -0.03125, -0.0, 5e-324, 1e-5, 7.03125, 12345678.00005, 2.0**40 + 0.09375, 2.0**52 + 0.5, 1e18, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").coalesce(1)
    got = {r["i"]: r["cell"] for r in rows.select("i", report.formatted(F.col("v")).alias("cell")).collect()}
    assert [got[i] for i in range(len(values))] == ["-" if v is None else f"{v:.4f}" for v in values]


def test_sections_round_halves_as_sql_does(spark):
    import duckdb

    m = spark.createDataFrame([("m", [("d", str(k))], k / 160, 160) for k in range(160)], f"model string, path {PATH}, acc double, n long")
    got = {(r["row"], r["cell"]) for r in report.other_sections(m).collect()}
    assert got == set(duckdb.sql("SELECT k::VARCHAR, printf('%.4f', k / 160) FROM range(160) t(k)").fetchall())
