from pyspark.sql import functions as F

from qaspark.functions import answers as A
from qaspark.operators import metrics as M
from qaspark.operators import quality as Q
from qaspark.operators import selection as S
from qaspark.operators import similarity as D
from qaspark.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_extractors(spark):
    text = F.lit(r"A guess \boxed{c} then \box{ A, C }")
    assert one(spark, A.extracted(text, "direct")) == "c"
    assert one(spark, A.letter_set(A.extracted(text, "cot"))) == ["A", "C"]
    assert one(spark, A.extracted(F.lit(r"\boxed{\text{A}}"), "legacy")) is None
    assert one(spark, A.extracted(F.lit("the end b"), "cot")) == "b"
    assert one(spark, A.single_letter(A.extracted(F.lit(""), "cot"))) is None


def test_f1_and_thoughts(spark):
    f1 = A.token_f1(A.english_tokens(F.lit("The cat sat.")), A.english_tokens(F.lit("a cat")))
    assert abs(one(spark, f1) - 2 / 3) < 1e-12
    empty = F.array().cast("array<string>")
    assert one(spark, A.token_f1(empty, empty)) == 1.0 and one(spark, A.max_f1(empty, F.array().cast("array<array<string>>"))) == 0.0
    for text, want in (("<think>x</think> y", ("y", "x")), ("x</think>y", ("y", "x")), ("y<think>x", ("y", "x")), ("y", ("y", ""))):
        answer, thought = A.split_thoughts(F.lit(text))
        assert (one(spark, answer), one(spark, thought)) == want


def test_grams(spark):
    for text in ("", "abc", "abcd", "abcdabcdé"):
        want = {text[i : i + 4] for i in range(max(1, len(text) - 3))} if text else set()
        assert set(one(spark, A.grams(F.lit(text)))) == want


def test_decision_tree(spark):
    table = [("all_passed", None, None, "easy"), ("all_failed", True, True, "hard"), ("all_failed", None, None, "bad"), ("partial", False, True, "bad"), ("partial", True, True, "shortcut"), ("partial", True, None, "medium"), (None, True, False, "bad")]
    rows = spark.createDataFrame(table, "b string, a boolean, s boolean, want string")
    assert rows.filter(Q.label(F.col("b"), F.col("a"), F.col("s")) != F.col("want")).isEmpty()


def test_votes(spark):
    votes = spark.createDataFrame([(1, "B"), (1, "A"), (1, None), (2, None), (3, "C")], "s int, l string")
    assert {r[0]: r[1] for r in M.majority(votes, "s", "l").collect()} == {1: "A", 2: None, 3: "C"}
    chosen = spark.createDataFrame([(1, ["A"]), (1, ["A", "B"]), (1, None), (2, None)], "s int, c array<string>")
    assert {r[0]: r[1] for r in M.strict_majority(chosen, "s", "c").collect()} == {1: ["A"], 2: None}


def shares(spark, counts, reports, totals=None):
    rows = spark.createDataFrame([(d, n, (totals or {}).get(d, 0)) for d, n in counts.items()], "dim string, wrong long, total long")
    return {r["dim"]: r["share"] for r in S.apportioned(rows, "dim", "wrong", reports, "total" if totals else None).collect()}


def test_apportion(spark):
    assert shares(spark, {"a": 5, "b": 3, "c": 0}, 10) == {"a": 6, "b": 3, "c": 1}
    assert sum(shares(spark, {"a": 1, "b": 1, "c": 1}, 7).values()) == 7
    assert shares(spark, {"a": 2, "b": 9, "c": 1}, 2) == {"a": 1, "b": 1}
    # what is over goes round by round, from the lightest
    assert shares(spark, {"a": 86, "b": 10, "c": 10, "d": 1, "e": 4, "f": 86}, 7) == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 2}
    assert shares(spark, {"a": 0, "b": 0}, 5) == {"a": 3, "b": 2}
    assert shares(spark, {"a": 1, "b": 9}, 4, {"a": 1, "b": 90}) == {"a": 3, "b": 1}


def test_quotas(spark):
    def of(sizes, most):
        rows = spark.createDataFrame([(d,) for d, n in sizes.items() for _ in range(n)], "dim string")
        return {r["dim"]: r["quota"] for r in S.quotas(rows, "dim", most).collect()}

    assert of({"a": 15, "b": 15, "c": 15, "d": 15}, 10) == {"a": 3, "b": 3, "c": 2, "d": 2}
    assert of({"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2}
    assert of({"a": 97, "b": 1, "c": 1, "d": 1}, 4) == {"a": 3, "b": 1, "c": 1, "d": 1}
    rows = spark.createDataFrame([(d, k) for d, n in {"a": 97, "b": 1, "c": 1, "d": 1}.items() for k in range(n)], "dim string, k int")
    assert [tuple(r) for r in S.stratified(rows, "dim", [F.col("k")], 4).orderBy("dim", "k").collect()] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_required_members(spark):
    rows = [("g", "x", True), ("g", "y", True), ("g", "z", False), ("h", "x", True), ("i", "x", True), ("i", "y", None)]
    got = M.all_correct(spark.createDataFrame(rows, "g string, m string, is_correct boolean"), "g", "m", ["x", "y"]).first()
    assert (got["groups"], got["groups_correct"]) == (2, 1)


def test_dimension_key_and_tasks(spark):
    import pytest

    from qaspark.plans import tasks

    meta = spark.createDataFrame([("FanToM", '{"question_Type": "x"}'), ("FanToM", '{"id": "a__b__c"}'), ("mine", '{"dim": "1.1", "qtype": "Q1", "lang": "zh"}'), ("other", '{"Dimension": ["d"]}'), ("BigToM", "{}")], "d string, m string")
    keys = meta.withColumn("meta", F.parse_json("m")).select(S.dimension_key(F.col("d"), tasks={"mine": "rubric"}).alias("k")).collect()
    assert [r["k"] for r in keys] == ["x", "b", "1.1__Q1__zh", "d", "unknown"]
    assert tasks.task_of("mine", {"mine": "rubric"}).qualified == "review_pass"
    with pytest.raises(ValueError):
        tasks.task_of("nobody")


def test_greedy_chain(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r[0] for r in D.greedy_kept(rows, pairs, "id").collect()} == {1, 3}


def test_samples_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text('{"story": "s", "question": " ", "answer": {"correct_answers": [" "], "wrong_answers": []}, "meta": {"id": "m1"}}\n')
    rows = T.read_samples(spark, str(tmp_path / "s.json"))
    assert rows.first()["sample_id"] == "m1"
    assert T.violations(rows).first()["violations"] == ["question_empty", "no_correct_answer"]
    monkeypatch.setenv("QASPARK_X", "7")
    assert T.expanded({"a": ["${QASPARK_X}"]}) == {"a": ["7"]} and T.redacted({"api_key": 1, "b": [{"api_url": 2, "c": 3}]}) == {"b": [{"c": 3}]}


def test_registry_without_llm(spark):
    from qaspark.plans import registry

    assert registry.FLAGSHIP in registry.queries() and set(registry.oracle_sql()) <= set(registry.queries())
