import json
import random

import pytest
from pyspark.sql import functions as F

from qaspark.functions import answers as A
from qaspark.functions import prompts as P
from qaspark.operators import judging as J
from qaspark.operators import metrics as M
from qaspark.operators import similarity as D
from qaspark.plans import grading, tasks
from qaspark.sources import markdown, responder, runs

RECORD = "sample_id string, repeat int, prompt_type string, content string, correct_letters array<string>, correct_answers array<string>, lang string, sub_questions array<struct<subtype: string, correct_letters: array<string>>>"


def test_judging_cases(spark):
    subs = [("e", ["A"]), ("c", ["C"])]
    rows = [
        ("1", 0, "mcq_single", r"\boxed{b}", ["B"], None, "en", None),
        ("2", 0, "mcq_multi", r"\boxed{c,a,c}", ["A", "C"], None, "en", None),
        ("3", 0, "mcq_grouped", r"\boxed{B} \boxed{A} \boxed{C}", None, None, "en", subs),
        ("4", 0, "mcq_grouped", r"\boxed{A}", None, None, "en", subs),
        ("5", 0, "mcq_grouped", r"\boxed{A}", None, None, "en", []),
        ("6", 0, "open", r"\boxed{the cat}", None, ["a cat"], "en", None),
        ("7", 0, "open", "猫在家", None, ["猫"], "zh", None),
        ("8", 0, "open", None, None, None, None, None),
        ("9", 0, "mcq_multi", "no letters: 1", ["A"], None, "en", None),
        ("10", 0, None, r"\boxed{}", None, None, None, None),
    ]
    got = {r["sample_id"]: (r["is_correct"], r["error_reason"]) for r in J.graded(spark.createDataFrame(rows, RECORD), "legacy").collect()}
    assert got["1"] == got["2"] == got["3"] == got["6"] == (True, None) and got["7"] == (True, None)
    assert got["4"] == (False, "extraction_failed") and got["5"] == (False, "no_sub_questions")
    assert got["8"] == (False, "content_none") and got["9"] == got["10"] == (False, "extraction_failed")


def test_free_answers(spark):
    rows = [("x\nANSWER: b, d", "mcq_single", "B"), ("ANSWER: d,b", "mcq_multi", "B,D"), ("zzz", "mcq_single", "A"), (None, "mcq_multi", "A")]
    t = spark.createDataFrame(rows, "t string, k string, want string")
    offered = F.array(*map(F.lit, "ABD"))
    assert t.filter(F.array_join(J.offered_letters(F.col("t"), offered, F.col("k")), ",") != F.col("want")).isEmpty()
    mean, ok = J.rubric(F.col("s"), 7.0)
    s = spark.createDataFrame([([8.0, None, 6.0],), ([None],), ([],)], "s array<double>").select(mean.alias("m"), ok.alias("o"))
    assert [tuple(r) for r in s.collect()] == [(7.0, True), (None, False), (None, False)]


def test_splits_are_trimmed_of_white_space_alone(spark):
    v = spark.createDataFrame([(True, [" 0x ", "1y", " "])], "is_correct boolean, k array<string>")
    assert {r["split"] for r in M.dimensions(v, {"d": F.col("k")}).collect()} == {"0x", "1y"}


def test_meta_values(spark):
    meta = {"a": [" ", " x ", 3], "b": False, "c": 0, "d": "", "e": None, "f": {"g": 1}}
    row = spark.createDataFrame([(json.dumps(meta),)], "j string").select(F.parse_json("j").alias("meta"))
    want = {"a": "x", "b": "False", "c": "0", "d": "unknown", "e": "unknown", "f": "unknown", "z": "unknown"}
    assert row.select(*(tasks.first_of(k).alias(k) for k in want)).first().asDict() == want
    assert row.select(tasks.listed("a").alias("x")).first()[0] == ["x", "3"]


@pytest.mark.parametrize("task", tasks.TASKS)
def test_every_task_on_no_rows_and_on_bare_rows(spark, task):
    schema = "sample_id string, prompt_type string, is_correct boolean, meta variant, options array<struct<letter: string>>, judge_score double, sub_results array<struct<subtype: string, is_correct: boolean>>"
    bare = spark.range(2).select(F.lit(None).cast("string").alias("sample_id"), F.lit("open").alias("prompt_type"), (F.col("id") == 0).alias("is_correct"), F.parse_json(F.lit("{}")).alias("meta"), F.lit(None).cast("array<struct<letter: string>>").alias("options"), F.lit(None).cast("double").alias("judge_score"), F.lit(None).cast("array<struct<subtype: string, is_correct: boolean>>").alias("sub_results"))
    assert bare.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    got = {(r["scope"], len(r["path"])): (r["acc"], r["n"]) for r in tasks.evaluated(bare, task).filter(F.size("path") == 0).collect()}
    assert got["all", 0] == (0.5, 2)
    tasks.evaluated(bare.limit(0), task).collect()


def _kept(texts, least):
    grams = lambda t: {t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set()
    kept, out = [], {}
    for k, t in enumerate(texts):
        g = grams(" ".join((t or "").split()))
        out[k] = not g or all(len(g & o) / len(g | o) < least for o in kept)
        if out[k] and g:
            kept.append(g)
    return out


def test_dedup_against_brute_force(spark):
    dice = random.Random(5)
    base = ["".join(dice.choice("abcde ") for _ in range(60)) for _ in range(12)]
    texts = [None, "", "abc", "abc", "😀😀😀😀😀a", "😀😀😀😀😀a"] + base
    for _ in range(60):
        t = dice.choice(texts[4:])
        at = dice.randrange(len(t))
        texts.append(t[:at] + dice.choice("xyz") + t[at + 1 :])
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for least in (0.85, 0.6):
        got = {r["id"]: r["kept"] for r in D.deduplicated(rows, "id", "text", least).collect()}
        assert got == _kept(texts, least)
    found = D.leaks(rows, rows.filter("id < 8"), "id", "id", "text", 0.6)
    assert {r["id"]: r["of"] for r in found.collect()}[3] == 2


def test_dedup_writes_no_grams(spark):
    from pathlib import Path

    from qaspark.operators.lineage import folder

    dice = random.Random(6)
    words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randrange(2, 9))) for _ in range(900)]
    texts = [" ".join(dice.choice(words) for _ in range(dice.choice((300, 340, 400)))) for _ in range(60)]
    for t in texts[:40]:  # copies with 2 to 60 words changed lie on both sides of the threshold
        w = t.split()
        for at in dice.sample(range(len(w)), dice.randrange(2, 60)):
            w[at] = dice.choice(words)
        texts.append("  ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").cache()
    there = Path(folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in there.rglob("*.parquet") if p.is_file())
    before = size()
    _, _, pairs = D.near_pairs(rows, "id", "text", 0.85)
    sets = [{u[i : i + 4] for i in range(len(u) - 3)} for u in (" ".join(t.split()) for t in texts)]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and 5 < len(want) < 40
    got = {r["id"]: r["kept"] for r in D.deduplicated(rows, "id", "text").collect()}
    assert got == _kept(texts, 0.85)
    assert size() - before < 2 * 3 * sum(map(len, sets))  # two runs; grams alone take 8 bytes each


def test_calls(spark, tmp_path):
    tries = []

    def flaky(row):
        tries.append(1)
        if len(tries) < 3:
            raise responder.CallError("OVERLOADED")
        return {"content": "x"}

    got = responder.answered(flaky, {}, pause=0)
    assert got["ok"] and got["attempts"] == 3
    assert responder.answered(lambda r: (_ for _ in ()).throw(responder.CallError("INTERNAL")), {}, pause=0)["attempts"] == 1
    assert [responder.code_of(s) for s in (400, 404, 429, 503, 599)] == ["INVALID_REQUEST", "INTERNAL", "OVERLOADED", "OVERLOADED", "MODEL_ERROR"]
    rows = spark.createDataFrame([(1, "abc"), (2, "abcde")], "id long, prompt string")
    for _ in range(2):  # the second time only the failed one is asked
        out = responder.ask(rows, grading.echo, "id", str(tmp_path / "a"))
    assert {r["id"]: r["content"] for r in out.collect()} == {1: "abc", 2: None}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert responder.usage(out).first()["succeeded"] == 1


def test_runs(spark, tmp_path):
    for exp, files in (("exp_1", runs.FILES), ("exp_2", ("prediction.jsonl",))):
        folder = tmp_path / "ds" / "m" / exp
        folder.mkdir(parents=True)
        for f in files:
            (folder / f).write_text('{"sample_id": "s", "is_correct": true}\n{"sample_id": "s", "is_correct": false}\n')
    found = runs.catalog(spark, str(tmp_path))
    assert runs.latest(found).first()["exp"] == "exp_1" and runs.latest(found, "prediction.jsonl").first()["exp"] == "exp_2"
    verdicts = runs.read_verdicts(spark, str(tmp_path / "ds/m/exp_1/detailed_metrics.jsonl"))
    assert [(r["repeat"], r["is_correct"]) for r in verdicts.collect()] == [(0, False)]
    (tmp_path / "old.json").write_text(json.dumps({"all_metrics": [{"per_sample_results": [{"sample_id": "s", "is_correct": True}]}]}))
    assert runs.read_verdicts(spark, str(tmp_path / "old.json"), legacy=True).first()["is_correct"]
    m = spark.createDataFrame([([], 0.5, 2), ([("a", "x")], 1.0, 1), ([("a", "x"), ("b", "y")], 1.0, 1)], "path array<struct<dim: string, split: string>>, acc double, n long")
    assert runs.tree(m) == {"acc": 0.5, "n": 2, "dimensions": {"a": {"x": {"acc": 1.0, "n": 1, "dimensions": {"b": {"y": {"acc": 1.0, "n": 1}}}}}}}


def test_labels_and_pages(spark):
    known = spark.createDataFrame([("m/a",), ("n/a",), ("n/b",), ("o",), ("o/a",)], "label string")
    raw = spark.createDataFrame([("m",), ("n",), ("o",), ("p",)], "label string")
    assert {r[0]: r[1] for r in markdown.resolved(raw, known).collect()} == {"m": "m/a", "n": "n", "o": "o", "p": "p"}
    table = spark.createDataFrame([("a|b", None), ("<c>", "1")], "x string, y string")
    assert markdown.as_markdown(table).splitlines()[2] == "| a\\|b | - |" and "&lt;c&gt;" in markdown.as_html(table, "t")
    assert markdown.cells(spark.createDataFrame([("f", None), ("g", "| a |\n|---|\n")], "file string, value string")).isEmpty()


def test_prompts(spark):
    text = P.filled(F.lit("{a} {b} {c}"), {"a": F.lit("{b}"), "b": F.lit(None).cast("string")})
    assert spark.range(1).select(text).first()[0] == "{b}  {c}"
    answer = F.struct(F.array(F.lit("r")).alias("correct_answers"), F.array(F.lit("w"), F.lit("v")).alias("wrong_answers"))
    s = spark.range(1).select(F.lit("s").alias("sample_id"), F.lit("st").alias("story"), F.lit("q").alias("question"), answer.alias("answer"), F.parse_json(F.lit('{"lang": "zh-CN"}')).alias("meta"))
    rows = P.prepared(s, "d", P.Protocol("del_tom")).collect()
    assert len(rows) == 8 and all(r["correct_letters"] == ["A"] and "选项：\nA. r" in r["prompt"] for r in rows)
    assert P.probes(P.prepared(s, "d", P.Protocol())).count() == 3
    with pytest.raises(ValueError):
        P.Protocol("other")
    assert spark.range(1).select(A.extracted(F.lit("a"), "direct")).first()[0] == "a"
