"""Leaderboard entries from long metrics: breakdowns by dimension, the older flat fields, one JSON document.

Metrics are (dataset, model, path, acc, n), path an array of (dim, split); the empty path is the accuracy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Breakdown, its label, the dimensions on its path, its older field.
BREAKDOWNS: Sequence[tuple[str, str, tuple[str, ...], str]] = (
    ("dimension_level_1", "Dimension Level 1", ("dim1",), "by_dim1"),
    ("dimension_level_2", "Dimension Level 2", ("dim1", "dim2"), "by_dim2"),
    ("dimension_level_3", "Dimension Level 3", ("dim1", "dim2", "dim3"), "by_dim3"),
    ("question_type", "Question Type", ("qtype",), "by_qtype"),
    ("perspective", "Perspective", ("perspective",), "by_perspective"),
    ("length", "Length", ("length",), "by_length"),
    ("variant", "Variant", ("variant",), "by_variant"),
)
#: Names of question types.
TYPE_NAMES = {"Q1": "Single Choice", "Q2": "Multiple Choice", "Q3": "Judgment & Reasoning", "Q4": "Open Analysis"}
KEYS = ("dataset", "model")


def _dims(path: Column) -> Column:
    return F.transform(path, lambda s: s["dim"])


def breakdowns(metrics: DataFrame, names: Mapping[str, str] = TYPE_NAMES) -> DataFrame:
    """(dataset, model, breakdown, label, id, name, score, count): the splits of each breakdown.

    A split that several parents have is told by the last parent. `names` shows question types by name.
    """
    dims = F.array_join(_dims(F.col("path")), "/")
    kind, label = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for key, text, path, _ in BREAKDOWNS:
        kind, label = kind.when(dims == "/".join(path), key), label.when(dims == "/".join(path), text)
    split = F.get("path", F.size("path") - 1)["split"]
    rows = metrics.select(*KEYS, "path", "acc", "n", kind.alias("breakdown"), label.alias("label"), split.alias("id")).filter("breakdown IS NOT NULL AND (acc IS NOT NULL OR n IS NOT NULL)")
    last = rows.groupBy(*KEYS, "breakdown", "label", "id").agg(F.max_by(F.struct("acc", "n"), F.transform("path", lambda s: s["split"])).alias("v"))
    shown = F.col("id")
    for code, name in names.items():
        shown = F.when((F.col("breakdown") == "question_type") & (F.col("id") == code), name).otherwise(shown)
    return last.select(*KEYS, "breakdown", "label", "id", shown.alias("name"), F.col("v.acc").alias("score"), F.col("v.n").cast("long").alias("count"))


def older_fields(metrics: DataFrame) -> DataFrame:
    """(dataset, model, field, id, value) of the older flat form: scores and counts by split, mean scores of open answers."""
    field = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, _, _, name in BREAKDOWNS:
        field = field.when(F.col("breakdown") == key, name)
    both = F.array(F.struct(field.alias("field"), F.col("score").alias("value")), F.struct(F.concat(field, F.lit("_counts")).alias("field"), F.col("count").cast("double").alias("value")))
    flat = breakdowns(metrics).select(*KEYS, "id", F.explode(both).alias("f")).select(*KEYS, "f.field", "id", "f.value")
    scored = metrics.filter((F.size("path") == 1) & (F.get("path", F.lit(0))["dim"] == "q4_score")).withColumn("id", F.get("path", F.lit(0))["split"])
    all_ = F.array(F.struct(F.lit("q4_mean_score").alias("field"), F.col("acc").alias("value")), F.struct(F.lit("q4_count").alias("field"), F.col("n").cast("double").alias("value")))
    overall = scored.filter("id = 'overall'").select(*KEYS, F.lit("").alias("id"), F.explode(all_).alias("f")).select(*KEYS, "f.field", "id", "f.value")
    by_dim = scored.filter("id <> 'overall'").select(*KEYS, F.lit("q4_mean_score_by_dim").alias("field"), "id", F.col("acc").alias("value"))
    return flat.unionByName(overall).unionByName(by_dim).filter("value IS NOT NULL")


def entries(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each run (dataset, model, ...): accuracy, score of 100, correct, total, older fields, breakdowns."""
    whole = metrics.filter(F.size("path") == 0).select(*KEYS, F.col("acc").alias("accuracy"), (F.col("acc") * 100).alias("overall_score"), F.round(F.col("acc") * F.col("n")).cast("long").alias("correct"), F.col("n").cast("long").alias("total"))
    items = breakdowns(metrics).groupBy(*KEYS, "breakdown", "label").agg(F.array_sort(F.collect_list(F.struct("id", "name", "score", "count"))).alias("items"))
    items = items.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("breakdown", F.struct("label", "items").alias("of"))))).alias("breakdowns"))
    fields = older_fields(metrics).groupBy(*KEYS, "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "value")))).alias("values"))
    by_name = lambda a, b: F.when(a["field"] < b["field"], -1).when(a["field"] > b["field"], 1).otherwise(0)
    fields = fields.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values")), by_name)).alias("older"))
    return runs.join(whole, list(KEYS), "left").join(fields, list(KEYS), "left").join(items, list(KEYS), "left")


def document(entries_: DataFrame, generated_at: str) -> str:
    """The leaderboard as one JSON text, entries by dataset, model and time: one row for each published run."""
    import json

    order = [c for c in (*KEYS, "run_timestamp") if c in entries_.columns]
    rows = entries_.orderBy(*(F.coalesce(F.col(c), F.lit("")) for c in order)).select(F.to_json(F.struct("*")).alias("j"))
    return json.dumps({"generated_at": generated_at, "entries": [json.loads(r["j"]) for r in rows.toLocalIterator()]}, ensure_ascii=False, indent=2)
