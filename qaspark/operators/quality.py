"""The quality pipeline's relational steps: pass@k, targeting, decision tree, final merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.answers import english_tokens, max_f1, question_type

KEPT = ("hard", "medium")


def pass_at_k(trials: DataFrame, key: str) -> DataFrame:
    """(key, pass_at_k, k)."""
    return trials.groupBy(key).agg(F.count_if("is_correct").alias("pass_at_k"), F.count(F.lit(1)).alias("k"))


def bucket(passed: Column, k: Column) -> Column:
    return F.when(passed >= k, "all_passed").when(passed <= 0, "all_failed").otherwise("partial")


def threshold(k: Column, mode: str = "majority") -> Column:
    return {"majority": F.ceil(k / F.lit(2.0)).cast("int"), "any": F.lit(1), "all": k.cast("int")}[mode]


def shortcut(no_story: Column, no_question: Column, no_options: Column, need: Column) -> Column:
    """Two probes must reach the threshold, the third must miss it."""
    return (no_story >= need) | (no_question >= need) | (no_options < need)


def label(of_bucket: Column, answerable: Column, is_shortcut: Column) -> Column:
    yes = F.coalesce(answerable, F.lit(False))
    return (
        F.when(of_bucket == "all_passed", "easy")
        .when(of_bucket.isNull() | ~yes, "bad")
        .when(of_bucket == "all_failed", "hard")
        .when(F.coalesce(is_shortcut, F.lit(False)), "shortcut")
        .otherwise("medium")
    )


def repair_type(of_label: Column) -> Column:
    return F.when(of_label == "easy", "easy").when(of_label == "bad", "unanswerable").when(of_label == "shortcut", "shortcut")


def histogram(labels: DataFrame, column: str) -> DataFrame:
    """(column, n, share to four places)."""
    out = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def type_counts(samples: DataFrame, answer: str = "answer") -> DataFrame:
    """(total, open_count, mcq_count, question_type): how many questions are open, and what that makes the dataset."""
    open_ = question_type(F.col(f"{answer}.correct_answers"), F.col(f"{answer}.wrong_answers")) == "open"
    out = samples.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(open_, F.lit(False))).alias("open_count"))
    out = out.withColumn("mcq_count", F.col("total") - F.col("open_count"))
    mixed = F.format_string("Mixed (MCQ: %d, Open: %d)", "mcq_count", "open_count")
    return out.withColumn("question_type", F.when(F.col("open_count") == 0, "Multiple Choice").when(F.col("mcq_count") == 0, "Open QA").otherwise(mixed))


def open_correct(tokens: Column, golds: Column, least: Column | float, tokenised=english_tokens) -> Column:
    """Whether an open answer's best token F1 with a gold that is not blank reaches `least`."""
    return max_f1(tokens, F.transform(F.filter(golds, lambda g: F.trim(g) != ""), tokenised)) >= least


def keep_last(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
