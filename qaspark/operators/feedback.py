"""Wrong answers of several models, gathered for diagnosis, and what becomes of synthesised samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions import answers as A


def aligned(predictions: DataFrame, index: str = "sample_index") -> DataFrame:
    """All models' predictions with a usable sample index: null and negative ones go."""
    return predictions.filter(F.col(index) >= 0)


def ruled(content: Column, letters: Column) -> Column:
    """Whether a response's letter, found by rule, is one of the right letters; nothing given is wrong."""
    return F.coalesce(F.array_contains(F.transform(letters, F.upper), A.guessed_letter(content)), F.lit(False))


def judged(predictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Predictions with is_correct: the judge's verdict on (model, sample_id, repeat), by rule where there is none.

    Of several verdicts on one answer a wrong one decides.
    """
    keys = ["model", "sample_id", "repeat"]
    said = verdicts.groupBy(*keys).agg(F.every("is_correct").alias("said"))
    return predictions.join(said, keys, "left").withColumn("is_correct", F.coalesce("said", ruled(F.col("content"), F.col("correct_letters")))).drop("said")


def wrong_cases(judged_: DataFrame, index: str = "sample_index") -> DataFrame:
    """One row for each wrong answer of any model, with the sample's difficulty: its wrong answers in all.

    Samples that nobody got wrong go. `rank` is the order of diagnosis: hardest first, then sample, model, repeat.
    """
    wrong = judged_.filter(~F.col("is_correct"))
    hard = wrong.groupBy(index).agg(F.count(F.lit(1)).alias("difficulty"))
    return wrong.join(hard, index)


def by_difficulty(index: str = "sample_index") -> list[Column]:
    return [F.col("difficulty").desc(), F.col(index), F.col("model"), F.col("repeat")]


def first_wrong(predictions: DataFrame, rows: DataFrame, index: str = "sample_index") -> DataFrame:
    """Of each sample with a wrong answer the first one, with the sample's row where there is one.

    A verdict that is missing counts as right.
    """
    wrong = predictions.filter((F.col(index) >= 0) & ~F.coalesce("is_correct", F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(index).orderBy("model", "repeat"))
    return wrong.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").join(rows, index, "left")


def worst(stats: DataFrame, n: int = 5) -> DataFrame:
    """The n dimensions of the highest error rate."""
    return stats.orderBy(F.col("error_rate").desc(), F.col(stats.columns[0])).limit(n)


def batched(cases: DataFrame, dim: str, order: list[Column], size: int) -> DataFrame:
    """Cases with the number of their batch within their dimension."""
    place = F.row_number().over(Window.partitionBy(dim).orderBy(*order))
    return cases.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def candidate_text(story: Column, question: Column, correct: Column, wrong: Column) -> Column:
    """What is compared for leaks: story, question and all options, white space collapsed, one space between."""
    plain = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))
    empty = F.array().cast("array<string>")
    parts = F.concat(F.array(story, question), F.coalesce(correct, empty), F.coalesce(wrong, empty))
    return F.array_join(F.filter(F.transform(parts, plain), lambda t: t != ""), " ")


def split(candidates: DataFrame, leaks: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Candidates with drop_reason: `leak:<item>` for those like a test item, `duplicate` for those that are not kept."""
    found = leaks.select(F.col(key).alias("_key"), F.concat(F.lit("leak:"), F.col("of").cast("string")).alias("_leak"))
    stay = kept.select(F.col(key).alias("_kept"), F.col("kept").alias("_stay"))
    out = candidates.join(found, F.col(key) == F.col("_key"), "left").join(stay, F.col(key) == F.col("_kept"), "left")
    return out.withColumn("drop_reason", F.coalesce("_leak", F.when(~F.coalesce("_stay", F.lit(True)), "duplicate"))).drop("_key", "_leak", "_kept", "_stay")


def drop_rates(marked: DataFrame) -> DataFrame:
    """(total_raw, dropped_test_dedup, passed_test_dedup, test_drop_rate, dropped_internal_dedup,
    passed_internal_dedup, internal_drop_rate, final_clean); rates to four places, 0 of nothing."""
    out = marked.agg(F.count(F.lit(1)).alias("total_raw"), F.count_if(F.coalesce(F.col("drop_reason").startswith("leak:"), F.lit(False))).alias("dropped_test_dedup"), F.count_if(F.coalesce(F.col("drop_reason") == "duplicate", F.lit(False))).alias("dropped_internal_dedup"))
    out = out.withColumn("passed_test_dedup", F.col("total_raw") - F.col("dropped_test_dedup")).withColumn("passed_internal_dedup", F.col("passed_test_dedup") - F.col("dropped_internal_dedup"))
    rate = lambda part, whole: F.round(A.safe_ratio(F.col(part), F.col(whole)), 4)
    return out.withColumn("test_drop_rate", rate("dropped_test_dedup", "total_raw")).withColumn("internal_drop_rate", rate("dropped_internal_dedup", "passed_test_dedup")).withColumn("final_clean", F.col("passed_internal_dedup"))
