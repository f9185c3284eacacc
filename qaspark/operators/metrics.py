"""Aggregates over graded answers, in long form: one row per dimension and split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.answers import safe_ratio


def graded(predictions: DataFrame, content: Column, raw: Column, correct: Column) -> DataFrame:
    """Add is_correct and error_reason by rule: content_none, extraction_failed, wrong_answer or null."""
    empty = content.isNull() | (content == "")
    ok = F.coalesce(~empty & (raw == correct), F.lit(False))
    reason = F.when(empty, "content_none").when(raw.isNull(), "extraction_failed").when(~ok, "wrong_answer")
    return predictions.withColumn("is_correct", ok).withColumn("error_reason", reason)


def base_metrics(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    failed = F.count_if(F.coalesce(F.col("error_reason") == "extraction_failed", F.lit(False)))
    out = verdicts.groupBy(*by).agg(F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total"), failed.alias("extraction_failed"))
    return out.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total"))).withColumn("extraction_failed_rate", safe_ratio(F.col("extraction_failed"), F.col("total")))


def dimensions(verdicts: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """(dim, split, acc, n) of every dimension in one pass. A key is a string or an array of them (each counts)."""

    def entries(name: str, key: Column) -> Column:
        kind = verdicts.select(key.alias("k")).schema["k"].dataType.typeName()
        values = key if kind == "array" else F.array(key.cast("string"))
        values = F.filter(F.transform(values, lambda x: F.trim(x)), lambda v: v.isNotNull() & (v != ""))
        values = F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.array(F.lit("unknown"))).otherwise(values)
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("dim"), v.alias("split")))

    each = verdicts.select("is_correct", F.explode(F.concat(*(entries(n, k) for n, k in keys.items()))).alias("d"))
    out = each.groupBy("d.dim", "d.split").agg(F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("n"))
    return out.select("dim", "split", safe_ratio(F.col("correct"), F.col("n")).alias("acc"), "n")


def nested(verdicts: DataFrame, path: Sequence[str]) -> DataFrame:
    """(level, columns of the path, acc, n): every prefix of the path, deeper columns null."""
    sets = ", ".join(f"({', '.join(path[: k + 1])})" for k in range(len(path)))
    view = verdicts.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in path), "is_correct")
    deep = " + ".join(f"(1 - grouping({c}))" for c in path)
    sql = f"SELECT cast({deep} AS int) AS level, {', '.join(path)}, count_if(is_correct) AS correct, count(*) AS n FROM {{view}} GROUP BY GROUPING SETS ({sets})"
    out = verdicts.sparkSession.sql(sql, view=view)
    return out.withColumn("acc", safe_ratio(F.col("correct"), F.col("n"))).drop("correct")


def all_correct(verdicts: DataFrame, group: str, member: str, required: Sequence[str]) -> DataFrame:
    """(groups, groups_correct, acc): a group counts if it has all required members, and is right if all of these
    are; members that are not required decide nothing."""
    wanted = verdicts.filter(F.col(member).isin(*required))
    # one column for each required member: nothing is collected, a group of any size stays one row
    groups = wanted.groupBy(group).agg(*(F.bool_and(F.when(F.col(member) == m, F.coalesce("is_correct", F.lit(False)))).alias(f"m{k}") for k, m in enumerate(required)))
    ok = F.array(*(F.col(f"m{k}") for k in range(len(required))))
    groups = groups.select(F.forall(ok, lambda x: x.isNotNull()).alias("whole"), F.forall(ok, lambda x: F.coalesce(x, F.lit(False))).alias("right")).filter("whole")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if("right").alias("groups_correct")).withColumn("acc", safe_ratio(F.col("groups_correct"), F.col("groups")))


def macro(verdicts: DataFrame, by: str) -> DataFrame:
    """(macro_acc, micro_acc, splits)."""
    per = verdicts.groupBy(by).agg(F.count_if("is_correct").alias("ok"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg(safe_ratio(F.col("ok"), F.col("n"))).alias("macro_acc"), safe_ratio(F.sum("ok"), F.sum("n")).alias("micro_acc"), F.count(F.lit(1)).alias("splits"))


def over_repeats(metrics: DataFrame, path: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over the repeats in which a path occurs."""
    return metrics.groupBy(*path).agg(*(F.avg(F.col(v).cast("double")).alias(v) for v in values))


def majority(votes: DataFrame, sample: str, letter: str) -> DataFrame:
    """(sample, vote): the most frequent letter, the smallest on a tie, null if none voted."""
    counted = votes.groupBy(sample, letter).agg(F.count(letter).alias("c"))
    best = F.row_number().over(Window.partitionBy(sample).orderBy(F.col("c").desc(), F.col(letter).asc_nulls_last()))
    return counted.withColumn("r", best).filter("r = 1").select(sample, F.col(letter).alias("vote"))


def strict_majority(votes: DataFrame, sample: str, chosen: str) -> DataFrame:
    """(sample, votes): letters that more than half of all repeats chose, failed repeats counted; null if none did."""
    total = votes.groupBy(sample).agg(F.count(F.lit(1)).alias("n"))
    each = votes.select(sample, F.explode(F.array_distinct(chosen)).alias("letter")).groupBy(sample, "letter").agg(F.count(F.lit(1)).alias("c"))
    won = each.join(total, sample).filter("c * 2 > n").groupBy(sample).agg(F.sort_array(F.collect_list("letter")).alias("votes"))
    return total.select(sample).join(won, sample, "left")


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mae, mean_diff, sd, low, high) of two judges, population deviation; no row under three pairs."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("sd"))
    return out.filter("n >= 3").withColumn("low", F.col("mean_diff") - 1.96 * F.col("sd")).withColumn("high", F.col("mean_diff") + 1.96 * F.col("sd"))
