"""Choosing rows for synthesis: rankings, proportional quotas, apportionment, weighted samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.answers import language, safe_ratio


def hash_sample(rows: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """The same n rows in every run: those of the smallest hashes."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), key).limit(n)


def weighted_sample(rows: DataFrame, key: Column, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, chances by weight: the largest ln(u) / w, u from a hash of the key."""
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return rows.filter(weight > 0).orderBy((F.log(u) / weight).desc(), key).limit(n)


def quotas(rows: DataFrame, dim: str, most: int) -> DataFrame:
    """(dim, n, quota): shares of `most` by size, halves to even, one at least, one row for each dimension.

    One pass by size, largest first, then moves what is over or missing: one from or to each dimension.
    """
    sizes = rows.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # over dimensions, not over rows
    sizes = sizes.withColumn("q", F.greatest(F.lit(1), F.bround(F.lit(float(most)) * F.col("n") / F.sum("n").over(every)).cast("long")))
    sizes = sizes.withColumn("over", F.sum("q").over(every) - most)
    by_size = Window.partitionBy(F.col("q") > 1).orderBy(F.col("n").desc(), dim)
    place, among = F.row_number().over(Window.orderBy(F.col("n").desc(), dim)), F.row_number().over(by_size)
    less = ((F.col("over") > 0) & (F.col("q") > 1) & (among <= F.col("over"))).cast("long")
    more = ((F.col("over") < 0) & (place <= -F.col("over"))).cast("long")
    return sizes.select(dim, "n", (F.col("q") - less + more).alias("quota"))


def stratified(rows: DataFrame, dim: str, order: Sequence[Column], most: int) -> DataFrame:
    """Each dimension's first rows up to its quota; what is missing is filled in order; `most` rows at most."""
    table = quotas(rows, dim, most).select(F.col(dim).alias("_dim"), "quota")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(dim).orderBy(*order)))
    ranked = ranked.join(table, F.col(dim).eqNullSafe(F.col("_dim"))).drop("_dim")
    return ranked.orderBy(F.col("_rank") > F.col("quota"), dim, "_rank").limit(most).drop("_rank", "quota")


def apportioned(dims: DataFrame, dim: str, wrong: str, reports: int, total: str | None = None) -> DataFrame:
    """(dim, share): whole shares that sum to `reports`, by error rate (`wrong` of `total`) or by number of errors.

    More dimensions than reports: one for each of the heaviest, by weight and then number; the others are left out.
    Else floors, one at least; what is missing goes one by one to the heaviest, what is over is taken round by round
    from the lightest, one from each that has more than one. One row for each dimension: windows over dimensions.
    """
    every = Window.partitionBy()
    n = F.col(wrong).cast("double")
    weight = safe_ratio(n, F.col(total)) if total else safe_ratio(n, F.sum(n).over(every))
    d = dims.select(F.col(dim), F.col(wrong).alias("n"), weight.alias("w"))
    d = d.withColumn("w", F.when(F.sum("w").over(every) == 0, 1.0).otherwise(F.col("w"))).withColumn("dims", F.count(F.lit(1)).over(every))
    heaviest = Window.orderBy(F.col("w").desc(), F.col("n").desc(), dim)
    d = d.withColumn("raw", F.greatest(F.lit(1), F.floor(F.lit(float(reports)) * F.col("w") / F.sum("w").over(every))).cast("long")).withColumn("place", F.row_number().over(heaviest))
    d = d.withColumn("over", F.sum("raw").over(every) - reports)
    spare = d.filter("over > 0 AND raw > 1 AND dims <= %d" % reports).select(F.col(dim).alias("_dim"), "w", "over", F.explode(F.sequence(F.lit(1), F.col("raw") - 1)).alias("round"))
    taken = spare.withColumn("r", F.row_number().over(Window.orderBy("round", "w", "_dim"))).filter("r <= over").groupBy("_dim").agg(F.count(F.lit(1)).alias("taken"))
    out = d.join(taken, F.col(dim).eqNullSafe(F.col("_dim")), "left")
    share = F.col("raw") + ((F.col("over") < 0) & (F.col("place") <= -F.col("over"))).cast("long") - F.coalesce("taken", F.lit(0))
    out = out.select(dim, F.when(F.col("dims") > reports, F.lit(1)).otherwise(share).cast("long").alias("share"), (F.col("dims") <= reports).alias("all_in"), "place")
    return out.filter(F.col("all_in") | (F.col("place") <= reports)).select(dim, "share")


def dimension_errors(verdicts: DataFrame, dim: str, sample: str) -> DataFrame:
    """(dim, total, wrong, error_rate) over samples: a sample is wrong if any of its answers is."""
    each = verdicts.groupBy(dim, sample).agg((~F.every("is_correct")).alias("wrong"))
    out = each.groupBy(dim).agg(F.count(F.lit(1)).alias("total"), F.count_if("wrong").alias("wrong"))
    return out.withColumn("error_rate", F.col("wrong") / F.col("total").cast("double"))


def bad_cases(verdicts: DataFrame, sample: str) -> DataFrame:
    """Wrong answers with the difficulty of their sample: how many of its answers are wrong."""
    wrong = F.sum(F.when(F.col("is_correct"), 0).otherwise(1)).over(Window.partitionBy(sample))
    return verdicts.withColumn("difficulty", wrong.cast("long")).filter(~F.col("is_correct"))


#: The rule of each task.
KEY_RULES = {
    "ToMBench": "ability", "BigToM": "condition", "SocialIQA": "bilingual", "EmoBench": "bilingual",
    "HiToM": "order", "FanToM": "question", "rubric": "rubric",
}


def dimension_key(dataset: Column, meta: str = "meta", tasks: Mapping[str, str] | None = None) -> Column:
    """The key by which wrong answers are grouped for diagnosis, `unknown` without it.

    `tasks` names the task of datasets that are called otherwise; datasets without a rule go by their first
    dimension. Where a dataset is bilingual the language is appended unless it is English.
    """
    part = lambda *keys: F.coalesce(*(F.nullif(F.coalesce(F.get(F.try_variant_get(meta, f"$.{k}", "array<string>"), F.lit(0)), F.try_variant_get(meta, f"$.{k}", "string")), F.lit("")) for k in keys))
    lang = language(part("lang"), part("language"))
    suffix = F.when(lang != "en", F.concat(F.lit("__"), lang)).otherwise("")
    other = F.coalesce(part("dimension", "Dimension"), F.lit("unknown"))
    asked = F.coalesce(part("question_type", "question_Type"), F.get(F.split(part("id"), "__"), F.lit(1)), F.lit("unknown"))
    qtype = F.when(part("qtype").isNotNull(), F.concat(part("dim"), F.lit("__"), part("qtype")))
    rules = {
        "ability": F.concat(F.coalesce(part("ability", "Ability"), F.lit("unknown")), suffix),
        "condition": F.coalesce(part("condition_type", "Condition_type"), other),
        "bilingual": F.concat(other, suffix),
        "order": F.coalesce(F.concat(F.lit("order_"), part("order", "Order")), F.lit("unknown")),
        "question": asked,
        "rubric": F.concat(F.coalesce(qtype, part("dim"), F.lit("unknown")), suffix),
    }
    named = KEY_RULES | {name: KEY_RULES[task] for name, task in (tasks or {}).items() if task in KEY_RULES}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule, column in rules.items():
        out = out.when(dataset.isin(*(n for n, r in named.items() if r == rule)), column)
    return out.otherwise(other)
