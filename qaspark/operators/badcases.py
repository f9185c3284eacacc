"""Samples that a model gets wrong, by groups of equal meta data, for a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.answers import four_places, safe_ratio

#: Keys of meta that name a sample, and those that a group is shown by.
NAMING = ("id", "Index", "filename", "file", "sample_id", "question_id")
SHOWN = ("ability", "dimension", "task_type", "question_type")


def _text(value: Column, between: str) -> Column:
    """A value as text: strings plain, booleans and null as True, False and None, arrays joined."""
    kind = F.schema_of_variant(value)
    plain = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string"))).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
    many = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("None")))
    return F.when(kind.startswith("ARRAY"), F.array_join(many, between)).otherwise(plain)


def signature(meta: Column) -> Column:
    """All of meta that does not name the sample, as key=value in order of keys; `unknown` for nothing."""
    entries = F.filter(F.array_sort(F.map_entries(F.try_variant_get(meta, "$", "map<string, string>"))), lambda e: ~e["key"].isin(*NAMING))
    entries = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, "unknown").otherwise(F.array_join(entries, "|"))


def shown(meta: Column) -> Column:
    """The first of the keys that groups are shown by which has a value, else the signature."""
    parts = [F.try_variant_get(meta, f"$.{k}", "variant") for k in SHOWN]
    texts = [F.nullif(F.when(~F.to_json(p).isin("null", "0", "false", "[]", "{}"), _text(p, ", ")), F.lit("")) for p in parts]
    return F.coalesce(*texts, signature(meta))


def gold(prompt_type: Column, answers: Column, letters: Column) -> Column:
    """The right answer as JSON: texts of open questions, else letters."""
    none = F.array().cast("array<string>")
    return F.to_json(F.when(prompt_type == "open", F.coalesce(answers, none)).otherwise(F.coalesce(letters, none)))


def samples(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each sample's first repeat with wrong_count, max_repeat, its group's wrong rate and its tier.

    Answers without a verdict are wrong. Tier 1: always wrong, over 0.7 of the group's samples are wrong;
    2: wrong half the time at least, over 0.5; 3: any other sample with a wrong answer; 99: none is wrong.
    """
    keys = ["sample_id", "repeat"]
    said = verdicts.groupBy(*keys).agg(F.every("is_correct").alias("said"))
    wrong = ~F.coalesce("said", F.lit(False))
    per = records.join(said, keys, "left").groupBy("sample_id").agg(F.min_by(F.struct("prompt_type", "meta", "correct_answers", "correct_letters"), "repeat").alias("r"), F.count_if(wrong).alias("wrong_count"), F.count(F.lit(1)).alias("max_repeat"))
    per = per.select("sample_id", "wrong_count", "max_repeat", signature(F.col("r.meta")).alias("group_key"), shown(F.col("r.meta")).alias("group_display"), gold(F.col("r.prompt_type"), F.col("r.correct_answers"), F.col("r.correct_letters")).alias("gold_answer"))
    groups = per.groupBy("group_key").agg(safe_ratio(F.count_if(F.col("wrong_count") > 0), F.count(F.lit(1))).alias("group_wrong_rate"))
    out = per.join(groups, "group_key")
    rate, n, of = F.col("group_wrong_rate"), F.col("wrong_count"), F.col("max_repeat")
    tier = F.when((rate > 0.7) & (n == of), 1).when((rate > 0.5) & (n * 2 >= of), 2).when(n > 0, 3).otherwise(99)
    return out.withColumn("tier", tier)


def worst(of: DataFrame, limit: int | None = None) -> DataFrame:
    """Wrong samples by tier, the group's wrong rate, wrong answers, id: all, or the first `limit`."""
    found = of.filter("wrong_count > 0").orderBy("tier", F.col("group_wrong_rate").desc(), F.col("wrong_count").desc(), "sample_id")
    return found if limit is None else found.limit(limit)


def case_lines(cases: DataFrame) -> DataFrame:
    """(sample_id, text): the section of a report on each case."""
    text = F.format_string("### %s\n\n- tier: %d\n- wrong: %d of %d\n- group: %s (%s)\n- answer: %s\n", "sample_id", "tier", "wrong_count", "max_repeat", "group_display", four_places(F.col("group_wrong_rate")), "gold_answer")
    return cases.select("sample_id", text.alias("text"))
