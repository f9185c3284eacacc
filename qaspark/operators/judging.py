"""Grading of responses by question type, votes over repeats, and checks of what judges and agents return.

Records have sample_id, repeat, prompt_type, content, correct_letters and correct_answers (arrays), lang and
sub_questions (array of structs with subtype and correct_letters). Missing parts are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions import answers as A

#: Verdict of one sub-question.
SUB = "array<struct<subtype: string, extracted: string, is_correct: boolean>>"


def _empty(content: Column) -> Column:
    return F.coalesce(content, F.lit("")) == ""


def grouped_parts(content: Column, subs: Column) -> Column:
    """Each sub-question with its box: the last boxed letters, as many as there are sub-questions; null for fewer."""
    found = F.filter(F.transform(A.boxed(content), A.single_letter), lambda x: x.isNotNull())
    n = F.size(subs)
    tail = F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))
    parts = F.zip_with(subs, tail, lambda s, x: F.struct(s["subtype"].alias("subtype"), x.alias("extracted"), F.coalesce(F.array_contains(s["correct_letters"], x), F.lit(False)).alias("is_correct")))
    return F.when((n > 0) & (F.size(found) >= n), parts).cast(SUB)


def graded(records: DataFrame, extractor: str = "cot", threshold: float = 0.5) -> DataFrame:
    """Records with extracted, sub_results, judge_score, is_correct and error_reason, in one projection.

    mcq_single compares a letter, mcq_multi a set of letters, mcq_grouped each sub-question, open the best token
    F1 of the final answer with a gold answer. Nulls and empty responses are content_none; no type is mcq_single.
    """
    content, kind = F.col("content"), F.coalesce("prompt_type", F.lit("mcq_single"))
    raw = A.extracted(content, extractor)
    out = records.withColumn("sub_results", F.when(kind == "mcq_grouped", grouped_parts(content, F.col("sub_questions"))))
    single = F.when(A.single_letter(raw).isNotNull(), F.array(A.single_letter(raw)))
    out = out.withColumn("extracted", F.when(kind == "mcq_single", single).when(kind == "mcq_multi", A.letter_set(raw)).when(kind == "mcq_grouped", F.transform("sub_results", lambda s: s["extracted"])))
    final = A.final_answer(content)
    tokens = lambda t: F.when(F.col("lang") == "zh", A.chinese_tokens(t)).otherwise(A.english_tokens(t))
    score = A.max_f1(tokens(final), F.transform("correct_answers", tokens))
    out = out.withColumn("judge_score", F.when((kind == "open") & ~_empty(content), score))
    ok = (
        F.when(_empty(content), False)
        .when(kind == "open", F.col("judge_score") >= threshold)
        .when(kind == "mcq_grouped", F.forall("sub_results", lambda s: s["is_correct"]))
        .when(kind == "mcq_multi", A.same_set(F.col("extracted"), F.col("correct_letters")))
        .otherwise(F.array_contains("correct_letters", F.get("extracted", F.lit(0))))
    )
    out = out.withColumn("is_correct", F.coalesce(ok, F.lit(False)))
    no_subs = (kind == "mcq_grouped") & (F.coalesce(F.size("sub_questions"), F.lit(0)) <= 0)
    reason = (
        F.when(_empty(content), "content_none")
        .when(no_subs, "no_sub_questions")
        .when((kind != "open") & F.col("extracted").isNull(), "extraction_failed")
        .when((kind == "open") & ~F.col("is_correct"), "below_threshold")
        .when(~F.col("is_correct"), "wrong_answer")
    )
    return out.withColumn("error_reason", reason)


def rubric(scores: Column, threshold: float = 7.0) -> tuple[Column, Column]:
    """(mean of the judges' scores, verdict): null scores do not count; without any, null and false."""
    known = F.filter(scores, lambda s: s.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, s: a + s), F.size(known).cast("double"))
    return mean, F.coalesce(mean >= threshold, F.lit(False))


def collapsed(records: DataFrame) -> DataFrame:
    """One record per sample: that of the least repeat, its `vote` the letters that the repeats elect.

    Single choice: the most frequent letter, the smallest on a tie. Multiple choice: every letter chosen by over
    half of all repeats, failed ones counted. Other types keep the representative's `extracted`.
    """
    n = F.count(F.lit(1))
    chosen = records.select("sample_id", F.explode(F.array_distinct("extracted")).alias("letter")).groupBy("sample_id", "letter").agg(n.alias("c"))
    tally = chosen.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("less"), "letter"))).alias("tally"))
    # the representative by an aggregate with partial results, not by a sort of all repeats
    first = records.groupBy("sample_id").agg(F.min_by(F.struct(*records.columns), "repeat").alias("r"), n.alias("n"))
    both = first.join(tally, "sample_id", "left")
    most = F.when(F.col("tally").isNotNull(), F.array(F.col("tally")[0]["letter"]))
    strict = F.array_sort(F.transform(F.filter("tally", lambda t: -t["less"] * 2 > F.col("n")), lambda t: t["letter"]))
    vote = F.when(F.col("r.prompt_type") == "mcq_single", most).when(F.col("r.prompt_type") == "mcq_multi", F.when(F.size(strict) > 0, strict)).otherwise(F.col("r.extracted"))
    return both.select("r.*", "n", vote.alias("vote"))


def keeps_contract(prompt_type: Column, answer: Column) -> Column:
    """Whether an agent's answer, a variant, has its type's one form: a capital letter, an ascending array of
    different capital letters, an array of capital letters, a string that is not blank."""
    kind = F.coalesce(F.schema_of_variant(answer), F.lit("VOID"))
    text, many = F.try_variant_get(answer, "$", "string"), F.try_variant_get(answer, "$", "array<string>")
    letters = kind.startswith("ARRAY") & (F.size(many) > 0) & F.forall(many, lambda x: F.coalesce(x.rlike("^[A-Z]$"), F.lit(False)))
    rising = (F.size(F.array_distinct(many)) == F.size(many)) & (F.array_sort(many) == many)
    ok = F.when(prompt_type == "mcq_single", (kind == "STRING") & text.rlike("^[A-Z]$")).when(prompt_type == "mcq_multi", letters & rising).when(prompt_type == "mcq_grouped", letters).when(prompt_type == "open", (kind == "STRING") & (F.trim(text) != ""))
    return F.coalesce(ok, F.lit(False))


def json_value(text: Column) -> Column:
    """The first JSON value as a variant: the whole text, a fenced block, or an object without inner braces."""
    t = F.trim(text)
    fenced = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), F.try_parse_json)
    plain = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0)), F.try_parse_json)
    usable = lambda a: A.first(F.filter(a, lambda v: v.isNotNull()))
    return F.coalesce(F.try_parse_json(t), usable(fenced), usable(plain))


#: What a judge of answerability may say.
ANSWERABILITY = ("answerable", "label_error", "ambiguous", "contradictory_premise", "missing_info")


def answerability(text: Column) -> tuple[Column, Column]:
    """(label, reason of at most 240 characters); where the label is null the reason tells what was wrong."""
    value = json_value(text)
    label, reason = F.try_variant_get(value, "$.label", "string"), F.try_variant_get(value, "$.reason", "string")
    known = F.coalesce(label.isin(*ANSWERABILITY), F.lit(False))
    unread = value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    why = F.when(F.coalesce(text, F.lit("")) == "", "empty_response").when(unread, "json_parse_failed").when(known, F.left(F.coalesce(reason, F.lit("")), F.lit(240)))
    return F.when(known, label), F.coalesce(why, F.concat(F.lit("invalid_label:"), F.coalesce(label, F.lit("None"))))


def offered_letters(text: Column, offered: Column, prompt_type: Column) -> Column:
    """Letters of a free answer that are on offer: of its last line `ANSWER: ...`, else of all of it; the first
    offered one where there is none. Single choice keeps the first found, multiple choice all in order."""
    line = A.last(F.regexp_extract_all(text, F.lit(r"(?im)^\s*ANSWER:\s*(.*)$"), F.lit(1)))
    found = F.array_intersect(F.split(F.upper(F.coalesce(line, text, F.lit(""))), ""), offered)
    found = F.when(F.size(found) > 0, found).otherwise(F.slice(offered, 1, 1))
    return F.when(prompt_type == "mcq_single", F.slice(found, 1, 1)).otherwise(F.array_sort(found))


def first_wrong(records: DataFrame) -> DataFrame:
    """Of each sample with a wrong answer the first one: by model, then repeat."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("model", "repeat"))
    return records.filter(~F.col("is_correct")).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
