"""Judges of open answers: by token F1, by a model's yes or no, by models' scores after a rubric.

A judge is asked through `ask(rows, judge)`, which gives (row_id, content) for rows of (row_id, prompt): a source of
`qaspark.sources.responder` in production, a stand-in in tests. Replies are JSON that must have the schema's fields.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions import prompts as P
from qaspark.operators import judging as J

#: The least F1 and the least score of a right answer, the largest score.
LEAST_F1, LEAST_SCORE, MOST = 0.5, 7.0, 10
MODES = ("rule", "f1", "llm_simple", "rubric")

Ask = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Context:
    """How open answers are judged. `rule` and `f1` need no judge, the others one at least, `rubric` also rubrics."""

    mode: str = "f1"
    ask: Ask | None = None
    judges: int = 1
    least: float | None = None
    rubrics: DataFrame | None = None
    key: str = ""
    fallback: str = ""
    most: int = MOST

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown way to judge {self.mode!r}")
        if self.mode in ("llm_simple", "rubric") and (self.ask is None or self.judges < 1):
            raise ValueError(f"{self.mode} needs a judge")
        if self.mode == "rubric" and self.rubrics is None and not self.fallback:
            raise ValueError("rubric needs rubrics or a fallback")


def structured(content: Column, schema: str) -> Column:
    """A reply as a struct of the schema; null if it is no JSON object or lacks a field or its type."""
    value = J.json_value(content)
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    parts = [F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in fields]
    whole = F.lit(True)
    for (name, kind), part in zip(fields, parts, strict=True):
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        fits = {"boolean": found == "BOOLEAN", "string": found == "STRING"}.get(kind, ~found.isin("STRING", "BOOLEAN", "VOID"))
        whole = whole & F.coalesce(fits & part.isNotNull(), F.lit(False))
    return F.when(whole, F.struct(*parts))


def _verdict(score: Column, least: float) -> tuple[Column, Column]:
    ok = F.coalesce(score >= least, F.lit(False))
    return ok, F.when(score.isNull(), "judge_error").when(~ok, "below_threshold")


def yes_or_no(records: DataFrame, context: Context) -> DataFrame:
    """is_correct and error_reason by the first judge; empty answers are not asked; no usable reply is judge_error."""
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    replies = context.ask(records.filter(~empty).select("row_id", P.judge_prompt().alias("prompt")), 0)
    said = replies.select("row_id", structured(F.col("content"), "is_correct boolean")["is_correct"].alias("_said"))
    out = records.join(said, "row_id", "left").withColumn("is_correct", F.coalesce(F.when(~empty, F.col("_said")), F.lit(False)))
    reason = F.when(empty, "content_none").when(F.col("_said").isNull(), "judge_error").when(~F.col("_said"), "wrong_answer")
    return out.withColumn("error_reason", reason).drop("_said")


def by_rubric(records: DataFrame, context: Context) -> DataFrame:
    """judge_score, the mean of the judges' scores, each judge's own, the first judge's reason that there is, and the
    verdict; judges without a usable reply do not count, none at all is judge_error."""
    rubrics = context.rubrics if context.rubrics is not None else records.sparkSession.createDataFrame([], "key string, rubric string")
    asked = P.with_rubric(records, rubrics, context.key or "_", context.fallback).withColumn("prompt", P.score_prompt(context.most))
    out = records
    for k in range(context.judges):
        replies = context.ask(asked.select("row_id", "prompt"), k)
        out = out.join(replies.select("row_id", structured(F.col("content"), "score double, reason string").alias(f"_judge{k}")), "row_id", "left")
    judges = [F.col(f"_judge{k}") for k in range(context.judges)]
    score, _ = J.rubric(F.array(*(j["score"] for j in judges)))
    ok, reason = _verdict(F.col("judge_score"), LEAST_SCORE if context.least is None else context.least)
    out = out.withColumn("judge_score", score).withColumns({f"judge{k + 1}_score": j["score"] for k, j in enumerate(judges)})
    out = out.withColumn("judge_reason", F.coalesce(*judges)["reason"]).withColumn("is_correct", ok).withColumn("error_reason", reason)
    return out.drop(*(f"_judge{k}" for k in range(context.judges)))


def judged(records: DataFrame, context: Context, extractor: str = "cot") -> DataFrame:
    """Verdicts on all records: choice questions by rule, open ones as the context says. One row for each record.

    Records have row_id, a key, and what `judging.graded` reads.
    """
    least = LEAST_F1 if context.least is None or context.mode not in ("rule", "f1") else context.least
    ruled = J.graded(records, extractor, least)
    if context.mode in ("rule", "f1"):
        return ruled
    open_ = records.filter("prompt_type = 'open'")
    said = yes_or_no(open_, context) if context.mode == "llm_simple" else by_rubric(open_, context)
    return ruled.filter("prompt_type IS DISTINCT FROM 'open'").unionByName(said, allowMissingColumns=True)


