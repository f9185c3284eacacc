"""The quality filter's run: who is asked what, labels from three phases, repair, and the final merge.

Samples have row_id, a key that is unique; phases carry it, so nothing is matched by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.operators import quality as Q

#: Labels that may be repaired, and the label of those that could not be.
REPAIRABLE, UNFIXABLE = ("easy", "shortcut", "bad"), "unfixable"


def to_judge(samples: DataFrame, trials: DataFrame, key: str = "row_id") -> DataFrame:
    """Samples whose answerability is asked: those that some trials failed."""
    return samples.join(trials.filter(F.col("bucket").isin("partial", "all_failed")).select(key), key, "left_semi")


def to_probe(samples: DataFrame, trials: DataFrame, answers: DataFrame | None, key: str = "row_id") -> DataFrame:
    """Samples that are probed for shortcuts: some trials passed and some failed, and they can be answered."""
    out = samples.join(trials.filter(F.col("bucket") == "partial").select(key), key, "left_semi")
    return out if answers is None else out.join(answers.filter("answerable").select(key), key, "left_semi")


def labelled(samples: DataFrame, trials: DataFrame | None, answers: DataFrame | None, probes: DataFrame | None, iteration: int = 1, key: str = "row_id") -> DataFrame:
    """Samples with bucket, answerable, is_shortcut, label and repair_type: left joins of three phases.

    A phase that is switched off is None: all samples then count as partly passed, as answerable, as no shortcut.
    A phase that ran without a row for a sample leaves null: no bucket and no answer are `bad`, no probe is no shortcut.
    Phases have one row for each key; a phase's other columns are carried.
    """
    rows = samples.select(key)
    of = lambda phase, column: rows.withColumn(column, F.lit(None).cast("string")) if phase is None else rows.join(phase, key, "left")
    rows = of(trials, "bucket")
    rows = rows.withColumn("answerable", F.lit(True)) if answers is None else rows.join(answers, key, "left")
    rows = rows.withColumn("is_shortcut", F.lit(False)) if probes is None else rows.join(probes, key, "left")
    bucket = F.lit("partial") if trials is None else F.col("bucket")
    rows = rows.withColumn("bucket", bucket).withColumn("label", Q.label(bucket, F.col("answerable"), F.col("is_shortcut")))
    return rows.withColumn("repair_type", Q.repair_type(F.col("label"))).withColumn("iter", F.lit(iteration))


def reasons(labels: DataFrame) -> DataFrame:
    """(reason, n) of bad samples; `unknown` where the judge gave none."""
    reason = F.coalesce(F.nullif("answerability_label", F.lit("")), F.lit("unknown"))
    return labels.filter("label = 'bad'").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def gave_up(labels: DataFrame) -> DataFrame:
    """Labels after the last iteration: what should still be repaired is unfixable."""
    hopeless = F.col("repair_type").isNotNull() & F.col("label").isin(*REPAIRABLE)
    return labels.withColumn("label", F.when(hopeless, UNFIXABLE).otherwise(F.col("label")))


def to_repair(samples: DataFrame, labels: DataFrame, kinds: Sequence[str], key: str = "row_id") -> DataFrame:
    """Samples with a repair type that is switched on, and why they need it."""
    why = [F.col(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in ("answerability_label", "answerability_reason")]
    wanted = labels.filter(F.col("repair_type").isin(*kinds)).select(key, "repair_type", *why)
    return samples.join(wanted, key)


def repaired(asked: DataFrame, replies: DataFrame, iteration: int, key: str = "row_id") -> DataFrame:
    """Samples with the story, question and answers of replies that have a right answer; the others go.

    replies: key, story, question, correct_answers, wrong_answers. `history` gains a step, source_iter names it.
    """
    usable = replies.filter(F.coalesce(F.size("correct_answers"), F.lit(0)) > 0)
    usable = usable.select(key, F.struct("story", "question", F.struct("correct_answers", F.coalesce("wrong_answers", F.array().cast("array<string>")).alias("wrong_answers")).alias("answer")).alias("_new"))
    step = F.array(F.struct(F.lit(iteration).alias("iter"), F.col("repair_type").alias("repair_type")))
    before = F.coalesce("history", F.array().cast("array<struct<iter: int, repair_type: string>>")) if "history" in asked.columns else F.array().cast("array<struct<iter: int, repair_type: string>>")
    out = asked.join(usable, key)
    out = out.withColumns({c: F.col(f"_new.{c}") for c in ("story", "question", "answer")} | {"history": F.concat(before, step), "source_iter": F.lit(f"eval_iter{iteration}_repair")})
    return out.drop("_new", "repair_type", "answerability_label", "answerability_reason")


def finalized(inputs: DataFrame, labels: DataFrame, sample: str = "sample_id", keys: Sequence[str] = ("split", "iter", "row_id")) -> DataFrame:
    """Of all splits and iterations the samples labelled hard or medium, of each sample the last one.

    Inputs and labels meet by split, iteration and row. A sample's last row: the largest split, then iteration, then row.
    """
    kept = labels.filter(F.col("label").isin(*Q.KEPT)).select(*keys)
    rank = F.row_number().over(Window.partitionBy(sample).orderBy(*(F.col(k).desc() for k in keys)))
    return inputs.join(kept, list(keys), "left_semi").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


