"""Runs on disk, `<root>/<dataset>/<model>/exp_<time>/`: catalog, predictions, verdicts, metrics, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files of a complete run.
FILES = ("config.json", "metrics.json", "detailed_metrics.jsonl")
VERDICTS = "sample_id string, repeat int, prompt_type string, is_correct boolean, error_reason string, judge_score double"
LEGACY = f"all_metrics array<struct<per_sample_results: array<struct<{', '.join(c.replace(' ', ': ', 1) for c in VERDICTS.split(', '))}>>>>"
PREDICTIONS = "sample_id string, sample_index int, repeat int, prompt_type string, correct_letters array<string>, correct_answers array<string>, meta variant, pred struct<content: string, reasoning: string>, protocol string, extractor string"


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, model, exp, files, valid) of each run; the files' contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.split("path", "/").alias("p"))
    name = lambda back: F.element_at("p", -back)
    runs = found.filter((F.size("p") >= 4) & name(2).startswith("exp_")).groupBy(name(4).alias("dataset"), name(3).alias("model"), name(2).alias("exp")).agg(F.array_sort(F.collect_set(name(1))).alias("files"))
    return runs.withColumn("valid", F.size(F.array_except(F.array(*map(F.lit, FILES)), "files")) == 0)


def latest(runs: DataFrame, needed: str | None = None) -> DataFrame:
    """The last run of each dataset and model by name: of those that are valid, or have the file `needed`."""
    fit = F.array_contains("files", needed) if needed else F.col("valid")
    return runs.filter(fit).groupBy("dataset", "model").agg(F.max("exp").alias("exp"))


def folder(root: str, dataset: str, model: str, exp: str) -> str:
    return f"{root.rstrip('/')}/{dataset}/{model}/{exp}"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).json(path)


def read_verdicts(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Verdicts of JSON lines, or of the older single document; what runs say differently about one answer is wrong."""
    if legacy:
        rows = spark.read.schema(LEGACY).option("multiLine", True).json(path)
        rows = rows.select(F.explode("all_metrics").alias("m")).select(F.explode("m.per_sample_results").alias("v")).select("v.*")
    else:
        rows = spark.read.schema(VERDICTS).json(path)
    repeat = F.coalesce("repeat", F.lit(0)).alias("repeat")
    return rows.groupBy("sample_id", repeat).agg(F.every(F.coalesce("is_correct", F.lit(False))).alias("is_correct"), F.max("prompt_type").alias("prompt_type"), F.max("error_reason").alias("error_reason"), F.avg("judge_score").alias("judge_score"))


def write_run(verdicts: DataFrame, metrics: DataFrame, path: str) -> None:
    """Verdicts as JSON lines and metrics, long, as JSON lines."""
    verdicts.write.mode("overwrite").json(f"{path}/detailed_metrics.jsonl")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics.json")


def tree(metrics: DataFrame) -> dict:
    """Long metrics (path, acc, n) of one run as nested dictionaries; a run has some thousand paths."""
    out: dict = {"dimensions": {}}
    for row in metrics.orderBy(F.size("path"), F.to_json("path")).toLocalIterator():
        node = out
        for step in row["path"]:
            node = node.setdefault("dimensions", {}).setdefault(step["dim"], {}).setdefault(step["split"], {})
        node |= {"acc": row["acc"], "n": row["n"]}
    return out


def leaderboard(entries: DataFrame) -> DataFrame:
    """The newest entry of each dataset and model, ordered by dataset, model and time."""
    columns = [c for c in entries.columns if c not in ("dataset", "model")]
    best = entries.groupBy("dataset", "model").agg(F.max_by(F.struct(*columns), "exp").alias("e"))
    return best.select("dataset", "model", "e.*").withColumn("timestamp", F.regexp_replace("exp", "^exp_", "")).orderBy("dataset", "model", "timestamp")
