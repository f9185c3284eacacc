"""Readers and writers: samples, predictions, catalogs, redacted settings."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "sample_id string, story string, question string, answer struct<correct_answers: array<string>, wrong_answers: array<string>>, meta variant"
SECRET = ("api_key", "api_url")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON lines; a missing id falls back to meta.id, then to the content's hash."""
    rows = spark.read.schema(SAMPLES).json(path)
    other = F.try_variant_get("meta", "$.id", "string")
    usable = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "0"), c)
    return rows.withColumn("sample_id", F.coalesce(usable(F.col("sample_id")), usable(other), F.concat(F.lit("sample_"), F.xxhash64("story", "question").cast("string"))))


def violations_of() -> Column:
    """The schema's rules that a sample breaks."""
    rules = {
        "answer_missing": F.col("answer").isNull(),
        "story_missing": F.col("story").isNull(),
        "question_empty": F.coalesce(F.trim("question"), F.lit("")) == "",
        "no_correct_answer": F.coalesce(F.size(F.filter("answer.correct_answers", lambda a: F.trim(a) != "")), F.lit(0)) <= 0,
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))


def violations(samples: DataFrame) -> DataFrame:
    """Samples that break the schema's rules, with an array of reasons."""
    return samples.withColumn("violations", violations_of()).filter(F.size("violations") > 0)


def coerced(rows: DataFrame, prefix: str = "row_") -> DataFrame:
    """Rows as samples: null texts empty, answers trimmed without blanks, a missing id made of story and question."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    clean = lambda c: F.coalesce(F.filter(F.transform(F.col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    answer = F.struct(clean("answer.correct_answers").alias("correct_answers"), clean("answer.wrong_answers").alias("wrong_answers")).alias("answer")
    out = rows.select(F.col("sample_id"), text("story"), text("question"), answer, *(c for c in rows.columns if c not in ("sample_id", "story", "question", "answer")))
    name = F.concat(F.lit(prefix), F.hex(F.xxhash64("story", "question")))
    return out.withColumn("sample_id", F.coalesce(F.when(~F.col("sample_id").isin("", "0"), F.col("sample_id")), name))


def checked(samples: DataFrame) -> DataFrame:
    """Samples, where one that breaks the schema's rules is an error when it is read."""
    reasons = violations_of()
    message = F.concat(F.lit("sample "), F.coalesce("sample_id", F.lit("?")), F.lit(": "), F.array_join(reasons, ", "))
    kept = F.when(F.size(reasons) > 0, F.raise_error(message).cast("string")).otherwise(F.col("question"))
    return samples.withColumn("question", kept)


def located(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder, by name; nothing where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in files.listStatus(path)) if files.exists(path) else []


def subsets(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """The datasets below a folder: every folder that holds data, as a path from `root`."""
    out = []
    for name, is_folder in located(spark, f"{root.rstrip('/')}/{prefix}"):
        path = f"{prefix}/{name}".lstrip("/")
        if is_folder and not name.startswith((".", "_")):
            below = located(spark, f"{root.rstrip('/')}/{path}")
            out += [path] if any(not f and n.endswith((".parquet", ".arrow")) for n, f in below) else []
            out += subsets(spark, root, path)
    return out


def read_split(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """A dataset's split: its Arrow folder, else all Arrow folders below, else `<split>-*.parquet`, else all Parquet.

    Each row has `source_file`. Arrow files are read by workers, one file in a task, a batch at a time.
    """
    names = located(spark, folder)
    arrow = arrow_files(spark, folder)
    if arrow:
        return read_arrow(spark, arrow)
    pattern = f"{folder.rstrip('/')}/{split}-*.parquet"
    if not any(n.startswith(f"{split}-") and n.endswith(".parquet") for n, _ in names):
        pattern = f"{folder.rstrip('/')}/*.parquet"
    return with_split(spark.read.parquet(pattern))


def with_split(rows: DataFrame) -> DataFrame:
    """Rows with the name of their file, and the split that it names: what stands before the first dash."""
    name = F.col("_metadata.file_name")
    return rows.select("*", name.alias("source_file"), F.regexp_extract(name, r"^([^-.]+)", 1).alias("split"))


def arrow_files(spark: SparkSession, folder: str) -> list[str]:
    out = []
    for name, is_folder in located(spark, folder):
        path = f"{folder.rstrip('/')}/{name}"
        out += arrow_files(spark, path) if is_folder else [path] if name.endswith(".arrow") else []
    return out


def read_arrow(spark: SparkSession, files: list[str]) -> DataFrame:
    """Arrow stream or file-format files as one table; all have the first one's columns."""
    import pyarrow as pa

    def opened(path: str):
        from pyarrow import fs

        system, local = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        handle = system.open_input_file(local)
        try:
            return pa.ipc.open_file(handle)
        except pa.ArrowInvalid:
            handle.seek(0)
            return pa.ipc.open_stream(handle)

    def batches(reader):
        if hasattr(reader, "num_record_batches"):
            yield from (reader.get_batch(k) for k in range(reader.num_record_batches))
        else:
            yield from reader

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = opened(files[0]).schema
    names = schema.names

    def read(parts):
        for part in parts:
            for path in part.column("path").to_pylist():
                for batch in batches(opened(path)):
                    yield pa.RecordBatch.from_arrays([batch.column(n) for n in names], names)

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files), "path")
    return listed.mapInArrow(read, from_arrow_schema(schema))


def sampled(rows: DataFrame, key: str, n: int, path: str, seed: int = 42) -> DataFrame:
    """A fixed sample of a split, written at `path` the first time and read from there afterwards."""
    from qaspark.operators.selection import hash_sample

    spark = rows.sparkSession
    if not any(name == "_SUCCESS" for name, _ in located(spark, path)):
        hash_sample(rows, F.col(key), n, seed).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_document(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON document; an empty one where it is missing, broken or no object."""
    try:
        parts = spark.read.option("wholetext", True).text(path).collect()  # one file, one row
        value = json.loads(parts[0][0]) if parts else {}
    except (ValueError, AnalysisException):
        return {}
    return value if isinstance(value, dict) else {}


def read_settings(path: str) -> Any:
    """Settings from a YAML file, where a YAML library is installed, or JSON; ${NAME} from the environment."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        return expanded(json.loads(text))
    return expanded(yaml.safe_load(text))


def read_all(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet folders as one table; columns that some lack are null."""
    out = spark.read.option("recursiveFileLookup", True).parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.option("recursiveFileLookup", True).parquet(p), allowMissingColumns=True)
    return out


def write_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, one file for each batch that is appended."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_public(rows: DataFrame, path: str) -> None:
    """Parquet without columns whose names begin with an underscore; nothing for no rows."""
    if not rows.isEmpty():
        rows.drop(*(c for c in rows.columns if c.startswith("_"))).write.mode("overwrite").parquet(path)


def expanded(value: Any) -> Any:
    """Settings with ${NAME} replaced from the environment, at any depth."""
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), value) if isinstance(value, str) else value


def redacted(value: Any) -> Any:
    """Settings without secrets, at any depth."""
    if isinstance(value, dict):
        return {k: redacted(v) for k, v in value.items() if k not in SECRET}
    return [redacted(v) for v in value] if isinstance(value, list) else value
