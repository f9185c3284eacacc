"""The data of charts, as frames: bars, a parent-child heat map, comparisons of models, scatter and spread of judges.

Metrics are (model, path, acc, n), path an array of (dim, split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension_name(path: Column) -> Column:
    """The dimension of a path, with the splits above it: dim1, or dim1/split/dim2."""
    n = F.size(path)
    above = F.flatten(F.transform(F.slice(path, 1, F.greatest(n - 1, F.lit(0))), lambda s: F.array(s["dim"], s["split"])))
    return F.when(n > 0, F.array_join(F.concat(above, F.array(F.get(path, n - 1)["dim"])), "/"))


def bars(metrics: DataFrame) -> DataFrame:
    """(model, dimension, split, acc, n): each dimension's splits, those below others under the parent's split."""
    return metrics.filter(F.size("path") > 0).select("model", dimension_name(F.col("path")).alias("dimension"), F.get("path", F.size("path") - 1)["split"].alias("split"), F.coalesce("acc", F.lit(0.0)).alias("acc"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def compared(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """(dimension, split, model, acc) of the dimensions that all models have: every split that any has, 0 where missing."""
    b = bars(metrics).filter(F.col("model").isin(*models))
    shared = b.groupBy("dimension").agg(F.count_distinct("model").alias("k")).filter(F.col("k") == len(models)).select("dimension")
    wanted = b.join(shared, "dimension", "left_semi").select("dimension", "split").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return wanted.join(b.select("dimension", "split", "model", "acc"), ["dimension", "split", "model"], "left").select("dimension", "split", "model", F.coalesce("acc", F.lit(0.0)).alias("acc"))


def heat_cells(metrics: DataFrame) -> DataFrame:
    """(model, dimension, child, row, column, acc) of dimensions whose every split has one child dimension, the same."""
    b = metrics.filter(F.size("path") > 0).select("model", "path", dimension_name(F.col("path")).alias("dimension"), F.get("path", F.size("path") - 1)["split"].alias("split"), "acc")
    n = F.size("path")
    above = F.slice("path", 1, F.greatest(n - 1, F.lit(0)))
    under = b.filter(n > 1).select("model", dimension_name(above).alias("dimension"), F.get("path", n - 2)["split"].alias("row"), F.get("path", n - 1)["dim"].alias("child"), F.col("split").alias("column"), "acc")
    per = under.groupBy("model", "dimension", "row").agg(F.min("child").alias("child"), F.max("child").alias("other"))
    rows = b.select("model", "dimension", F.col("split").alias("row")).join(per, ["model", "dimension", "row"], "left")
    fit = rows.groupBy("model", "dimension").agg(F.min("child").alias("child"), F.max("other").alias("other"), F.count_if(F.col("child").isNull()).alias("bare")).filter("child = other AND bare = 0").select("model", "dimension")
    return under.join(fit, ["model", "dimension"], "left_semi").select("model", "dimension", "child", "row", "column", F.coalesce("acc", F.lit(0.0)).alias("acc"))


def label_of(path: Column) -> Column:
    """Dataset and model of a run's path: the two parts behind `results`, else the last two folders."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, "results").cast("int")
    named = F.slice(parts, F.greatest(at + 1, F.lit(1)), 2)
    return F.array_join(F.when((at > 0) & (F.size(named) == 2), named).otherwise(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 2)), "/")


def scatter(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, mean, diff) of pairs that both judges scored: points of a scatter and of a plot of differences."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return scores.filter(x.isNotNull() & y.isNotNull()).select(x.alias("a"), y.alias("b"), ((x + y) / 2).alias("mean"), (x - y).alias("diff"))


def safe_name(path: Column) -> Column:
    """A path as part of a file name."""
    return F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))
