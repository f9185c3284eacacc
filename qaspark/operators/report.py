"""Report tables: pivots, merges, tiers, comparisons, the latest runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.answers import four_places


def formatted(value: Column) -> Column:
    return F.coalesce(four_places(value), F.lit("-"))


def summary(metrics: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A row for each `row`, a column for each of `columns`, four places, '-' where nothing is known."""
    wide = metrics.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    return wide.select(row, *(F.when(F.col(f"`{c}`").isNull(), "-").otherwise(formatted(F.col(f"`{c}`"))).alias(c) for c in columns))


def merged(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """New cells win, then old ones, then '-'."""
    both = new.withColumnRenamed(value, "_new").join(old.withColumnRenamed(value, "_old"), list(keys), "full")
    return both.select(*keys, F.coalesce("_new", "_old", F.lit("-")).alias(value))


def merged_table(new: DataFrame, old: DataFrame, value: str = "cell") -> DataFrame:
    """(row, row_no, column, column_no, cell): two tables of cells (row, row_no, column, column_no, cell) as a whole one.

    Old rows come first, then new ones; columns that only the old table has come first, then the new table's.
    New cells win, then old ones, then '-'. A table has as many rows as there are metrics, so orders are windows
    over its distinct names.
    """
    both = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    rows = both.groupBy("row").agg(F.min(F.struct("_new", "row_no")).alias("o"))
    columns = both.groupBy("column").agg(F.max("_new").alias("_last"), F.min(F.when(F.col("_new") == 1, F.col("column_no"))).alias("_n"), F.min("column_no").alias("_o"))
    rows = rows.select("row", F.row_number().over(Window.orderBy("o", "row")).alias("row_no"))
    columns = columns.select("column", F.row_number().over(Window.orderBy("_last", F.coalesce("_n", "_o"), "column")).alias("column_no"))
    cells = both.groupBy("row", "column").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_new"))).alias(value))
    grid = rows.join(columns, F.lit(True))  # names by names: the table itself
    return grid.join(cells, ["row", "column"], "left").select("row", "row_no", "column", "column_no", F.coalesce(value, F.lit("-")).alias(value))


def as_table(cells: DataFrame, corner: str, value: str = "cell") -> str:
    """Cells of `merged_table` as a Markdown table: one text of a report's size."""
    found: dict[int, dict[int, str]] = {}
    rows: dict[int, str] = {}
    columns: dict[int, str] = {}
    for c in cells.toLocalIterator():
        rows[c["row_no"]], columns[c["column_no"]] = c["row"], c["column"]
        found.setdefault(c["row_no"], {})[c["column_no"]] = c[value]
    line = lambda values: "| " + " | ".join(v.replace("|", "\\|").replace("\n", " ") for v in values) + " |"
    out = [line([corner, *(columns[k] for k in sorted(columns))]), "|" + "---|" * (len(columns) + 1)]
    return "\n".join([*out, *(line([rows[r], *(found[r].get(k, "-") for k in sorted(columns))]) for r in sorted(rows))]) + "\n"


#: Metrics of the basic table; the others have tables of their own.
BASIC = ("accuracy", "correct", "total")


def basic_cells(metrics: DataFrame) -> DataFrame:
    """(row, column, cell) of accuracy, correct and total by model, from (model, path, acc, n)."""
    whole = metrics.filter(F.size("path") == 0)
    n = F.col("n").cast("long")
    cells = F.array(F.struct(F.lit("accuracy").alias("row"), formatted(F.col("acc")).alias("cell")), F.struct(F.lit("correct").alias("row"), F.round(F.col("acc") * n).cast("long").cast("string").alias("cell")), F.struct(F.lit("total").alias("row"), n.cast("string").alias("cell")))
    return whole.select(F.col("model").alias("column"), F.explode(cells).alias("c")).select("c.row", "column", "c.cell")


def other_sections(metrics: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """(section, row, column, cell): a section for each dimension, its splits by model, and one of scalar metrics.

    scalars: (model, name, value); basic metrics are left out.
    """
    from qaspark.operators.charts import dimension_name

    dims = metrics.filter(F.size("path") > 0).select(dimension_name(F.col("path")).alias("section"), F.get("path", F.size("path") - 1)["split"].alias("row"), F.col("model").alias("column"), formatted(F.col("acc")).alias("cell"))
    if scalars is None:
        return dims
    plain = scalars.filter(~F.col("name").isin(*BASIC)).select(F.lit("").alias("section"), F.col("name").alias("row"), F.col("model").alias("column"), formatted(F.col("value")).alias("cell"))
    return plain.unionByName(dims)


def extra_metrics(metrics: DataFrame) -> DataFrame:
    """(name, value) of a run's metrics beyond the basic ones, as dimension.split."""
    last = F.get("path", F.size("path") - 1)
    return metrics.filter(F.size("path") == 1).select(F.concat(last["dim"], F.lit("."), last["split"]).alias("name"), F.col("acc").alias("value"))


def benchmark_sections(cells: DataFrame) -> DataFrame:
    """Cells of the sections that a benchmark page shows: not those of counts."""
    return cells.filter(~F.col("section").endswith("_counts"))


def display_names(configs: DataFrame) -> DataFrame:
    """(name): from (path, table_display) the declared name, else the two folders behind the dataset's; each once."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # without the file
    name = F.when(F.size(folders) > 0, F.array_join(F.slice(folders, 1, 2), "/"))
    return configs.select(F.coalesce(F.nullif(F.trim("table_display"), F.lit("")), name).alias("name")).filter("name IS NOT NULL").distinct()


def colour(value: Column, low: Column, high: Column) -> Column:
    """A colour #rrggbb on the way from white to green; the middle where all values are equal, white without a value."""
    place = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.5))
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))
    part = lambda start, end: F.lpad(F.lower(F.hex(F.round(F.lit(float(start)) + place * (end - start)).cast("long"))), 2, "0")
    return F.when(value.isNull(), "#ffffff").otherwise(F.concat(F.lit("#"), part(255, 99), part(255, 190), part(255, 123)))


def label_counts(labels: DataFrame, rows: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Labels by split and iteration: a column for each label and the total, for a filter's summary."""
    wide = labels.groupBy(*rows).pivot("label", list(kinds)).agg(F.count(F.lit(1)))
    counts = [F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias(k) for k in kinds]
    total = labels.groupBy(*rows).agg(F.count(F.lit(1)).alias("total"))
    return wide.select(*rows, *counts).join(total, list(rows))


def latest(runs: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The run of the largest name, as strings compare."""
    return runs.groupBy(*by).agg(F.max(order).alias(order))


def tiers(wrong: Column, total: Column) -> Column:
    return F.when(wrong >= total, 1).when(2 * wrong >= total, 2).otherwise(3)


def compared(metrics: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value, baseline's value and the difference, along equal paths."""
    other = baseline.select(*keys, F.col(value).alias("baseline"))
    return metrics.join(other, list(keys), "left").withColumn("diff", F.col(value) - F.col("baseline"))


def upserted(board: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest version of each key; the incoming one on a tie."""
    both = board.withColumn("_fresh", F.lit(0)).unionByName(incoming.withColumn("_fresh", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_fresh").desc()))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_fresh")
