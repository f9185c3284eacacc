"""Tables in Markdown and HTML: reading them as cells, writing them from cells."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cells(texts: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """(file, section, table, row_no, row, column, cell) of every cell of the Markdown tables in `texts`.

    A table begins with the line above a rule of dashes; its first column names the row. Section is the last
    heading above. Cells beyond the header go, missing ones are absent.
    """
    parts = lambda t: F.transform(F.split(F.regexp_replace(F.trim(t), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = texts.select(F.col(file).alias("file"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("pos", "line"))
    by_file = Window.partitionBy("file").orderBy("pos")
    piped = F.trim("line").startswith("|")
    rule = piped & F.col("line").rlike(r"^[\s|:\-]+$") & F.col("line").contains("-")
    lines = lines.withColumn("section", F.last(F.when(F.col("line").rlike(r"^#+\s"), F.trim(F.regexp_replace("line", r"^#+\s+", ""))), True).over(by_file))
    lines = lines.withColumn("piped", piped).withColumn("rule", rule).withColumn("head", F.coalesce(F.lead(rule).over(by_file), F.lit(False)) & piped)
    lines = lines.withColumn("table", F.sum(F.col("head").cast("int")).over(by_file)).withColumn("header", F.last(F.when(F.col("head"), parts(F.col("line"))), True).over(by_file))
    body = lines.filter(F.col("piped") & ~F.col("rule") & ~F.col("head") & (F.col("table") > 0)).withColumn("c", parts(F.col("line")))
    named = F.slice(F.arrays_zip(F.col("header").alias("column"), F.slice("c", 1, F.size("header")).alias("cell")), 2, F.size("header"))
    each = body.select("file", "section", "table", F.col("pos").alias("row_no"), F.col("c")[0].alias("row"), F.explode(named).alias("n"))
    return each.select("file", "section", "table", "row_no", "row", F.col("n")["column"].alias("column"), F.col("n")["cell"].alias("cell")).filter(F.col("cell").isNotNull())


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    texts = spark.read.option("wholetext", True).text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value")
    return cells(texts)


def number(cell: Column) -> Column:
    """A cell as DOUBLE; null for '-' and for text."""
    return F.when(cell != "-", cell.try_cast("double"))


def split_label(label: Column) -> tuple[Column, Column]:
    """(model, judge) of `model/judge`, without the prefix judge- of the second part; the judge is empty without one."""
    parts = F.split(label, "/", 2)
    return parts[0], F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"(?i)^judge[-:_]", "")


def resolved(raw: DataFrame, labels: DataFrame, column: str = "label") -> DataFrame:
    """(label, resolved): the label itself if it is known, else the only known one below it, else itself."""
    known = labels.select(F.col(column).alias("known"), F.substring_index(column, "/", 1).alias("head")).distinct()
    found = raw.select(F.col(column).alias("label"), F.substring_index(column, "/", 1).alias("head")).distinct().join(known, "head", "left")
    below = F.col("known").startswith(F.concat("label", F.lit("/")))
    out = found.groupBy("label").agg(F.bool_or(F.col("known") == F.col("label")).alias("same"), F.count_if(below).alias("n"), F.min(F.when(below, F.col("known"))).alias("one"))
    return out.select("label", F.when(~F.coalesce("same", F.lit(False)) & (F.col("n") == 1), F.col("one")).otherwise(F.col("label")).alias("resolved"))


def heat(metrics: DataFrame, row: str, value: str) -> DataFrame:
    """Cells with their place between the least and the largest value of all, and whether they are the row's best."""
    everywhere = metrics.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    best = metrics.groupBy(F.col(row).alias("_row")).agg(F.max(value).alias("top"))
    # one row of two numbers
    out = metrics.join(best, F.col(row).eqNullSafe(F.col("_row"))).crossJoin(F.broadcast(everywhere))
    place = F.coalesce(F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    return out.withColumn("heat", place.cast("double")).withColumn("best", F.coalesce(F.col(value) == F.col("top"), F.lit(False))).drop("_row", "low", "high", "top")


def as_markdown(table: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A report table as Markdown: a report has as many rows as there are metrics, not as there are samples."""
    columns = list(columns or table.columns)
    escape = lambda v: "-" if v is None or v == "" else str(v).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(map(escape, columns)) + " |", "|" + " --- |" * len(columns)]
    out += ["| " + " | ".join(escape(r[c]) for c in columns) + " |" for r in table.select(*columns).toLocalIterator()]
    return "\n".join(out) + "\n"


def as_html(table: DataFrame, title: str) -> str:
    """A report table as an HTML page."""
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('-' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    lines = [row("td", r) for r in table.toLocalIterator()]
    return "\n".join(["<!doctype html>", f"<meta charset=\"utf-8\"><title>{html.escape(title)}</title>", f"<h1>{html.escape(title)}</h1>", "<table>", row("th", table.columns), *lines, "</table>", ""])
