"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are hashed to 128 bits; a window that occurs before, in
order of doc_id and position, is a repeat, and all lines that repeats cover are removed: covered
positions merge into ranges, the lines between them stay.

Very frequent windows, those with more than one in a THOUSANDTH of all occurrences, are fewer than
THOUSANDTH by that proof and so are broadcast; all others meet in a shuffle join without hot keys.

Defined results. Null text: no lines, kept text null. Empty text: one empty line, kept. Fewer than three
lines: kept whole. Null doc_id: after all others. Repeated rows (same doc_id, same text) are one document
and get one result each; different texts under one doc_id stand in order of a hash of the text.
Within a document the second of two equal windows is removed like any other. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WIDTH, THOUSANDTH = 3, 1000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, row_key, lines) -> one row for each window: (id, row_key, pos, h1, h2)."""
    count = F.greatest(F.size("lines") - (width - 1), F.lit(0))

    def hashed(line: Column, i: Column) -> Column:
        run = [line, *(F.get(F.col("lines"), i + k) for k in range(1, width))]
        return F.struct(i.alias("pos"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit("w"), *reversed(run)).alias("h2"))

    made = F.transform(F.slice("lines", 1, count), hashed)
    return keyed.filter(F.size("lines") >= width).select("id", "row_key", F.explode(made).alias("w")).select("id", "row_key", "w.*")


def repeats(found: DataFrame) -> DataFrame:
    """The windows that occur before: (id, row_key, pos)."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row_key", "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = materialize(firsts)
    total = found.count()
    hot = firsts.filter(F.col("n") * THOUSANDTH > total).drop("n")
    rest = firsts.filter(F.col("n") * THOUSANDTH <= total).drop("n")
    later = place > F.col("first")
    by_broadcast = found.join(F.broadcast(hot), ["h1", "h2"]).filter(later)
    cool = found.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    return by_broadcast.select("id", "row_key", "pos").unionByName(cool.join(rest, ["h1", "h2"]).filter(later).select("id", "row_key", "pos"))


def kept_lines(lines: Column, covered: Column, width: int = WIDTH) -> Column:
    """The lines outside the merged ranges; `covered`: sorted first positions of the repeats."""
    starts = F.filter(covered, lambda p, i: (i == 0) | (p > F.get(covered, i - 1) + width))
    ends = F.filter(covered, lambda p, i: (i == F.size(covered) - 1) | (F.get(covered, i + 1) > p + width))
    froms = F.concat(F.array(F.lit(0)), F.transform(ends, lambda p: p + width))
    upto = F.concat(starts, F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(froms.alias("a"), upto.alias("b")), lambda r: F.slice(lines, r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Every row of `docs` with its columns in a struct `row`, and n_lines, n_removed, kept_text."""
    key = F.xxhash64(F.col(text_col))
    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key.alias("row_key"), lines_of(F.col(text_col)).alias("lines"))
    found = materialize(windows(keyed, width))
    covered = repeats(found).groupBy("id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("covered"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("row_key"))
    joined = whole.alias("d").join(covered.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.row_key") == F.col("c.row_key")), "left").select("row", "covered")
    cut = joined.withColumn("lines", lines_of(F.col(f"row.{text_col}")))
    kept = F.when(F.col("covered").isNull(), F.col("lines")).otherwise(kept_lines(F.col("lines"), F.col("covered"), width))
    cut = cut.withColumn("kept", kept)
    return cut.select(
        "row",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("lines").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
    )
