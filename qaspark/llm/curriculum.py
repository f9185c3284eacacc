"""Mixing sources to target weights over a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule w(t), linear over training time t in [0, 1]. Its integral is the
source's weight; the weights share a total demand of tokens, a source's target stops at `cap` times
its size and the excess goes to the others by weight (water filling). Cumulative token demand of a
source, target * F(t) with F(t) = t (1 - a) + a t^2, is inverted to give each document the time at
which training reaches it; documents are range-sorted by that position.

Defined results. Null or empty text: size 0, taken 0, no position. Null source: a source of its own,
last in order. Null doc_id: hashed as the empty string. Repeated rows: each is a document of its own.
Empty table: no rows. No words at all: every target is 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (3.0, 1.0, 2.0)
#: Slopes of the schedules, repeating: a source starts at weight (1 - a) and ends at weight (1 + a).
SLOPES = (-0.5, 0.5, 0.0)
FACTOR, CAP = 1.5, 2.0
#: Hex digits of a document's hash that name its bucket: a source's running sum is made by bucket.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """(source, size) -> (source, source_size, weight, slope, target). One row per source.

    A source is capped while its share is above its cap. With sources in order of cap / weight, the
    level (demand left) / (weight left) is highest at the first source that is not capped.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ordered) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))
    listed = by_source.select("source", "source_size", pick(weights).alias("weight"), pick(slopes).alias("slope"), (cap * F.col("source_size")).alias("most"))
    everything = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(factor)
    before = F.coalesce(F.sum("most").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(everything.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = listed.withColumn("level", (total - before) / left)
    level = F.max("level").over(Window.partitionBy())
    return levels.withColumn("target", F.least("most", level * F.col("weight"))).drop("most", "level")


def position(offset: Column, demand: Column, slope: Column) -> Column:
    """Training time at which the source's cumulative demand reaches `offset` tokens."""
    q = offset / demand
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * q)
    return F.when(slope == 0, q).otherwise((root - (1 - slope)) / (2 * slope))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, factor: float = FACTOR, cap: float = CAP, seed: str = "mix", bucket_digits: int = BUCKET_DIGITS, id_col: str = "doc_id", more: Sequence[str] = ()) -> DataFrame:
    """One row per document: its size, its source's target, the words taken and where in training.

    Within a source documents stand in hash order; passes over the source follow one another until
    its target is used up, so `taken` is up to `cap` sizes and one document per source may be cut.
    Columns: doc_id, source, size, source_size, weight, slope, target, demand, start (tokens of the source
    before the document), taken, key (the hash that orders them), position (of its first token; null if none),
    and the columns of `more`.
    """
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *more))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = slim.withColumn("key", key).withColumn("bucket", F.substring("key", 1, bucket_digits))
    targets = source_targets(slim, weights, slopes, factor, cap)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(in_order), F.lit(0)))
    table = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "bucket_start", "source_size", "weight", "slope", "target")
    within = Window.partitionBy("k.source", "k.bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.alias("k").join(table.alias("b"), F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.bucket") == F.col("b.bucket")))
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = placed.select("doc_id", "k.source", "size", "source_size", "weight", "slope", "target", F.floor(F.col("target") + 0.5).cast("long").alias("demand"), start.cast("long").alias("start"), "key", *more)
    return placed.withColumn("taken", taken(cap)).withColumn("position", F.when(F.col("taken") > 0, position(F.col("start"), F.col("demand"), F.col("slope"))))


def taken(cap: float = CAP) -> Column:
    """Tokens of the document within its source's demand, over ceil(cap) passes."""
    passes = [F.least(F.greatest(F.col("demand") - p * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size")) for p in range(int(-(-cap // 1)))]
    return sum(passes[1:], passes[0]).cast("long")


def training_order(mixed: DataFrame, cap: float = CAP) -> DataFrame:
    """One row per document and pass, whole documents only, range-sorted by training position.

    A pass takes a document if at least half of its words lie within the demand. Adds `pass`.
    """
    each = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1)))).drop("position")
    offset = F.col("pass") * F.col("source_size") + F.col("start")
    each = each.filter((F.col("size") > 0) & (2 * (F.col("demand") - offset) >= F.col("size")))
    return each.withColumn("position", position(offset, F.col("demand"), F.col("slope"))).orderBy("position", "key", "doc_id", "pass")


def mixed_rows(docs: DataFrame, cap: float = CAP, **options) -> DataFrame:
    """The rows of `docs` in training order, as often as they are taken whole (`training_order`).

    Rows are numbered in a table; only numbers and sizes are mixed, then the rows join their positions.
    """
    table = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    slim = table.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"), "number")
    places = materialize(training_order(mix(slim, cap=cap, more=("number",), **options), cap).select("number", "pass", "position", "key"))
    return table.join(places, "number").orderBy("position", "key", "number", "pass").select("row.*")
