"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the first bits of each document's hash. Buckets over the byte limit split on
their next bit, others stay, until every shard fits. Only per-cell sums are shuffled, never texts: one
round sums a cell for each value of the bits it may need, then every depth of the trie at once; a later
round opens only those cells that are still too large at its last bit.

Defined results. A bucket whose documents share one hash (one huge document, or one doc_id many times)
can't split; it stays, with fits = false. Null or empty text: 0 bytes. Null doc_id: hashed as the empty
string. Repeated rows share a shard. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HASH_BITS = 60
#: Bytes of text a shard may hold in the query; a parameter of the operator.
LIMIT = 1 << 20
#: Bits that a later round looks at; bits of the first round beyond those that the mean needs.
STEP, SPARE, MOST_FIRST = 8, 4, 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(hashed: Column, bits: Column | int) -> Column:
    shift = F.lit(HASH_BITS) - bits
    return F.call_function("shiftright", hashed, shift.cast("int"))


def trie_level(cells: DataFrame, parents: DataFrame | None, first: int, last: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves at depths first..last below the open `parents` (all, if None), and the nodes still open at `last`.

    cells: (cell, bytes, docs, low, high) at depth `last`; a node is done if it fits or has one hash.
    """
    nodes = cells.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"), "*")
    nodes = nodes.withColumn("prefix", F.call_function("shiftright", "cell", (F.lit(last) - F.col("depth")).cast("int")))
    nodes = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    nodes = materialize(nodes.withColumn("fits", F.col("shard_bytes") <= limit).withColumn("done", F.col("fits") | (F.col("low") == F.col("high")) | (F.col("depth") == HASH_BITS)))
    over = nodes.filter(~F.col("done")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    top = parents.select(F.lit(first).alias("depth"), F.col("cell").alias("parent")) if parents is not None else None
    over = over.unionByName(top) if top is not None else over
    child = nodes.filter("done").withColumn("parent", F.call_function("shiftright", "prefix", F.lit(1)))
    leaves = child.join(over, ["depth", "parent"], "left_semi")
    if parents is None:
        leaves = leaves.unionByName(child.filter(F.col("depth") == 0))
    still = nodes.filter(~F.col("done") & (F.col("depth") == last)).select(F.col("prefix").alias("cell"))
    return leaves.select("depth", "prefix", "shard_bytes", "shard_docs", "fits"), still


def directory(slim: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, (cell, depth, shard, shard_bytes, shard_docs, fits))]: each round's directory, cell by cell.

    slim: (hash, n_bytes). Each bucket is listed once for every directory entry that points to it.
    """
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    last = min(MOST_FIRST, max(SPARE, (max(1, total // max(1, limit)) - 1).bit_length() + SPARE))
    rounds, parents, first, rows = [], None, 0, slim
    while True:
        cells = rows.groupBy(prefix(F.col("hash"), last).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        leaves, still = trie_level(cells, parents, first, last, limit)
        span = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(last) - F.col("depth")).cast("int"))
        bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
        entries = leaves.select(F.explode(F.sequence(F.col("prefix") * span, F.col("prefix") * span + span - 1)).alias("cell"), F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", "shard_docs", "fits")
        rounds.append((last, entries))
        if last == HASH_BITS or still.isEmpty():
            return rounds
        rows = rows.withColumn("cell", prefix(F.col("hash"), last)).join(still, "cell", "left_semi").drop("cell")
        parents, first, last = still, last + 1, min(HASH_BITS, last + STEP)


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, fits): the shard is its prefix of bits."""
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(id_col)).alias("hash")))
    out, found = slim, ["depth", "shard", "shard_bytes", "shard_docs", "fits"]
    for k, (bits, entries) in enumerate(directory(slim.select("hash", "n_bytes"), limit)):
        entries = entries.select(F.col("cell"), F.struct(*found).alias(f"r{k}"))
        out = out.withColumn("cell", prefix(F.col("hash"), bits)).join(entries, "cell", "left").drop("cell")
    ways = [c for c in out.columns if c.startswith("r") and c[1:].isdigit()]
    return out.select("doc_id", "n_bytes", F.coalesce(*ways).alias("at")).select("doc_id", "n_bytes", *[f"at.{c}" for c in found])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as Parquet, one folder and one file for each shard."""
    table = shards(docs, limit, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard").distinct()
    joined = docs.alias("d").join(table.alias("s"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"s.{id_col}"))).select("d.*", "s.shard")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
