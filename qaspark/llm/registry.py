"""The queries op1_ to op10_ and pipeline, and their SQL where SQL can express them.

Not in SQL: op1 (image coding), op6 (the hash functions), op8 and op10 (tokenizers), op9 (a trained model),
pipeline (which has op9 and op10 as stages). Tests hold these against brute force and round trips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, curriculum, debruijn, extendible, jaccard, langid, linededup, syncmers, tokencount, webp


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(webp.decode_column(webp.store_column(documents(spark, sf_dir))))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(documents(spark, sf_dir)).orderBy(F.col("position").asc_nulls_last(), "key")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "start", "position")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM s),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
    CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    CASE k WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS slope
  FROM r),
v AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, source_size, slope, least(most, max(level) OVER () * weight) AS target FROM v),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.slope, t.target, floor(t.target + 0.5)::BIGINT AS demand,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (least(greatest(demand - start, 0), size) + least(greatest(demand - source_size - start, 0), size))::BIGINT AS taken FROM p)
SELECT doc_id, size, source_size, target, taken, start,
  CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN start::DOUBLE / demand
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (start::DOUBLE / demand)) - (1 - slope)) / (2 * slope) END END AS position
FROM q"""


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.shards(documents(spark, sf_dir))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
x AS (SELECT doc_id, n_bytes, h, unnest(range(0, 61)) AS depth FROM d),
y AS (SELECT *, h >> (60 - depth)::INTEGER AS prefix FROM x),
g AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs, min(h) = max(h) AS one
  FROM y GROUP BY depth, prefix),
l AS (
  SELECT y.doc_id, y.n_bytes, min(depth) AS depth, arg_min(prefix, depth) AS prefix, arg_min(shard_bytes, depth) AS shard_bytes, arg_min(shard_docs, depth) AS shard_docs
  FROM y JOIN g USING (depth, prefix) WHERE g.shard_bytes <= {extendible.LIMIT} OR g.one OR depth = 60 GROUP BY y.doc_id, y.n_bytes, y.h)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard, depth::INTEGER AS depth, shard_bytes, shard_docs,
  shard_bytes <= {extendible.LIMIT} AS fits
FROM l"""


def op4_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = debruijn.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
x AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM i),
f AS (SELECT g, min(doc_id) AS first_id FROM x GROUP BY g),
r AS (SELECT x.doc_id, x.i FROM x JOIN f USING (g) WHERE f.first_id < x.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
k AS (
  SELECT p.doc_id, count(c.k)::BIGINT AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.k) FILTER (WHERE c.k IS NULL), '') AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.k = c.k GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(documents(spark, sf_dir))
    return cut.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
i AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3),
x AS (SELECT doc_id, i, array_to_string(list_slice(ls, i, i + 2), chr(10)) AS g FROM i),
f AS (SELECT g, min((doc_id, i)) AS first_at FROM x GROUP BY g),
r AS (SELECT x.doc_id, x.i FROM x JOIN f USING (g) WHERE (x.doc_id, x.i) > f.first_at),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS k FROM r),
p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM l),
k AS (
  SELECT p.doc_id, count(c.k)::BIGINT AS n_removed, coalesce(string_agg(p.line, chr(10) ORDER BY p.k) FILTER (WHERE c.k IS NULL), '') AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.k = c.k GROUP BY p.doc_id)
SELECT l.doc_id, coalesce(len(l.ls), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.kept) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id"""


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = syncmers.with_next(documents(spark, sf_dir))
    marked = marked.withColumn("edited", syncmers.edited(F.col("text"), F.col("next_text")))
    marked = syncmers.with_fingerprint(syncmers.with_hashes(marked, F.col("edited"), "_edited"), "_edited", "edited_sketch")
    marked = syncmers.with_likeness(marked, "sketch", "edited_sketch", "near_edited")
    marked = syncmers.with_likeness(marked, "sketch", "next_sketch", "near_next")
    return marked.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_string(F.col("sketch")).alias("fingerprint"), syncmers.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op7_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0),
x AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM i),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM x GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT o.a, o.b FROM o JOIN n na ON o.a = na.doc_id JOIN n nb ON o.b = nb.doc_id
  WHERE 100 * o.shared >= 85 * (na.n + nb.n - o.shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id"""


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    counts = tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode_column(documents(spark, sf_dir), ranks, tokenizers.PATTERN)
    return bytebpe.digests(bytebpe.decode_column(encoded, ranks, tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = [op1_lossless_webp, op2_curriculum_mix, op3_extendible_shards, op4_debruijn_spans, op5_line_windows, op6_syncmers, op7_count_vector_join, op8_token_counts, op9_language_profiles, op10_byte_bpe]
    return {f.__name__: f for f in own} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op2_curriculum_mix": OP2_SQL, "op3_extendible_shards": OP3_SQL, "op4_debruijn_spans": OP4_SQL, "op5_line_windows": OP5_SQL, "op7_count_vector_join": OP7_SQL}
