"""Document fingerprints from closed syncmers and their places, with DataFrame functions only.

A run of K tokens is an anchor if the smallest hash among its inner runs of S tokens lies at its first or last
place. Whether a run is an anchor depends on its own tokens alone, so shared passages give shared anchors wherever
they stand. Tokens are words; characters of scripts that are written without spaces are tokens of their own. Texts
of fewer than SHORT tokens have the anchors of their code points too, so that short edited texts share some.

An anchor is one number: HASH_BITS of its hash, then its place (its first token's, PLACE_BITS; places go round
beyond 16.7 million tokens). The fingerprint holds the SKETCH smallest anchors, each hash with its first place; all
tokens of the text are read. `with_likeness` matches by place: shared anchors count if they stand at the same place,
or if another shared anchor is shifted as far. Of the SKETCH smallest hashes of both texts together it gives the
share that match so: an estimate of the Jaccard likeness of anchors, less what is shared by chance.

Defined results. Null text: as empty. No tokens: the fingerprint is '' and is like only another '' (likeness 1).
Fewer than K tokens and code points, or no anchor: one anchor, the hash of the whole sequence. Ties of the smallest
inner hash count as an edge if an edge place has it. Null doc_id: after all others in the order of successors. Equal
doc_ids stand in order of text. Empty table: no rows. Equal texts have equal fingerprints, with likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

K, S, SKETCH = 5, 2, 128
SHORT = 64
#: 39 bits of hash, 24 of place: one bit is left to tell two texts apart.
HASH_BITS, PLACE_BITS = 39, 24
#: Ranges of doc_id in which a window finds successors: one for so many rows, within these limits.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 256, 1 << 16
#: Characters of scripts without spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"


def tokens(text: Column) -> Column:
    """Words, and single characters of scripts without spaces."""
    mixed = F.regexp_extract_all(text, F.lit(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[{UNSPACED}]"), mixed).otherwise(words(text))


def with_hashes(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add `out`, the hashes of the text's tokens, and `<out>_chars`, those of a short text's code points."""
    df = df.withColumn(out, F.transform(tokens(text), lambda w: F.xxhash64(w)))
    points = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    short = F.when(F.size(out) < SHORT, F.transform(points, lambda c: F.xxhash64(c, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(f"{out}_chars", short)


def packed(hash_: Column, place: Column) -> Column:
    """An anchor's hash and place as one number; numbers are in order of the hash."""
    return F.shiftright(hash_, 64 - HASH_BITS) * F.lit(1 << PLACE_BITS) + place.cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def with_anchors(df: DataFrame, hashes: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add `out`: the packed anchors of a sequence of hashes, in order of place."""
    h, inner = F.col(hashes), f"_{out}_inner"
    runs = F.slice(h, 1, F.greatest(F.size(h) - (s - 1), F.lit(0)))
    df = df.withColumn(inner, F.transform(runs, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, s)))))
    last = k - s
    at = lambda i, j: F.get(F.col(inner), i + j)
    firsts = F.slice(F.col(inner), 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))

    def anchor(x: Column, i: Column) -> Column:
        edge = F.least(x, at(i, last))
        middle = F.least(*(at(i, j) for j in range(1, last))) if last > 2 else at(i, 1)
        return F.when(edge <= middle, packed(F.xxhash64(*(F.get(h, i + j) for j in range(k))), i))

    return df.withColumn(out, F.array_compact(F.transform(firsts, anchor))).drop(inner)


def with_fingerprint(df: DataFrame, hashes: str, out: str, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """Add `out`: the sorted array of the smallest packed anchors, from `with_hashes`; drops the hashes."""
    own, chars, every = f"_{out}_own", f"_{out}_chars", f"_{out}_every"
    df = with_anchors(with_anchors(df, hashes, own, k, s), f"{hashes}_chars", chars, k, s)
    both = F.concat(own, chars)
    whole = F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.array(packed(F.xxhash64(hashes), F.lit(0))))
    df = df.withColumn(every, F.sort_array(F.when(F.size(both) == 0, whole).otherwise(both)))
    first = F.filter(every, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(every, i - 1))))
    return df.withColumn(out, F.slice(first, 1, sketch)).drop(own, chars, every, hashes, f"{hashes}_chars")


def with_likeness(df: DataFrame, a: str, b: str, out: str, sketch: int = SKETCH) -> DataFrame:
    """Add `out`: how alike two fingerprints are, 0 to 1, by anchors that match in place; two empty ones are alike."""
    marks, offsets, union = f"_{out}_marks", f"_{out}_offsets", f"_{out}_union"
    side = lambda array, of: F.transform(array, lambda v: v * 2 + of)
    df = df.withColumn(marks, F.sort_array(F.concat(side(F.col(a), 0), side(F.col(b), 1))))
    df = df.withColumn(union, F.slice(F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, PLACE_BITS + 1))), 1, sketch))
    largest = F.get(union, F.size(union) - 1)
    place = lambda m: F.shiftright(m, 1).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))

    def offset(m: Column, i: Column) -> Column:
        nxt, h = F.get(marks, i + 1), F.shiftright(m, PLACE_BITS + 1)
        shared = (h == F.shiftright(nxt, PLACE_BITS + 1)) & (h <= largest)  # one from each text
        return F.when(shared, (place(m) - place(nxt)) * (1 - 2 * m.bitwiseAND(F.lit(1).cast("long"))))

    df = df.withColumn(offsets, F.sort_array(F.array_compact(F.transform(marks, offset))))
    agrees = lambda o, i: (o == 0) | F.coalesce(o == F.get(offsets, i - 1), F.lit(False)) | F.coalesce(o == F.get(offsets, i + 1), F.lit(False))
    share = F.size(F.filter(offsets, agrees)) / F.size(union)
    return df.withColumn(out, F.when(F.size(union) == 0, F.lit(1.0)).otherwise(share)).drop(marks, offsets, union)


def as_string(sketch: Column) -> Column:
    """Sixteen hex digits for each anchor."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Add the sketch of `text` to (doc_id, text, ...)."""
    return with_fingerprint(with_hashes(docs, F.col("text"), "_words"), "_words", "sketch")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): next is the document that follows by descending
    doc_id, after the last the first.

    Rows are dealt by ranges of doc_id between quantiles; within a range a window finds the successor.
    The last of each range is followed by the first of the next range that has rows: one row for each range.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = read.filter(F.col("doc_id").isNotNull())
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, ids.count() // ROWS_A_RANGE))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(width_bucket(F.col("doc_id"), bounds))
    dealt = read.withColumn("part", place.cast("int"))
    lowest = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    tops = dealt.groupBy("part").agg(F.max(lowest).alias("top"))  # at most MOST_RANGES + 1 rows
    heads = dealt.withColumn("top", lowest).join(F.broadcast(tops), ["part", "top"]).groupBy("part").agg(F.min("text").alias("text"))
    ring = Window.orderBy(F.col("part").desc())  # numbers of ranges, no texts
    following = tops.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("then"))
    # each range ends with a copy of the next range's first row, which is nobody's own
    ends = following.join(heads.withColumnRenamed("part", "then"), "then").select(F.lit(None).cast("long").alias("doc_id"), "text", "part", F.lit(True).alias("copy"))
    inside = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("text"))
    # dealt by range: parts in a row go to one task, so that tasks are alike; sketches are made behind the shuffle
    every = dealt.withColumn("copy", F.lit(False)).unionByName(ends).repartitionByRange("part")
    follows = fingerprints(every).withColumn("_next", F.lead(F.struct("text", "sketch")).over(inside)).filter("NOT copy")
    return follows.select("doc_id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))


def width_bucket(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at or below the value: first among every m-th bound, then between two."""
    m = max(1, int(len(bounds) ** 0.5))
    numbers = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    upto = lambda array: F.size(F.filter(array, lambda b: b <= value))
    coarse = upto(numbers(bounds[m - 1 :: m]))
    return coarse * m + upto(F.slice(numbers(bounds), coarse * m + 1, F.lit(m)))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of `following`."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))
