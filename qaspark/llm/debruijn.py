"""Substring dedup on the De Bruijn graph of word windows.

An edge is a window of WINDOW consecutive words that several documents have; its nodes are its first and its
last WINDOW - 1 words. An edge is named by where it stands first: (id, tag, at).

1. Workers hash the windows of a slice of documents (80 bits); one that stands in several documents of the
   slice is settled there, with the slice's smallest document as its source, so a frequent edge leaves each slice
   once. What is left meets by hash and takes its first document as its source.
2. A document walks through edges. Edges that follow one another both in the document and in the source are
   one walk (`walks`): the compaction that needs no other document.
3. `graph` compacts across documents, by Spark joins. Names that a slice gave are replaced by the first ones (a
   sweep along each source). Where a walk meets another edge than its source's next one, the node between has a
   further way in or out; aggregates count the ways. Edges of a source between such nodes are one segment. A
   link that is the only way out of one segment and the only way into another does not branch: joins that double
   their reach each round give all segments of a nonbranching path the name of its first edge.
4. A span is a run of walks of one document whose links do not branch. Walks are verified: a co-group with the
   texts gives 128-bit digests of each walk's words and of its source's, and a join compares them. Should a
   digest differ, which means a collision of hashes, the edges are named again by 128 bits.

A document's words that lie in spans are removed, the rest is joined by single spaces. Where a document has an edge
again of which it is itself the source, that second place is not followed in the graph; nothing is removed there.

Defined results. Null or empty text: no words, nothing removed. Fewer than WINDOW words: kept. Windows that
repeat within one document only: kept. Null doc_id: larger than every other, equal to other nulls. Rows
with one doc_id: none is earlier than another; each row has its own result. Paths that are circles have the name of
their smallest segment. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NULL_ID, doc_bucket, doc_buckets, named_documents, packed_documents, text_bytes, window_bits
from .common import discard, in_batches, materialize, workers_see_package

WINDOW = 13
#: A walk: `n_words` words from `start` on, which its source has from `source_start` on. follows: the window before is
#: of another walk; linked: the window behind is, whose source and place in it are to_id, to_tag and to_start.
WALKS = "doc_bucket int, doc_id long, tag long, start long, n_words long, source_id long, source_tag long, source_start long, follows boolean, linked boolean, to_id long, to_tag long, to_start long"


def edges(named: DataFrame, width: int, bits: int, buckets: int, wide: bool = False) -> DataFrame:
    """(bucket, doc_bucket, block): edges that are still open by hash bucket, settled ones (doc_bucket >= 0) as they are."""

    def found(batches):
        import pyarrow as pa

        from qaspark.llm import blocks, common, debruijn

        for number, (ids, tags, data, offsets) in enumerate(blocks.slices(batches)):
            begin, end, first = common.word_spans(data, offsets)
            hashes = common.word_hashes(data, begin, end)
            rows = np.repeat(np.arange(len(ids)), np.diff(first))
            fits = np.arange(len(rows)) + width <= first[rows + 1]
            at = np.flatnonzero(fits[: max(0, len(rows) - width + 1)])
            h1, h2 = common.window_hashes(hashes, width)[at], common.window_hashes(hashes, width, 1)[at]
            rows = rows[at]
            pos = (at - first[rows]).astype(np.uint32)
            order = np.argsort(h1, kind="stable")
            starts = blocks.run_starts(h1[order], h2[order])
            source = order[np.repeat(starts, np.diff(np.append(starts, len(order))))]
            origin = np.empty(len(order), np.int64)
            origin[order] = source
            settled = ids[rows] > ids[rows[origin]]
            where, to, out = [], [], []
            open_at = np.flatnonzero(~settled)
            for bucket, k in blocks.by_bucket((h1[open_at] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)):
                k = open_at[k]
                run = blocks.run_starts(rows[k])
                where.append(bucket)
                to.append(-1)
                step = np.diff(pos[k].astype(np.int64), prepend=0).astype(np.int32)
                out.append(blocks.pack(h1[k], h2[k] if wide else h2[k].astype(np.uint16), ids[rows[k[run]]], tags[rows[k[run]]], np.diff(np.append(run, len(k))).astype(np.uint32), step))
            k = np.flatnonzero(settled)
            of = origin[k]
            for bucket, block in debruijn.settled_blocks(ids[rows[k]], tags[rows[k]], pos[k], ids[rows[of]], tags[rows[of]], pos[of], buckets):
                where.append((bucket + number) % (1 << bits))
                to.append(bucket)
                out.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(to, pa.int32()), pa.array(out, pa.binary())], ["bucket", "doc_bucket", "block"])

    return in_batches(named, found, "bucket int, doc_bucket int, block binary")


def settled_blocks(ids, tags, pos, source_ids, source_tags, source_pos, buckets):
    """(doc_bucket, block) of edges with their sources; positions as steps, sources relative."""
    from .blocks import by_bucket, doc_places, pack

    order = np.lexsort((pos, tags, ids))
    ids, tags, pos, source_ids, source_tags, source_pos = (x[order] for x in (ids, tags, pos, source_ids, source_tags, source_pos))
    for bucket, k in by_bucket(doc_places(ids, tags, buckets)):
        p = pos[k].astype(np.int64)
        step = lambda x: np.diff(x, prepend=np.zeros(1, x.dtype))
        yield bucket, pack(step(ids[k]), tags[k], step(p), step(source_ids[k]), source_tags[k], step(source_pos[k].astype(np.int64) - p))


def settle(found: DataFrame, buckets: int) -> DataFrame:
    """Open edges meet by hash: (doc_bucket, block) of those with a source in an earlier document."""

    def meet(table):
        import pyarrow as pa

        from qaspark.llm import blocks, debruijn

        to, blobs = table.column("doc_bucket").to_pylist(), table.column("block").to_pylist()
        where, out = [t for t in to if t >= 0], [b for t, b in zip(to, blobs, strict=True) if t >= 0]
        parts = [blocks.unpack(b) for t, b in zip(to, blobs, strict=True) if t < 0]
        if parts:
            h1, h2 = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            ids, tags = (np.concatenate([np.repeat(p[c], p[4]) for p in parts]) for c in (2, 3))
            pos = np.concatenate([np.cumsum(p[5], dtype=np.int64) for p in parts]).astype(np.uint32)
            order = np.argsort(h1, kind="stable")
            starts = blocks.run_starts(h1[order])
            size = np.diff(np.append(starts, len(order)))
            several = order[np.repeat(size > 1, size)]  # only hashes that came more than once
            h1, h2, ids, tags, pos = (x[several] for x in (h1, h2, ids, tags, pos))
            order = np.lexsort((pos, tags, ids, h2, h1))
            h1, h2, ids, tags, pos = (x[order] for x in (h1, h2, ids, tags, pos))
            if len(h1):
                starts = blocks.run_starts(h1, h2)
                first = np.repeat(starts, np.diff(np.append(starts, len(h1))))
                k = np.flatnonzero(ids > ids[first])
                for bucket, block in debruijn.settled_blocks(ids[k], tags[k], pos[k], ids[first[k]], tags[first[k]], pos[first[k]], buckets):
                    where.append(bucket)
                    out.append(block)
        return pa.table({"doc_bucket": pa.array(where, pa.int32()), "block": pa.array(out, pa.binary())})

    return found.groupBy("bucket").applyInArrow(meet, "doc_bucket int, block binary")


def walks(settled: DataFrame, width: int) -> DataFrame:
    """Edges of a document that continue one another, here and in the source, become one walk."""

    def joined(key, table):
        import pyarrow as pa

        from qaspark.llm import blocks, debruijn

        parts = []
        for blob in table.column("block").to_pylist():
            ids, tags, pos, source, source_tag, shift = blocks.unpack(blob)
            pos = np.cumsum(pos)
            parts.append((np.cumsum(ids), tags, pos, np.cumsum(source), source_tag, np.cumsum(shift) + pos))
        ids, tags, pos, source, source_tag, source_pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, tags, ids))
        ids, tags, pos, source, source_tag, source_pos = (x[order] for x in (ids, tags, pos, source, source_tag, source_pos))
        keep = np.ones(len(ids), bool)  # equal rows settle the same edge twice
        keep[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (pos[1:] != pos[:-1])
        ids, tags, pos, source, source_tag, source_pos = (x[keep] for x in (ids, tags, pos, source, source_tag, source_pos))
        place = np.arange(len(ids))
        starts = blocks.run_starts(ids, tags, pos - place, source, source_tag, source_pos - place)
        count = np.diff(np.append(starts, len(ids)))
        after = np.append(starts[1:], starts[-1:])  # the next walk's first edge, if it is the document's next window
        linked = (ids[after] == ids[starts]) & (tags[after] == tags[starts]) & (pos[after] == pos[starts] + count)
        follows = np.concatenate([[False], linked[:-1]])
        columns = [np.full(len(starts), key[0].as_py(), np.int32), ids[starts], tags[starts], pos[starts], count + width - 1, source[starts], source_tag[starts], source_pos[starts], follows, linked, source[after], source_tag[after], source_pos[after]]
        return pa.table(dict(zip([c.split()[0] for c in debruijn.WALKS.split(", ")], map(pa.array, columns), strict=True)))

    return settled.groupBy("doc_bucket").applyInArrow(joined, WALKS)


# ---- the graph: names of edges are structs (id, tag, at) ---------------------------------


def own_walks(found: DataFrame, width: int) -> DataFrame:
    """(id, tag, at, upto, to): where documents that are sources have edges of earlier documents, named by those."""
    sources = found.select(F.col("source_id").alias("doc_id"), F.col("source_tag").alias("tag")).distinct()
    last = F.col("start") + F.col("n_words") - width
    to = F.struct(F.col("source_id").alias("id"), F.col("source_tag").alias("tag"), F.col("source_start").alias("at"))
    return found.join(sources, ["doc_id", "tag"], "left_semi").select(F.col("doc_id").alias("id"), "tag", F.col("start").alias("at"), last.alias("upto"), to.alias("to"))


def first_names(points: DataFrame, own: DataFrame) -> DataFrame:
    """(raw, edge): the first name of each edge (id, tag, at). A slice's source may itself have the edge from an
    earlier document; that document is first of all, so one step is enough."""
    marks = points.select("id", "tag", "at", F.lit(None).cast("long").alias("upto"), F.lit(None).cast(own.schema["to"].dataType).alias("to"), F.lit(True).alias("asked"))
    both = marks.unionByName(own.withColumn("asked", F.lit(False)))
    along = Window.partitionBy("id", "tag").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # places of one document
    walk = F.when(~F.col("asked"), F.struct(F.col("at").alias("start"), "upto", "to"))
    seen = both.withColumn("walk", F.last(walk, True).over(along)).filter("asked")
    moved = F.struct(F.col("walk.to.id").alias("id"), F.col("walk.to.tag").alias("tag"), (F.col("walk.to.at") + F.col("at") - F.col("walk.start")).alias("at"))
    raw = F.struct("id", "tag", "at")
    return seen.select(raw.alias("raw"), F.when(F.col("at") <= F.col("walk.upto"), moved).otherwise(raw).alias("edge"))


def stretches(found: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """(id, tag, at, upto): maximal runs of edges that stand first in the document; `upto` is the last one."""
    n = F.col("n_words") - (width - 1)
    step = lambda at, used, other: F.struct(at.alias("at"), F.lit(used).alias("used"), F.lit(other).alias("other"))
    steps = found.select(F.col("source_id").alias("id"), F.col("source_tag").alias("tag"), F.explode(F.array(step(F.col("source_start"), 1, 0), step(F.col("source_start") + n, -1, 0))).alias("s"))
    steps = steps.unionByName(own.select("id", "tag", F.explode(F.array(step(F.col("at"), 0, 1), step(F.col("upto") + 1, 0, -1))).alias("s")))
    steps = steps.groupBy("id", "tag", F.col("s.at").alias("at")).agg(F.sum("s.used").alias("used"), F.sum("s.other").alias("other"))
    along = Window.partitionBy("id", "tag").orderBy("at")  # places of one document
    here = (F.sum("used").over(along) > 0) & (F.sum("other").over(along) == 0)
    states = steps.select("id", "tag", "at", here.alias("here"))
    ends = states.withColumn("before", F.coalesce(F.lag("here").over(along), F.lit(False))).filter("here <> before")
    return ends.withColumn("next", F.lead("at").over(along)).filter("here").select("id", "tag", "at", (F.col("next") - 1).alias("upto"))


def _edge(id_: str, tag: str, at: Column) -> Column:
    return F.struct(F.col(id_).alias("id"), F.col(tag).alias("tag"), at.alias("at"))


def walk_links(found: DataFrame, width: int) -> DataFrame:
    """(a, b): the last edge of a walk and the next walk's first, by the names that walks give them; each pair once."""
    last = _edge("source_id", "source_tag", F.col("source_start") + F.col("n_words") - width)
    return found.filter("linked").select(last.alias("a"), _edge("to_id", "to_tag", F.col("to_start")).alias("b")).distinct()


def outer_links(found: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """(a, b): a walk's first or last edge and the edge before or behind it of which the document is itself the source."""
    sources = runs.select(F.col("id").alias("doc_id"), "tag").distinct()
    mine = found.filter("NOT follows OR NOT linked").join(sources, ["doc_id", "tag"], "left_semi")
    n = F.col("n_words") - (width - 1)
    first, last = _edge("source_id", "source_tag", F.col("source_start")), _edge("source_id", "source_tag", F.col("source_start") + n - 1)
    before = F.when(~F.col("follows"), F.struct((F.col("start") - 1).alias("at"), first.alias("other"), F.lit(True).alias("leaves")))
    behind = F.when(~F.col("linked"), F.struct((F.col("start") + n).alias("at"), last.alias("other"), F.lit(False).alias("leaves")))
    asked = mine.select(F.col("doc_id").alias("id"), "tag", F.explode(F.array_compact(F.array(before, behind))).alias("s")).select("id", "tag", "s.*").distinct()
    marks = runs.select("id", "tag", "at", "upto", F.lit(None).cast(asked.schema["other"].dataType).alias("other"), F.lit(None).cast("boolean").alias("leaves"))
    along = Window.partitionBy("id", "tag").orderBy("at", F.col("leaves").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marks.unionByName(asked.withColumn("upto", F.lit(None).cast("long"))).withColumn("reach", F.max("upto").over(along)).filter("leaves IS NOT NULL AND at <= reach")
    own = F.struct("id", "tag", "at")
    return inside.select(F.when(F.col("leaves"), own).otherwise(F.col("other")).alias("a"), F.when(F.col("leaves"), F.col("other")).otherwise(own).alias("b")).distinct()


def graph(found: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, unbranched, glued) of the walks.

    segments: (id, tag, at, upto, path): edges at .. upto of a document without a branch between them, and the name
    of the nonbranching path that they lie on. unbranched: the links (a, b) within paths. glued: the same of links
    between walks, by the names that the walks give.
    """
    own = materialize(own_walks(found, width))
    runs = materialize(stretches(found, own, width))
    raw = materialize(walk_links(found, width).withColumn("walk", F.lit(True)).unionByName(outer_links(found, runs, width).withColumn("walk", F.lit(False))))
    names = materialize(first_names(raw.select(F.explode(F.array("a", "b")).alias("e")).select("e.*").distinct(), own))
    of = lambda c: names.select(F.col("raw").alias(c), F.col("edge").alias(f"first_{c}"))
    named = materialize(raw.join(of("a"), "a").join(of("b"), "b"))
    more = named.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).distinct()
    # a source's own next edge is a way out of the one before; others come from links, after which segments begin
    along = Window.partitionBy("id", "tag").orderBy("at")
    cuts = more.select(F.explode(F.array(F.struct("a.id", "a.tag", (F.col("a.at") + 1).alias("at")), F.struct("b.id", "b.tag", "b.at"))).alias("c")).select("c.*")
    marks = runs.unionByName(cuts.withColumn("upto", F.lit(None).cast("long"))).groupBy("id", "tag", "at").agg(F.max("upto").alias("upto"))
    marks = marks.withColumn("reach", F.max("upto").over(along)).withColumn("next", F.lead("at").over(along)).filter("at <= reach")
    upto = F.least(F.col("next") - 1, F.col("reach"))
    segments = materialize(marks.select(F.struct("id", "tag", "at").alias("head"), F.struct("id", "tag", upto.alias("at")).alias("tail"), (upto < F.col("reach")).alias("goes_on")))
    onward = segments.filter("goes_on").select(F.col("tail").alias("a"), F.struct("tail.id", "tail.tag", (F.col("tail.at") + 1).alias("at")).alias("b"))
    every = materialize(more.unionByName(onward).distinct())
    one_out = every.groupBy("a").agg(F.count(F.lit(1)).alias("ways")).filter("ways = 1").select("a")
    one_in = every.groupBy("b").agg(F.count(F.lit(1)).alias("ways")).filter("ways = 1").select("b")
    unbranched = materialize(every.filter("a <> b").join(one_out, "a").join(one_in, "b").select("a", "b"))
    paths = followed(segments, unbranched)
    glued = named.filter("walk").join(unbranched.select(F.col("a").alias("first_a"), F.col("b").alias("first_b")), ["first_a", "first_b"]).select("a", "b")
    return paths, unbranched, glued


def followed(segments: DataFrame, unbranched: DataFrame) -> DataFrame:
    """Segments with the first segment of their path: pointers to the segment before double until they reach it.

    On a circle no pointer ends; after as many rounds as any chain can take its segments take the smallest one.
    """
    heads = segments.select(F.col("tail").alias("a"), F.col("head").alias("up"))
    back = materialize(unbranched.join(heads, "a").select(F.col("b").alias("head"), "up", F.least("b", "up").alias("least"), F.lit(True).alias("moved")))
    for _ in range(back.count().bit_length() + 1):
        if back.filter("moved").isEmpty():
            break
        above = back.select(F.col("head").alias("up"), F.col("up").alias("higher"), F.col("least").alias("lower"))
        joined = back.drop("moved").join(above, "up", "left")
        further = materialize(joined.select("head", F.coalesce("higher", "up").alias("up"), F.least("least", F.coalesce("lower", "least")).alias("least"), F.col("higher").isNotNull().alias("moved")))
        discard(back)
        back = further
    first = back.select("head", F.when(F.col("moved"), F.col("least")).otherwise(F.col("up")).alias("first"))
    return segments.join(first, "head", "left").select("head.*", F.col("tail.at").alias("upto"), F.coalesce("first", "head").alias("path"))


def glued_walks(found: DataFrame, glued: DataFrame, width: int) -> DataFrame:
    """Walks with `glued`: whether the link to the next walk lies on a nonbranching path."""
    last = _edge("source_id", "source_tag", F.col("source_start") + F.col("n_words") - width)
    keyed = found.withColumn("a", F.when(F.col("linked"), last)).withColumn("b", F.when(F.col("linked"), _edge("to_id", "to_tag", F.col("to_start"))))
    marked = keyed.join(glued.withColumn("_glued", F.lit(True)), ["a", "b"], "left").withColumn("glued", F.coalesce("_glued", F.lit(False)))
    return marked.select("doc_bucket", "doc_id", "tag", "start", "n_words", "source_id", "source_start", "glued")


def span_digests(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tag, start, n_words, digest) for each wanted run of words."""

    def hashed(texts, runs):
        import hashlib

        import pyarrow as pa

        from qaspark.llm import blocks

        asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, t, s, n in zip(*(runs.column(c).to_pylist() for c in ("doc_id", "tag", "start", "n_words")), strict=True):
            asked.setdefault((i, t), []).append((s, n))
        out: list[tuple[int, int, int, int, bytes]] = []
        for i, t, text in blocks.documents_in(texts.column("docs").to_pylist()):
            if mine := asked.pop((i, t), None):
                words = text.split()
                out += [(i, t, s, n, hashlib.blake2b(b" ".join(words[s : s + n]), digest_size=16).digest()) for s, n in mine]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({c: pa.array(v, pa.binary() if c == "digest" else pa.int64()) for c, v in zip(("doc_id", "tag", "start", "n_words", "digest"), columns, strict=True)})

    return wanted.groupBy("doc_bucket").cogroup(packed.groupBy("doc_bucket")).applyInArrow(lambda runs, texts: hashed(texts, runs), "doc_id long, tag long, start long, n_words long, digest binary")


def unverified(packed: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """Spans whose words differ from their source's; none, unless hashes collide."""
    own = spans.select("doc_bucket", "doc_id", "tag", "start", "n_words")
    source = spans.select(doc_bucket("source_id", "source_tag", buckets).alias("doc_bucket"), F.col("source_id").alias("doc_id"), F.col("source_tag").alias("tag"), F.col("source_start").alias("start"), "n_words").distinct()
    digests = materialize(span_digests(packed, own.unionByName(source)).groupBy("doc_id", "tag", "start", "n_words").agg(F.first("digest").alias("digest")))
    of_source = digests.select(F.col("doc_id").alias("source_id"), F.col("tag").alias("source_tag"), F.col("start").alias("source_start"), "n_words", F.col("digest").alias("source_digest"))
    checked = spans.join(digests, ["doc_id", "tag", "start", "n_words"], "left").join(of_source, ["source_id", "source_tag", "source_start", "n_words"], "left")
    return checked.filter(~F.col("digest").eqNullSafe(F.col("source_digest")) | F.col("digest").isNull())


def verified_walks(named: DataFrame, packed: DataFrame, bits: int, buckets: int, width: int = WINDOW) -> DataFrame:
    """The walks of each document through edges of earlier ones, their words equal to their sources'."""
    for wide in (False, True):
        found = materialize(walks(settle(edges(named, width, bits, buckets, wide), buckets), width))
        if unverified(packed, found, buckets).isEmpty():
            return found
    raise RuntimeError("walks differ from their sources even by 128-bit hashes")


def repeated_paths(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, id, tag, at, n_edges): the segments of each nonbranching path of windows that several documents have,
    where they stand first, in edges from word `at` on; `path` is the name of its first edge."""
    workers_see_package(docs.sparkSession)
    total = text_bytes(docs, text_col)
    named = named_documents(docs, id_col, text_col)
    found = verified_walks(named, packed_documents(named, doc_buckets(total)), window_bits(total), doc_buckets(total), width)
    return graph(found, width)[0].select("path", "id", "tag", "at", (F.col("upto") - F.col("at") + 1).alias("n_edges"))


def remove_repeats(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_text, and its spans.

    spans: array of (start, n_words, source_id, source_start), in words: runs along nonbranching paths, with where
    their first window stands in its source.
    """
    workers_see_package(docs.sparkSession)
    total = text_bytes(docs, text_col)
    bits, buckets = window_bits(total), doc_buckets(total)
    named = named_documents(docs, id_col, text_col)
    packed = packed_documents(named, buckets)
    found = verified_walks(named, packed, bits, buckets, width)
    spans = glued_walks(found, graph(found, width)[2], width)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, n_words: long, source_id: long, source_start: long>>"

    def cut(texts, found):
        import pyarrow as pa

        from qaspark.llm import blocks

        at: dict[tuple[int, int], list[dict]] = {}
        for row in found.to_pylist():
            at.setdefault((row["doc_id"], row["tag"]), []).append(row)
        ids, counts, removed, kept, spans = [], [], [], [], []
        for i, t, text in blocks.documents_in(texts.column("docs").to_pylist()):
            words, mine, goes_on = text.split(), [], False
            for w in sorted(at.get((i, t), []), key=lambda w: w["start"]):
                if goes_on:
                    mine[-1]["n_words"] = w["start"] + w["n_words"] - mine[-1]["start"]
                else:
                    mine.append({c: w[c] for c in ("start", "n_words", "source_id", "source_start")})
                goes_on = w["glued"]
            left, last = [], 0
            for s in mine:
                left += words[last : s["start"]]
                last = max(last, s["start"] + s["n_words"])
            left += words[last:]
            ids.append(None if i == blocks.NULL_ID else i)
            counts.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
            spans.append(mine)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "n_words", "source_id", "source_start")]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)})

    return packed.groupBy("doc_bucket").cogroup(spans.groupBy("doc_bucket")).applyInArrow(cut, schema)


__all__ = ["NULL_ID", "WINDOW", "remove_repeats", "repeated_paths"]
