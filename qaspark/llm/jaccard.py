"""Word-shingle Jaccard join by a count-vector R-tree.

A document's point has a coordinate for each group of hashed shingles: how many of its shingles fall into
the group. The overlap of two documents is at most the sum of their coordinate minima, so linked documents
differ by few counts.

1. Documents with one set of shingles are one node, named by 64 bits of a hash of the set; a second hash
   must agree, else an error is raised.
2. The tree's upper levels cut the coordinates into blocks of BLOCK_GROUPS. In a class of sizes there are more
   blocks than coordinates that linked points can differ in, so linked points have the same counts in one block
   at least. A block of a point is named by a hash of its counts, a sum over its coordinates, so equal counts
   have equal names; points with one name meet in a shuffle. Those that share a block (each node once) are
   searched breadth first: those whose bound of the overlap allows a link are connected by one candidate link
   each, never by a pair for any two. Components of candidates hold every pair that can be linked.
3. Within components, points are packed into leaves by size, small components many to a task. A tree of boxes
   bounds the overlap of a point and a box, then of two points; what survives is verified on the sets of
   shingle hashes (64 bits each). Pairs that links found before connect are passed over; no other pair is. Of a
   large component each leaf is verified by itself, together with a few points that all leaves get; most leaves
   are connected then, and only what is not is held against the other leaves. `links` and
   `join(..., count_links=True)` verify every pair of leaves.

Defined results. Null or empty text, or only white space: no shingles, linked with nothing, in a component of its own.
Fewer words than a shingle: the whole sequence is one. Null doc_id: larger than every other; the
component of nulls alone has a null id. Rows with one doc_id: each has its own result. Repeated rows: one
node. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NULL_ID, doc_bucket, doc_buckets, named_documents, packed_documents, text_bytes, window_bits
from .common import in_batches, materialize, trimmed, trimmed_batches
from .components import components, stars

SHINGLE, PERCENT = 4, 85
#: Coordinates of a point: one for SPARSE shingles, a power of two within these limits.
LEAST_GROUPS, MOST_GROUPS, SPARSE = 32, 1 << 14, 8
#: Points of a box, nodes of a leaf, rows of shared blocks that one task searches.
BOX, LEAF, SEARCHED = 32, 1024, 1 << 14
#: Points of a band of sizes that each leaf of a large component is verified with.
PIVOTS = 4
#: Bytes of text, and shingles, that are hashed at one time: what a worker holds besides its results follows from these.
PART_BYTES, PART_SHINGLES = 1 << 20, 1 << 17
#: Coordinates of one block.
BLOCK_GROUPS = 1 << 32
#: Ways to cut points into blocks that are tried before a document goes to the block of those without.
SEEDS = 4
_SALT = np.uint64(0xA0761D6478BD642F)


# ---- sets and points --------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row by row in ascending order, and the len+1 offsets of the rows."""
    parts = [_sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in row_slices(offsets, PART_BYTES)]
    if len(parts) < 2:
        return parts[0] if parts else _sets_of(data, offsets, shingle)
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    from .common import window_hashes, word_hashes, word_spans

    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    begin, end, first = word_spans(low, offsets)
    words = word_hashes(low, begin, end)
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero((np.arange(len(rows)) + shingle <= first[rows + 1])[: max(0, len(rows) - shingle + 1)])
    values, owner = [window_hashes(words, shingle)[at]], [rows[at]]
    for k in range(1, shingle):  # short rows: their whole sequence
        short = np.flatnonzero(count == k)
        if len(short):
            values.append(window_hashes(words, k)[first[short]] ^ np.uint64(k))
            owner.append(short)
    h, r = np.concatenate(values), np.concatenate(owner).astype(np.uint16 if len(count) < 1 << 16 else np.int64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(count) + 1))


def set_names(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set, as int64; 0 for the empty set."""
    from .common import mix

    out = []
    for x in (mix(h ^ _SALT), mix(h + _SALT)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        size = np.diff(first).astype(np.uint64)
        out.append(np.where(size > 0, mix(total[first[1:]] - total[first[:-1]] + size), 0).astype(np.uint64).view(np.int64))
    return out[0], out[1]


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Class c has the sizes from 2**c on, below 2**(c + 1)."""
    return np.frexp(sizes.astype(np.float64))[1] - 1


def most_apart(classes: np.ndarray, percent: int) -> np.ndarray:
    """How many counts linked documents can differ in, the smaller one being of the class."""
    largest = (1 << (classes.astype(np.int64) + 1)) - 1
    return largest * (100 - percent) // percent


def block_names(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of the blocks of each row's point that have any count.

    A row takes part in its own class of sizes and in that of its smallest possible partner. In class c,
    linked points differ in at most d blocks; if either has more than d blocks with counts, they share
    one. Rows that haven't are cut anew with the next seed; those that never have share a block by class.
    """
    parts = [(a, _blocks_of(h[first[a] : first[b]], first[a : b + 1] - first[a], percent)) for a, b in row_slices(first, PART_SHINGLES)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([rows + a for a, (rows, _) in parts]), np.concatenate([names for _, (_, names) in parts])


def _blocks_of(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)
    own = size_class(np.maximum(size, 1))
    least = size_class(np.maximum(-(-size * percent // 100), 1))
    rows, names = [], []
    for classes, use in ((own, size > 0), (least, (size > 0) & (least != own))):
        live = np.flatnonzero(use)
        for seed in range(SEEDS + 1):
            if not len(live):
                break
            if seed == SEEDS:
                rows.append(live)
                names.append(_named(classes[live], np.full(len(live), 1 << 40), np.zeros(len(live), np.uint64)))
                break
            row, block, counts, filled, apart = _cut(h, first, live, classes, seed, percent)
            rows.append(row)
            names.append(_named(classes[row], block + (seed << 32), counts))
            live = live[filled <= apart]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(names) if names else np.zeros(0, np.uint64)


def _named(classes: np.ndarray, block: np.ndarray, counts: np.ndarray) -> np.ndarray:
    from .common import mix

    return mix(counts + mix(classes.astype(np.uint64) << np.uint64(48) ^ block.astype(np.uint64)))


def _cut(h, first, live, classes, seed, percent):
    """Blocks with counts of the live rows: row, block, hash of counts; and for each live row how many, and d."""
    from .common import mix

    apart = most_apart(classes[live], percent)
    blocks = np.where(apart == 0, 1, (apart + 1) * 115 // 100 + 3)
    start = np.concatenate([[0], np.cumsum(blocks)])
    size = (first[1:] - first[:-1])[live]
    at = np.repeat(first[live] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    of = np.repeat(np.arange(len(live)), size)
    value = mix(h[at] + np.uint64((seed + 1) * int(_SALT) & (1 << 64) - 1))
    slot = start[of] + (value % blocks[of].astype(np.uint64)).astype(np.int64)
    group = value >> np.uint64(64 - (BLOCK_GROUPS - 1).bit_length())  # the block's coordinate that the shingle counts in
    counts = np.zeros(start[-1], np.uint64)
    np.add.at(counts, slot, mix(group ^ _SALT))  # the sum of count times hash of coordinate: a hash of the counts
    any_ = np.bincount(slot, minlength=start[-1]) > 0
    slots = np.flatnonzero(any_)
    owner = np.searchsorted(start, slots, "right") - 1
    return live[owner], slots - start[owner], counts[slots], np.bincount(owner, minlength=len(live)), apart


def groups_for(size: int) -> int:
    """How many coordinates the point of a set of so many shingles has."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (max(1, int(size) // SPARSE) - 1).bit_length()))


def point(h: np.ndarray, groups: int) -> np.ndarray:
    """A set's counts by group; with half the groups, the counts of two groups add up."""
    from .common import mix

    return np.bincount((mix(h) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Points (row by row) with fewer coordinates."""
    return counts.reshape(len(counts), -1, groups).sum(1)


# ---- the tree ---------------------------------------------------------------------------


class CountTree:
    """Points in boxes of BOX, in order of size; `near` bounds the overlap by summed coordinate minima."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.counts, self.sizes, self.percent = counts[self.order], sizes[self.order], percent
        starts = np.arange(0, len(sizes), BOX)
        self.starts, self.ends = starts, np.append(starts[1:], len(sizes))
        self.high = np.maximum.reduceat(self.counts, starts, axis=0)
        self.least, self.most = self.sizes[starts], self.sizes[self.ends - 1]

    def near(self, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that can be linked with this one, the largest bound first: their numbers and bounds."""
        p = self.percent
        boxes = np.flatnonzero((100 * self.most >= p * size) & (p * self.least <= 100 * size))
        if not len(boxes):
            return boxes, boxes
        bound = np.minimum(self.high[boxes], counts).sum(1)
        boxes = boxes[(100 + p) * np.minimum(bound, size) >= p * (size + np.maximum(self.least[boxes], -(-p * size // 100)))]
        if not len(boxes):
            return boxes, boxes
        at = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in boxes.tolist()])
        bound = np.minimum(self.counts[at], counts).sum(1)
        can = (100 + p) * bound >= p * (size + self.sizes[at])
        at, bound = at[can], bound[can]
        best = np.argsort(-bound, kind="stable")
        return self.order[at[best]], bound[best]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are at least `percent` alike."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int(np.count_nonzero(large[at] == small))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def forest(sets: list[np.ndarray], counts: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what any links connect. With two sides, only links between sides are looked at."""
    sizes = np.array([len(s) for s in sets])
    tree, label, out = CountTree(counts, sizes, percent), np.arange(len(sets)), []
    for i in range(len(sets)):
        found, _ = tree.near(counts[i], int(sizes[i]))
        found = found[found < i] if (sides == sides[0]).all() else found[sides[found] < sides[i]]
        found = found[label[found] != label[i]]
        while len(found):
            j = int(found[0])
            if linked(sets[i], sets[j], percent):
                out.append((i, j))
                label[label == label[j]] = label[i]
                found = found[label[found] != label[i]]
            else:
                found = found[1:]
    return out


def all_links(sets: list[np.ndarray], counts: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Every link. With two sides, only links between sides."""
    sizes = np.array([len(s) for s in sets])
    tree, out, one_side = CountTree(counts, sizes, percent), [], (sides == sides[0]).all()
    for i in range(len(sets)):
        found, _ = tree.near(counts[i], int(sizes[i]))
        found = found[found < i] if one_side else found[sides[found] < sides[i]]
        out += [(i, j) for j in found.tolist() if linked(sets[i], sets[j], percent)]
    return out


def can_link(counts: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sum of coordinate minima allows rows to be linked with other rows."""
    return (100 + percent) * np.minimum(counts, others).sum(-1) >= percent * (sizes + other_sizes)


def pairs_can_link(points: list[bytes], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """`can_link` for many pairs of rows, whose points are bytes; pairs of points of equal lengths at once."""
    out = (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
    lengths = np.array([len(p) // 2 for p in points], np.int64)
    for key in np.unique(lengths[a[out]] << 32 | lengths[b[out]]).tolist():
        n, m = key >> 32, key & 0xFFFFFFFF
        at = np.flatnonzero(out & (lengths[a] == n) & (lengths[b] == m))
        for k in np.array_split(at, len(at) * max(n, m) // (1 << 20) + 1):
            one, other = (np.frombuffer(b"".join([points[j] for j in x[k].tolist()]), "<u2").reshape(len(k), -1).astype(np.int32) for x in (a, b))
            out[k] = can_link(folded(one, min(n, m)), sizes[a[k]], folded(other, min(n, m)), sizes[b[k]], percent)
    return out


def reachable(counts: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Breadth first through the pairs whose bound allows a link: one pair for each row that is reached."""
    left, out = np.arange(len(sizes)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            fits = left[(100 * sizes[left] >= percent * sizes[i]) & (percent * sizes[left] <= 100 * sizes[i])]
            fits = fits[can_link(counts[fits], sizes[fits], counts[i], sizes[i], percent)] if len(fits) else fits
            if len(fits):
                out += [(i, j) for j in fits.tolist()]
                queue += fits.tolist()
                left = left[~np.isin(left, fits, assume_unique=True)]
    return out


# ---- Spark stages -----------------------------------------------------------------------


def classes_of(named: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tag, node, check, n, point) of each document; null ids as NULL_ID."""

    def measured(batches):
        import pyarrow as pa

        from qaspark.llm import blocks, jaccard

        for ids, tags, data, offsets in blocks.slices(batches):
            h, first = jaccard.shingle_sets(data, offsets, shingle)
            node, check = jaccard.set_names(h, first)
            size = np.diff(first).astype(np.int64)
            at = [jaccard.point(h[a:b], jaccard.groups_for(b - a)).astype("<u2").tobytes() if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, tags, node, check, size)), pa.array(at, pa.binary())], ["doc_id", "tag", "node", "check", "n", "point"])

    return in_batches(named, trimmed_batches(measured), "doc_id long, tag long, node long, check long, n long, point binary")


def shared_blocks(named: DataFrame, shingle: int, percent: int, bits: int) -> DataFrame:
    """(shared, node): the nodes of each block that several have; blocks of equal nodes once."""

    def cut(batches):
        import pyarrow as pa

        from qaspark.llm import blocks, jaccard

        for ids, tags, data, offsets in blocks.slices(batches):
            h, first = jaccard.shingle_sets(data, offsets, shingle)
            node, _ = jaccard.set_names(h, first)
            fresh = np.zeros(len(node), bool)
            fresh[np.unique(node, return_index=True)[1]] = True  # a set once for each slice
            h, first, node = jaccard.taken(h, first, node, fresh)
            rows, names = jaccard.block_names(h, first, percent)
            where, out = [], []
            for bucket, k in blocks.by_bucket((names >> np.uint64(64 - bits)).astype(np.uint16)):
                where.append(bucket)
                out.append(blocks.pack((names[k] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((names[k] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16), node[rows[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])

    def meet(table):
        import pyarrow as pa

        from qaspark.llm import blocks

        low, high, node = blocks.merged(table.column("block").to_pylist())
        name = high.astype(np.uint64) << np.uint64(32) | low
        order = np.lexsort((node, name))
        name, node = name[order], node[order]
        starts = blocks.run_starts(name)
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])  # a set comes from several slices
        name, node = name[new], node[new]
        starts = blocks.run_starts(name)
        size = np.diff(np.append(starts, len(name)))
        several = np.repeat(size > 1, size)
        node, size = node[several], size[size > 1]
        starts = np.cumsum(size) - size
        shared = np.add.reduceat(blocks.spread(node), starts) if len(starts) else np.zeros(0, np.uint64)
        _, once = np.unique(shared, return_index=True)
        keep = np.zeros(len(starts), bool)
        keep[once] = True
        return pa.table({"shared": pa.array(np.repeat(shared[keep].view(np.int64), size[keep])), "node": pa.array(node[np.repeat(keep, size)])})

    return in_batches(named, trimmed_batches(cut), "bucket int, block binary").groupBy("bucket").applyInArrow(trimmed(meet), "shared long, node long").distinct()


def candidate_links(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): what connects all nodes of a shared block that can be linked, as stars."""
    shared = materialize(shared)
    tasks = max(64, shared.count() // SEARCHED) | 1

    def searched(table):
        import pyarrow as pa

        from qaspark.llm import blocks, jaccard

        name, node, size = (np.asarray(table.column(c).combine_chunks()) for c in ("shared", "node", "n"))
        point = table.column("point").to_pylist()
        order = np.lexsort((node, name))
        starts = blocks.run_starts(name[order])
        length = np.diff(np.append(starts, len(order)))
        one, other = order[starts[length == 2]], order[starts[length == 2] + 1]
        out = [np.stack([node[one], node[other]], 1)[jaccard.pairs_can_link(point, size, one, other, percent)]]
        for a, n in zip(starts[length > 2].tolist(), length[length > 2].tolist(), strict=True):
            k = order[a : a + n]
            rows = [np.frombuffer(point[j], "<u2").astype(np.int32) for j in k.tolist()]
            groups = min(map(len, rows))
            counts = np.concatenate([jaccard.folded(r[None], groups) for r in rows])
            found = np.array(jaccard.reachable(counts, size[k], percent), np.int64).reshape(-1, 2)
            out.append(node[k[found]])
        pairs = stars(np.concatenate(out))  # tasks that see the same component send the same pairs
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    dealt = shared.join(nodes.select("node", "n", "point"), "node").withColumn("task", F.pmod(F.xxhash64("shared"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(trimmed(searched), "a long, b long").distinct()


def taken(h: np.ndarray, first: np.ndarray, node: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that are kept."""
    size = np.diff(first)
    return h[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), node[keep]


PLACED = ("doc_bucket", "doc_id", "tag", "node", "component", "unit", "side")


def in_leaves(placed: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with `chunk`: which leaf of their group (component, band and what else `by` has) they are in."""
    chunks = materialize(placed.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("chunks")))
    return placed.join(chunks, by).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def leaf_pairs(some: DataFrame, every: DataFrame) -> DataFrame:
    """Units that hold a leaf of `some` (side 0) against a leaf of `every` (side 1) of its size band or the next
    one up or down; linked sizes are at most one band apart. A leaf meets itself on one side.
    """
    mine = some.select("component", "band", "chunk").distinct()
    theirs = every.select("component", F.col("band").alias("band2"), F.col("chunk").alias("chunk2")).distinct()
    near = mine.withColumn("band2", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(theirs, ["component", "band2"])
    near = near.withColumn("unit", F.concat_ws("_", "component", "band", "chunk", "band2", "chunk2"))
    return near


def with_units(nodes: DataFrame, leaves: DataFrame, prefix: str, side: int) -> DataFrame:
    """The nodes of each unit's leaf, as `verified_links` takes them."""
    return nodes.join(leaves, ["component", "band", "chunk"]).withColumn("unit", F.concat(F.lit(prefix), F.col("unit"))).withColumn("side", F.lit(side)).select(*PLACED)


def banded(candidates: DataFrame, nodes: DataFrame, percent: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of components of up to LEAF nodes, and those of larger ones, with size band and doc bucket."""
    band = F.floor(F.log(F.col("n").cast("double")) / (float(np.log(100 / percent)) + 1e-9)).cast("int")
    placed = materialize(candidates.join(nodes, "node").withColumn("band", band).withColumn("doc_bucket", doc_bucket("doc_id", "tag", buckets)))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    few = sizes.filter(F.col("size") <= LEAF).select("component")
    return placed.join(few, "component", "left_semi"), materialize(placed.join(few, "component", "left_anti"))


def small_units(small: DataFrame) -> DataFrame:
    """Whole components, many to a unit."""
    bins = max(16, small.count() // (LEAF // 2)) | 1
    return small.withColumn("unit", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bins)))).withColumn("side", F.lit(0)).select(*PLACED)


def every_unit(large: DataFrame) -> DataFrame:
    """Each leaf against each leaf of its band and the next one, and against itself."""
    leaved = materialize(in_leaves(large, ["component", "band"]))
    pairs = leaf_pairs(leaved, leaved).filter("band < band2 OR band = band2 AND chunk <= chunk2")
    other = pairs.filter("band <> band2 OR chunk <> chunk2").select("component", F.col("band2").alias("band"), F.col("chunk2").alias("chunk"), "unit")
    return with_units(leaved, pairs.select("component", "band", "chunk", "unit"), "l", 0).unionByName(with_units(leaved, other, "l", 1))


def first_units(large: DataFrame) -> DataFrame:
    """Each leaf with the PIVOTS first points of its band and of the next ones: what most of a component is like."""
    leaved = materialize(in_leaves(large, ["component", "band"]))
    own = leaved.select("component", "band", "chunk").distinct().withColumn("unit", F.concat_ws("_", "component", "band", "chunk"))
    rank = F.row_number().over(Window.partitionBy("component", "band").orderBy("node"))
    heads = leaved.groupBy("component", "band", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(64)).alias("part")).agg(F.min("node").alias("node"))  # 64 rows of a band at most
    heads = heads.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("node")
    pivots = leaved.join(heads, "node", "left_semi")
    near = own.withColumn("to", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).select("component", F.col("to").alias("band"), "unit")
    guests = pivots.join(near, ["component", "band"]).withColumn("unit", F.concat(F.lit("f"), "unit")).withColumn("side", F.lit(0)).select(*PLACED)
    return with_units(leaved, own, "f", 0).unionByName(guests).distinct()


def rest_units(large: DataFrame, found: DataFrame) -> DataFrame:
    """Of a large component what no link connects with its largest part yet, against all its leaves."""
    labels = components(found).select("node", "label")
    parts = materialize(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = parts.groupBy("component", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("label"))
    rest = in_leaves(parts.join(main, ["component", "label"], "left_anti").drop("label"), ["component", "band"])
    rest, leaved = materialize(rest), materialize(in_leaves(large, ["component", "band"]))
    pairs = materialize(leaf_pairs(rest, leaved))
    other = pairs.select("component", F.col("band2").alias("band"), F.col("chunk2").alias("chunk"), "unit")
    return with_units(rest, pairs.select("component", "band", "chunk", "unit"), "r", 0).unionByName(with_units(leaved, other, "r", 1))


def verified_links(packed: DataFrame, placed: DataFrame, shingle: int, percent: int, every: bool = False) -> DataFrame:
    """(a, b): what connects the nodes of each component as all links do, as stars; or every link of two nodes, once."""

    def sent(texts, wanted):
        import pyarrow as pa

        from qaspark.llm import blocks

        at: dict[tuple[int, int], list[tuple]] = {}
        for i, t, *row in zip(*(wanted.column(c).to_pylist() for c in ("doc_id", "tag", "node", "component", "unit", "side")), strict=True):
            at.setdefault((i, t), []).append(tuple(row))
        by_unit: dict[str, list[tuple[int, int, int, bytes]]] = {}
        for i, t, text in blocks.documents_in(texts.column("docs").to_pylist()):
            for node, component, unit, side in at.pop((i, t), []):
                by_unit.setdefault(unit, []).append((node, component, side, text))
        out = []
        for rows in by_unit.values():
            node, component, side, text = zip(*rows, strict=True)
            out.append(blocks.pack(np.array(node), np.array(component), np.array(side, np.int32), np.array([len(x) for x in text]), np.frombuffer(b"".join(text), np.uint8)))
        return pa.table({"unit": pa.array(list(by_unit), pa.string()), "block": pa.array(out, pa.binary())})

    def resolved(table):
        import pyarrow as pa

        from qaspark.llm import blocks, jaccard

        node, component, side, size, data = blocks.merged(table.column("block").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(size)])
        parts = [jaccard.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in jaccard.row_slices(offsets)]
        sets = [h[s:e] for h, first in parts for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        out = []
        for _, k in blocks.by_bucket(np.unique(component, return_inverse=True)[1]):
            mine = [sets[j] for j in k.tolist()]
            groups = jaccard.groups_for(max(map(len, mine)))
            counts = np.stack([jaccard.point(x, groups) for x in mine])
            found = (jaccard.all_links if every else jaccard.forest)(mine, counts, side[k], percent)
            out += [(int(node[k[i]]), int(node[k[j]])) for i, j in found]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        pairs = pairs if every else stars(pairs)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    def dealt(wanted, texts):
        return trimmed(lambda t: sent(t, wanted))(texts)

    blocks_ = placed.groupBy("doc_bucket").cogroup(packed.groupBy("doc_bucket")).applyInArrow(dealt, "unit string, block binary")
    return blocks_.groupBy("unit").applyInArrow(trimmed(resolved), "a long, b long")


def linked_nodes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as `classes_of` has them; (node, doc_id, tag, n), each node's first document; the links (a, b) of nodes."""
    total = text_bytes(docs, text_col)
    bits, buckets = window_bits(total), doc_buckets(total)
    named = named_documents(docs, id_col, text_col)
    measured = materialize(classes_of(named, shingle))
    nodes = materialize(measured.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.max("n").alias("n"), F.first("point").alias("point"), (F.min("check") != F.max("check")).alias("clash")))
    if not nodes.filter("clash").isEmpty():
        raise RuntimeError("two sets of shingles have one 64-bit name")
    nodes = nodes.select("node", "first.doc_id", "first.tag", "n", "point")
    found = candidate_links(shared_blocks(named, shingle, percent, bits), nodes, percent)
    nodes = nodes.drop("point")
    candidates = components(found).select("node", F.col("label").alias("component"))
    small, large = banded(candidates, nodes, percent, buckets)
    packed = packed_documents(named, buckets)
    placed = materialize(small_units(small).unionByName(every_unit(large) if every else first_units(large)))
    found = materialize(verified_links(packed, placed, shingle, percent, every))
    if not every and not large.isEmpty():
        placed = materialize(rest_units(large, found))
        if not placed.isEmpty():
            wanted = placed.select("doc_id", "tag").distinct()
            named = named.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))).join(wanted, ["doc_id", "tag"], "left_semi")
            found = found.unionByName(materialize(verified_links(packed_documents(named, buckets), placed, shingle, percent)))
    return measured, nodes, found


def links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, tag_a, doc_b, tag_b): every link of two different sets of shingles, once.

    A set stands for all documents that have it, by the smallest (doc_id, tag) of them; doc_a is the smaller one.
    """
    _, nodes, found = linked_nodes(docs, shingle, percent, id_col, text_col, True)
    one, other = (nodes.select(F.col("node").alias(c), F.struct("doc_id", "tag").alias(f"of_{c}")) for c in "ab")
    both = found.join(one, "a").join(other, "b").select(F.array_sort(F.array("of_a", "of_b")).alias("p"))
    ends = [F.col("p")[k][c].alias(f"{name}_{'ab'[k]}") for k in (0, 1) for c, name in (("doc_id", "doc"), ("tag", "tag"))]
    return both.select(*ends).select(*(F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) if c[0] == "d" else c for c in ("doc_a", "tag_a", "doc_b", "tag_b")))


def link_counts(measured: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n_links): how many other documents a document of the node is linked with, those of its own node among them."""
    copies = materialize(measured.filter("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies")))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = found.select(F.explode(ends).alias("e")).select("e.*")
    others = both.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("others"))
    return copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, is_first): one row for each document.

    component_id: the smallest doc_id that links reach; is_first: whether this row is the one of its
    component to keep (smallest doc_id, then smallest tag; equal rows are alike). count_links adds n_links:
    how many other documents are linked with this one, every row counting; 0 without shingles.
    """
    measured, nodes, found = linked_nodes(docs, shingle, percent, id_col, text_col, count_links)
    labels = components(found)
    joined = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = joined.groupBy("label").agg(F.min(F.struct("doc_id", "tag")).alias("least"))
    of_node = joined.join(smallest, "label").select("node", "least")
    out = measured.join(of_node, "node", "left")
    own = F.struct("doc_id", "tag")
    least = F.coalesce(F.when(F.col("n") > 0, F.col("least")), own)
    clean = lambda c: F.when(c != NULL_ID, c)
    if count_links:
        out = out.join(link_counts(measured, found), "node", "left")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select(clean(F.col("doc_id")).alias("doc_id"), "tag", F.col("n").alias("n_shingles"), clean(least["doc_id"]).alias("component_id"), (least == own).alias("is_first"), *more)


def row_slices(offsets: np.ndarray, limit: int = 4 << 20):
    from .common import row_slices as made

    return made(offsets, limit)


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one document of each component: that of the smallest doc_id (and tag)."""
    first = join(docs, shingle, percent, id_col, text_col).filter("is_first").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    twice = not ids.groupBy("_id").count().filter("count > 1").isEmpty()
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if twice else F.lit(0).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    if twice:  # equal rows are one document
        kept = kept.dropDuplicates(["doc_id", "tag"])
    return kept.select("row.*")
