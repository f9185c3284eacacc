"""Exact overlap of character n-gram sets: leaks into a benchmark, near-duplicates, greedy keep-first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.answers import grams
from qaspark.llm.common import in_batches, mix
from qaspark.operators.lineage import cut, spread

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def gram_sets(rows: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(id, grams): the hashes of the distinct grams of each row."""
    return rows.select(F.col(key).alias("id"), F.transform(grams(F.col(text), n), lambda g: F.xxhash64(g)).alias("grams"))


def contained(candidates: DataFrame, corpus: DataFrame, key: str, corpus_key: str, text: str, least: float, n: int = 4) -> DataFrame:
    """(a, b, containment): corpus texts of whose grams a candidate has at least the share `least`, which is over 0.

    Who has so large a share lacks `miss` grams at most, so of the 2 * miss + 1 that are rarest in the corpus it has
    over half. Only these are joined and counted; the pairs with enough of them are compared on whole sets.
    """
    items = cut(gram_sets(spread(corpus.select(corpus_key, text)), corpus_key, text, n).withColumn("size", F.size("grams")).filter("size > 0").withColumn("miss", F.floor(F.col("size") * F.lit(1 - least) + F.lit(1e-9)).cast("int")))
    each = items.select("id", "size", "miss", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    rarest = each.join(often, "gram").groupBy("id", "size", "miss").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))  # an item's grams
    many = F.least(2 * F.col("miss") + 1, F.col("size"))
    probes = rarest.select(F.col("id").alias("b"), (many - F.col("miss")).alias("need"), F.explode(F.slice("g", 1, many)).alias("g")).select("b", "need", "g.gram")
    probes = cut(probes)  # a table of known size: a small one is broadcast, so that candidates' grams stay where they are
    texts = spread(candidates.select(key, text))
    sets = gram_sets(texts, key, text, n)
    # outer: else a filter on the grams, which would make them a second time, goes below
    found = sets.select(F.col("id").alias("a"), F.explode_outer("grams").alias("gram")).join(probes, "gram").groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("hits"))
    found = cut(found.filter("hits >= need").select("a", "b"))  # an id that comes twice has hits of both
    # only texts with enough hits are read a second time
    some = gram_sets(texts.join(found.select(F.col("a").alias(key)).distinct(), key, "left_semi"), key, text, n)
    pairs = found.join(some.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a").join(items.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    share = F.size(F.array_intersect("grams_a", "grams_b")) / F.size("grams_b").cast("double")
    return pairs.select("a", "b", share.alias("containment")).filter(F.col("containment") >= least)


def classes(rows: DataFrame, key: str, text: str, n: int = 4, fits=None) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): rows of equal gram sets form a class named by its smallest id.

    members is (id, class); representatives (id, grams), hashes of the distinct grams. Texts without grams are
    classes of their own in neither: they are like nothing. `fits` may choose sets by the column `grams`. Sets are
    equal if their sizes and two 64-bit hashes are.
    """
    # filters on the grams would be pushed below and make them a second time: one is on the text, others, those of
    # `fits`, stay above a generator
    some = spread(rows.select(key, text).filter(F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")))
    made = F.sort_array(F.transform(grams(F.col(text), n), lambda g: F.xxhash64(g)))
    sets = some.select(F.col(key).alias("id"), F.explode_outer(F.array(made)).alias("grams"))
    sets = cut(sets) if fits is None else cut(fits(sets))
    named = sets.withColumn("name", F.struct(F.size("grams").alias("size"), F.xxhash64("grams").alias("one"), F.xxhash64(F.lit(7), "grams").alias("other")))
    least = cut(named.groupBy("name").agg(F.min("id").alias("class")))
    members = named.select("id", "name").join(least, "name").select("id", "class")
    # the smallest id may repeat, with this set or another: one row of each name
    return members, named.join(least, "name").filter("id = class").dropDuplicates(["name"]).select("id", "grams")


def _prefixes(sets: DataFrame, common: DataFrame, least: float, side: str) -> DataFrame:
    """The rarest grams of each set, so many that two sets of Jaccard `least` must share one."""
    ranked = sets.select("id", F.explode("grams").alias("gram"), F.size("grams").alias("size")).join(common, "gram")
    ranked = ranked.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    return ranked.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.posexplode(F.slice("g", 1, keep)).alias(f"at_{side}", "r")).select(side, f"size_{side}", f"at_{side}", F.col("r.gram").alias("gram"))


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of pairs of sets (id, grams) at least so alike; with `right` the same frame, pairs a < b.

    Candidates share one of their rarest grams, fit in size and can still overlap enough by where their shared
    grams stand; a second join verifies each on whole sets.
    """
    itself = left is right
    every = left.select(F.explode("grams").alias("gram"))
    if not itself:
        every = every.unionByName(right.select(F.explode("grams").alias("gram")))
    common = every.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    common = cut(common)
    a = cut(_prefixes(left, common, least, "a"))
    b = a.withColumnsRenamed({"a": "b", "size_a": "size_b", "at_a": "at_b"}) if itself else cut(_prefixes(right, common, least, "b"))
    fits = (F.col("size_a") >= F.col("size_b") * least - 1e-9) & (F.col("size_b") >= F.col("size_a") * least - 1e-9)
    found = a.join(b, "gram").filter(fits & (F.col("a") < F.col("b")) if itself else fits)
    # grams up to the last shared one are all counted, so the overlap is at most these and what is left behind it
    rest = F.least(F.col("size_a") - F.max("at_a"), F.col("size_b") - F.max("at_b")) - 1
    found = found.groupBy("a", "b", "size_a", "size_b").agg((F.count(F.lit(1)) + rest).alias("most"))
    found = found.filter(F.col("most") * (1 + least) >= least * (F.col("size_a") + F.col("size_b")) - 1e-9).select("a", "b")
    whole = lambda t, side: t.select(F.col("id").alias(side), F.col("grams").alias(f"grams_{side}"))
    pairs = found.join(whole(left, "a"), "a").join(whole(right, "b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    share = shared / (F.size("grams_a") + F.size("grams_b") - shared).cast("double")
    return pairs.select("a", "b", share.alias("jaccard")).filter(F.col("jaccard") >= least)


def leaks(candidates: DataFrame, corpus: DataFrame, key: str, corpus_key: str, text: str, least: float = 0.6) -> DataFrame:
    """(key, of, jaccard): candidates like a corpus text, with the likest one, the smallest id on a tie."""
    _, theirs = classes(corpus, corpus_key, text)
    # alike sets differ little in size, and a text has at most as many grams as characters: most texts go early
    bounds = theirs.agg(F.min(F.size("grams")).alias("low"), F.max(F.size("grams")).alias("high"))
    within = lambda size: (size >= F.col("low") * least - 1e-9) & (size * least <= F.col("high") + 1e-9)
    one_row = lambda sets: sets.join(F.broadcast(bounds), F.lit(True)).filter(within(F.size("grams"))).select("id", "grams")
    long = spread(candidates.select(key, text)).join(F.broadcast(bounds), F.char_length(F.col(text)) >= F.col("low") * least - 1e-9).drop("low", "high")
    members, mine = classes(long, key, text, fits=one_row)
    mine = cut(mine)
    best = alike(mine, theirs, least).groupBy("a").agg(F.min_by("b", F.struct(-F.col("jaccard"), "b")).alias("of"), F.max("jaccard").alias("jaccard"))
    return members.join(best, members["class"] == best["a"]).select(F.col("id").alias(key), "of", "jaccard")


#: Grams of a leaf, the nodes that one task compares with those of another leaf; pairs compared at once.
LEAF_GRAMS, AT_ONCE = 1 << 22, 1 << 18


def set_of(text: str, n: int) -> np.ndarray:
    """Ascending hashes (64 bits) of the distinct grams of a text whose white space is made single and trimmed."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    width = min(n, len(points))  # a shorter text is one gram
    hashes = np.full(len(points) - width + 1 if width else 0, width, np.uint64)
    for k in range(width):
        hashes = mix(hashes * _FACTOR + points[k : len(points) - width + 1 + k] + np.uint64(1))
    hashes.sort()
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: a power of two from half the size on, 64 at least."""
    return max(64, 1 << max(0, (int(size) + 1) // 2 - 1).bit_length())


def sketch(grams: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the grams of each bit: two sketches differ in at most as many bits as their sets in grams."""
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (row by row) of fewer words, a power of two."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def apart_at_most(sizes, others, least: float):
    """In how many grams sets of these sizes that are `least` alike can differ."""
    return (1 - least) / (1 + least) * (sizes + others) + 1e-6


def close(sizes: np.ndarray, sketches: np.ndarray, others: np.ndarray, other_sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs whose sizes and sketches allow their sets to be `least` alike."""
    words = min(sketches.shape[1], other_sketches.shape[1])
    mine, theirs = folded(sketches, words), folded(other_sketches, words)
    order = np.argsort(others, kind="stable")
    up, columns = others[order].astype(np.float64), np.ascontiguousarray(theirs[order].T)
    rows = np.argsort(sizes, kind="stable")
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = 0
    while at < len(rows):
        few = rows[at : at + 64]
        low = int(np.searchsorted(up, sizes[few[0]] * least - 1e-6))
        high = int(np.searchsorted(up, sizes[few[-1]] / least + 1e-6, "right"))
        at += len(few)
        for start in range(low, high, AT_ONCE // 64):
            end = min(start + AT_ONCE // 64, high)
            differ = np.zeros((len(few), end - start), np.uint16)
            for w in range(words):
                differ += np.bitwise_count(mine[few, w][:, None] ^ columns[w, start:end])
            i, j = np.nonzero(differ <= apart_at_most(sizes[few].astype(np.float64)[:, None], up[start:end], least))
            out.append((few[i], order[start + j]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def measured(rows: DataFrame, key: str, text: str, n: int, least: float) -> DataFrame:
    """(id, body, node, other, size, band, sketch) of each text with grams: a hash of the text, two of its set, its class of sizes."""

    def made(batches):
        import pyarrow as pa

        from qaspark.operators import similarity as D

        names = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("size", pa.int64()), ("band", pa.int32()), ("sketch", pa.binary())])
        for batch in batches:
            out = []
            for t in batch.column("t").to_pylist():
                grams = D.set_of(t, n)
                one, other = (D.mix(D.mix(grams ^ salt).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))) for salt in D._SALTS)
                band = D.band_of(len(grams), base)
                out.append((int(one.view(np.int64)[0]), int(other.view(np.int64)[0]), len(grams), band, D.sketch(grams, D.sketch_bits(base**-band)).tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            more = [pa.array(list(c), f.type) for c, f in zip(columns, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), *more], names=["id", "body", *names.names])

    base = min(least, 0.99)
    some = spread(rows.select(key, text).filter(F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")))
    some = some.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), single_spaced(F.col(text)).alias("t"))
    kind = some.schema["id"].dataType.simpleString()
    return in_batches(some, made, f"id {kind}, body long, node long, other long, size long, band int, sketch binary")


def band_of(size: int, least: float) -> int:
    """The class of sizes: those from least ** -band on. Alike sets are at most one class apart."""
    return int(np.floor(np.log(size) / -np.log(least) + 1e-9)) if size > 1 else 0


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def close_nodes(nodes: DataFrame, least: float) -> DataFrame:
    """(unit, pairs, members): for each two leaves the pairs of nodes that their sketches leave, packed, and their nodes.

    Nodes fall into classes of sizes and these into leaves by a hash; each leaf meets each leaf of its class and the next.
    """
    leaves = nodes.groupBy("band").agg(F.ceil(F.sum("size") / LEAF_GRAMS).cast("int").alias("leaves"))
    leaves = cut(leaves)
    placed = nodes.join(leaves, "band").withColumn("leaf", F.pmod(F.xxhash64("node", F.lit(3)), F.col("leaves")).cast("int"))

    def packed(table):
        import pyarrow as pa

        from qaspark.llm import blocks

        node, size = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "size"))
        block = blocks.pack(node, size, np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8"))
        return pa.table({"band": table.column("band")[:1], "leaf": table.column("leaf")[:1], "block": pa.array([block], pa.binary())})

    packs = cut(placed.select("band", "leaf", "node", "size", "sketch").groupBy("band", "leaf").applyInArrow(packed, "band int, leaf int, block binary"))
    names = packs.select("band", "leaf")
    near = names.withColumn("band2", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(names.select(F.col("band").alias("band2"), F.col("leaf").alias("leaf2")), "band2")
    near = cut(near.filter("band < band2 OR leaf <= leaf2").withColumn("unit", F.concat_ws("_", "band", "leaf", "band2", "leaf2")))
    units = near.join(packs, ["band", "leaf"]).join(packs.withColumnsRenamed({"band": "band2", "leaf": "leaf2", "block": "block2"}), ["band2", "leaf2"])

    def compared(batches):
        import pyarrow as pa

        from qaspark.llm import blocks
        from qaspark.operators import similarity as D

        for batch in batches:
            for unit, one, two in zip(*(batch.column(c).to_pylist() for c in ("unit", "block", "block2")), strict=True):
                (a, sizes, x), (b, others, y) = blocks.unpack(one), blocks.unpack(two)
                i, j = D.close(sizes, x.reshape(len(a), -1), others, y.reshape(len(b), -1), least)
                once = a[i] < b[j] if one == two else np.ones(len(i), bool)  # a leaf with itself: each pair comes from both ends
                i, j = i[once], j[once]
                if len(i):
                    members = pa.array([np.unique(np.concatenate([a[i], b[j]])).tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([blocks.pack(a[i], b[j])], pa.binary()), members], ["unit", "pairs", "members"])

    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, near.count() // 4)
    return in_batches(units.select("unit", "block", "block2").repartition(tasks, "unit"), compared, "unit string, pairs binary, members array<long>", 4)


def near_pairs(rows: DataFrame, key: str, text: str, least: float, n: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, representatives, pairs): classes of equal gram sets as `classes` has them, (id) of each, (a, b) of alike ones.

    No gram is shuffled or written: sketches of the sets are compared, each with all of fitting size, and only texts of
    pairs that these leave meet and are compared on whole sets.
    """
    every = cut(measured(rows, key, text, n, least))
    first = F.min(F.struct("id", "body")).alias("first")
    nodes = every.groupBy("node").agg(first, F.first("size").alias("size"), F.first("band").alias("band"), F.first("sketch").alias("sketch"), (F.min(F.struct("size", "other")) != F.max(F.struct("size", "other"))).alias("clash"))
    nodes = cut(nodes)
    if not nodes.filter("clash").isEmpty():
        raise RuntimeError("two sets of grams have one 64-bit name")
    found = cut(close_nodes(nodes.select("node", "size", "band", "sketch"), least))
    names = nodes.select("node", "first.id", "first.body")
    wanted = found.select("unit", F.explode("members").alias("node")).join(names, "node")
    wanted = cut(wanted)
    texts = rows.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("t"))
    some = wanted.select(F.col("id").alias("id_"), F.col("body").alias("body_")).distinct()
    texts = texts.join(some, F.col("id").eqNullSafe(F.col("id_")) & (F.col("body") == F.col("body_"))).drop("id_", "body_")
    sent = wanted.withColumnsRenamed({"id": "id_", "body": "body_"}).join(texts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("body") == F.col("body_")))

    def resolved(texts, pairs):
        import pyarrow as pa

        from qaspark.llm import blocks
        from qaspark.operators import similarity as D

        sets = {node: D.set_of(t, n) for node, t in zip(texts.column("node").to_pylist(), texts.column("t").to_pylist(), strict=True)}
        a, b = blocks.merged(pairs.column("pairs").to_pylist())
        alike = np.zeros(len(a), bool)
        for k, (one, two) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = sets[one], sets[two]
            shared = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
            alike[k] = shared / (len(x) + len(y) - shared) >= least
        return pa.table({"one": pa.array(a[alike]), "two": pa.array(b[alike])})

    sent = sent.select("unit", "node", single_spaced(F.col("t")).alias("t"))
    pairs = sent.groupBy("unit").cogroup(found.select("unit", "pairs").groupBy("unit")).applyInArrow(resolved, "one long, two long")
    of = lambda end, side: names.select(F.col("node").alias(end), F.col("id").alias(side))
    pairs = cut(pairs).join(of("one", "a"), "one").join(of("two", "b"), "two").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return every.select("id", "node").join(names.select("node", F.col("id").alias("class")), "node").select("id", "class"), names.select("id"), pairs


def deduplicated(rows: DataFrame, key: str, text: str, least: float = 0.85) -> DataFrame:
    """(key, class, kept): in order of the key a row goes if it is so like a smaller one that stays.

    Copies go with their class, which its smallest id stands for; texts without grams stay.
    """
    members, sets, pairs = near_pairs(rows, key, text, least)
    kept = greedy_kept(sets, pairs, "id").withColumn("kept", F.lit(True))
    out = rows.select(F.col(key).alias("id")).distinct().join(members.distinct(), "id", "left").join(kept, "id", "left")
    stays = F.col("class").isNull() | ((F.col("class") == F.col("id")) & F.coalesce("kept", F.lit(False)))
    return out.select(F.col("id").alias(key), F.coalesce("class", "id").alias("class"), stays.alias("kept"))


def greedy_kept(rows: DataFrame, pairs: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Rows that stay if each row goes that is paired with a smaller row that stays: a fixpoint over the pairs."""
    earlier = pairs.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high").distinct()
    earlier = cut(earlier)
    state = rows.select(F.col(key).alias("id")).withColumn("kept", F.lit(None).cast("boolean"))
    state = state.join(earlier.select(F.col("high").alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left")
    state = cut(state.select("id", F.when(F.col("has").isNull(), True).alias("kept")))
    while not state.filter("kept IS NULL").isEmpty():
        below = earlier.join(state.withColumnRenamed("id", "low"), "low").groupBy("high").agg(F.bool_or("kept").alias("any_kept"), F.count_if(F.col("kept").isNull()).alias("open"))
        ruled = state.join(below.withColumnRenamed("high", "id"), "id", "left")
        decided = F.when(F.col("any_kept"), False).when(F.col("open") == 0, True)
        state = cut(ruled.select("id", F.coalesce("kept", decided).alias("kept")))
    return state.filter("kept").select(F.col("id").alias(key))
