"""Packed blocks of numpy arrays as binary rows: what the operators on word windows shuffle.

A document is named by its id (null: the largest long) and a tag, a hash of its text where ids are not
unique and else 0. Documents live in doc buckets, the id modulo an odd number; packed documents of a
doc bucket meet what belongs to them in a co-group, texts compressed by zstd.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, mix, text_buffer

NULL_ID = (1 << 63) - 1
#: Bytes of text for each doc bucket and each window bucket, and for each slice that a worker hashes at once.
BUCKET_BYTES, SLICE_BYTES = 4 << 20, 5 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension, their bytes in planes, compressed where that helps."""
    import pyarrow as pa

    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes() if len(raw) else b""
        small = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        squeezed = len(small) < len(planes)
        body = small if squeezed else planes
        out.append(struct.pack("<3sBQQ", raw.dtype.str.encode(), squeezed, len(raw), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    out, at = [], 1
    for _ in range(data[0]):
        kind, squeezed, n, size = struct.unpack_from("<3sBQQ", data, at)
        at += 20
        dtype = np.dtype(kind.decode())
        body = data[at : at + size]
        at += size
        if squeezed:
            body = pa.decompress(body, n * dtype.itemsize, codec="zstd", asbytes=True)
        planes = np.frombuffer(body, np.uint8).reshape(dtype.itemsize, n) if n else np.zeros((dtype.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
    return out


def merged(blobs) -> list[np.ndarray]:
    """The arrays of many blocks, each joined in the blocks' order."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in the order given)."""
    order = np.argsort(bucket, kind="stable")
    starts = run_starts(bucket[order])
    for a, b in zip(starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def named_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text): the tag is 0 where no two rows share an id, else a hash of the text."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    twice = not ids.groupBy("doc_id").count().filter("count > 1").isEmpty()
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if twice else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text_col).alias("text"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def doc_buckets(total: int) -> int:
    """An odd number of buckets for so many bytes of text."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, total // BUCKET_BYTES)) | 1


def doc_places(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    """Doc buckets of documents: by id, those without one by tag, so that they do not all meet."""
    return (np.where(ids == NULL_ID, tags, ids) % buckets).astype(np.int32)


def doc_bucket(id_: str, tag: str, buckets: int) -> Column:
    """The same as a column."""
    return F.pmod(F.when(F.col(id_) == NULL_ID, F.col(tag)).otherwise(F.col(id_)), F.lit(buckets)).cast("int")


def window_bits(total: int) -> int:
    """Bits of a hash that name its bucket; from 8 on, so that few buckets fall on one task."""
    return max(8, min(16, (total // (2 * BUCKET_BYTES)).bit_length()))


def slices(batches, limit: int = SLICE_BYTES):
    """(ids, tags, data, offsets) of about `limit` bytes of text each, rows in order of id and tag."""
    ids, tags, texts, size = [], [], [], 0

    def made():
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [np.asarray(x) for x in (pa.chunked_array(ids).combine_chunks(), pa.chunked_array(tags).combine_chunks())]
        order = np.lexsort(names[::-1])
        column = pc.take(pa.chunked_array(texts).combine_chunks(), pa.array(order))
        return names[0][order], names[1][order], *text_buffer(column)

    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        ids.append(pc.fill_null(batch.column("doc_id"), NULL_ID))
        tags.append(batch.column("tag"))
        texts.append(text)
        size += pc.sum(pc.binary_length(text)).as_py() or 0
        if size >= limit:
            yield made()
            ids, tags, texts, size = [], [], [], 0
    if ids and sum(map(len, ids)):
        yield made()


def packed_documents(named: DataFrame, buckets: int) -> DataFrame:
    """(doc_bucket, docs): the documents of each doc bucket, in blocks."""

    def packed(batches):
        import pyarrow as pa

        from qaspark.llm import blocks

        for ids, tags, data, offsets in blocks.slices(batches):
            where, out = [], []
            for bucket, rows in blocks.by_bucket(blocks.doc_places(ids, tags, buckets)):
                sizes = offsets[rows + 1] - offsets[rows]
                text = b"".join([data[offsets[r] : offsets[r + 1]].tobytes() for r in rows.tolist()])
                where.append(bucket)
                out.append(blocks.pack(ids[rows], tags[rows], sizes, np.frombuffer(text, np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(out, pa.binary())], ["doc_bucket", "docs"])

    return in_batches(named, packed, "doc_bucket int, docs binary")


def documents_in(blobs) -> Iterator[tuple[int, int, bytes]]:
    """(id, tag, text) of packed documents."""
    for blob in blobs:
        ids, tags, sizes, text = unpack(blob)
        raw, at = text.tobytes(), 0
        for i, t, n in zip(ids.tolist(), tags.tolist(), sizes.tolist(), strict=True):
            yield i, t, raw[at : at + n]
            at += n


def spread(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64))
