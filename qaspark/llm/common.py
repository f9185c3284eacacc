"""Shared helpers: scratch tables, word hashing on numpy buffers, Python path of the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]+"

ROOT = str(Path(__file__).resolve().parents[2])


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder in the shared folder of `spark.checkpoint.dir`, deleted when the driver ends.

    Where that is unset a machine-local folder is set, on a local master only: executors of a cluster would each
    write to a disk of their own, so there it is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="qaspark-"))
        path = context._jsc.sc().getCheckpointDir().get()
    path = f"{path.rstrip('/')}/qaspark-{context.applicationId}"
    if path not in _SWEPT:
        _SWEPT.add(path)
        _file_system(spark, path).deleteOnExit(context._jvm.org.apache.hadoop.fs.Path(path))
    return path


_SWEPT: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    return context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends, executors may go."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` gave; nothing that is still to run may read them."""
    for table in tables:
        spark, path = table.sparkSession, table.scratch_path
        _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed (a cluster gets it by --py-files)."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def no_clash(df: DataFrame, added: tuple[str, ...]) -> None:
    """Raise if `df` has a column that is to be added."""
    if there := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"columns {sorted(there)} are there already")


def in_batches(df: DataFrame, function, schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over batches of at most `rows` rows, so a worker holds few long texts at a time.

    Spark also ends a batch at maxBytesPerBatch (64 MB unless set otherwise). The number of rows is a setting of the
    session that is read when the plan runs, so it stays lowered, for what else the session runs as well.
    """
    spark = df.sparkSession
    workers_see_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    return df.mapInArrow(function, schema)


def give_back() -> None:
    """Return to the system what numpy and Arrow have freed: Spark keeps idle workers, at the size they grew to."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries have not
    if trim:
        trim(0)


def trimmed(function):
    """`function` of one group, for applyInArrow; memory is given back after each."""

    def called(table):
        out = function(table)
        give_back()
        return out

    return called


def trimmed_batches(function):
    """`function` of batches, for `in_batches`; memory is given back at the end of the task."""

    def called(batches):
        yield from function(batches)
        give_back()

    return called


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATOR)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_sha(binary_or_text: Column) -> Column:
    return F.sha2(binary_or_text, 256)


# ---- numpy: words of many texts at once -------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_ALL = (1 << 64) - 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def inverse_odd(value: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2**64."""
    return np.uint64(pow(int(value), -1, 1 << 64))


#: Bytes or words hashed at one time; tables of powers reach so far, longer words get their own.
BLOCK = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those below BLOCK are kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.empty(max(n, BLOCK + 1), np.uint64)
        have[0] = 1
        filled = 1
        while filled < len(have):
            step = min(filled, len(have) - filled)
            have[filled : filled + step] = have[:step] * np.uint64(int(have[filled - 1]) * int(base) & _ALL)
            filled += step
        if len(have) == BLOCK + 1:
            _POWERS[int(base)] = have
    return have[:n]


def row_slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of rows of about `limit` bytes each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the len+1 offsets of its rows; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    if column.offset or len(column) == 0:
        column = pa.concat_arrays([column, pa.array([""], pa.large_string())])[: len(column)] if len(column) else pa.array([], pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(column) + 1]
    data = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of all rows, and the len+1 word offsets of the rows."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_IS_SPACE[data]
    starts_row = np.zeros(n + 1, bool)
    starts_row[offsets[:-1]] = True  # a row's first byte starts a word, whatever stands before it
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | starts_row))
    end = np.flatnonzero(before & (~inside | starts_row))
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes in every batch and process."""
    base, out, at = _BASES[which], np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        first = begin[at]
        to = max(at + 1, int(np.searchsorted(end, first + BLOCK, "right")))
        b, e = begin[at:to] - first, end[at:to] - first
        size = int(e[-1])
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((data[first : first + size].astype(np.uint64) + np.uint64(1)) * powers(base, size), out=total[1:])
        value = (total[e] - total[b]) * powers(inverse_odd(base), size + 1)[b]
        out[at:to] = mix(value + (e - b).astype(np.uint64) * base)
        at = to
    return out


def window_hashes(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of `width` word hashes; runs across rows are made too, the caller leaves them out."""
    n = len(hashes) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    base = _BASES[which]
    for at in range(0, len(out), BLOCK - width):
        part = hashes[at : min(at + BLOCK - 1, len(hashes))]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        made = len(part) - width + 1
        out[at : at + made] = mix((total[width:] - total[:-width]) * powers(inverse_odd(base), made))
    return out
