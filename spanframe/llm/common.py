"""Helpers that the operators of this package share: shared storage, Arrow text buffers, rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass works on; temporaries are some 30 times that.
PIECE_BYTES = 1 << 20


_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="spanframe-shared-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables write_table has written so far: a mark for drop_tables."""
    return len(_written)


def drop_tables(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the tables that write_table wrote from the mark `first` on and before `last`.

    For when no result that reads them is needed any more: the pipeline drops a stage's tables once the next one is
    written, the component rounds drop a round's once the next one is, and callers of an operator all of them at the end.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i, path in enumerate(_written):
        if path and i >= first and (last is None or i < last):
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)
            _written[i] = ""  # marks stay valid
    if not any(_written):
        _written.clear()


def input_bytes(df: DataFrame, col: str) -> int:
    """Bytes of the UTF-8 of a column over the whole table: one aggregate row."""
    return int(df.agg(F.sum(F.octet_length(F.col(col).cast("binary")).cast("long")).alias("n")).first()["n"] or 0)


def out_schema(df: DataFrame, added: list[tuple[str, T.DataType]]) -> tuple[T.StructType, list[str]]:
    """df's columns without those whose name (case aside) clashes with an added one, then the added ones."""
    names = {n.lower() for n, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added]), [f.name for f in kept]


def split_batches(batches, text: str, most: int = PIECE_BYTES):
    """Cut record batches so that each holds at most `most` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i)
            i = j
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: workers stay for later tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 row bounds in them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if not (pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, 8 * col.offset)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if col.null_count:
        live = np.asarray(col.is_valid())
        size = np.diff(offs) * live
        keep = np.concatenate([data[offs[i] : offs[i + 1]] for i in np.flatnonzero(size)] or [data[:0]])
        return keep, np.concatenate([[0], np.cumsum(size)])
    return data[offs[0] : offs[-1]], offs - offs[0]


# Rolling hashes -----------------------------------------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, r, np.uint64), dtype=np.uint64)]) for r in (_R, _R_INV))
    return _powers


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers, modulo 2**64, for span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], dtype=np.uint64, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of what prefix_sums was given; equal contents, equal hashes, wherever they stand."""
    inv = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: len(x) - w + 1 of them."""
    if len(x) < w:
        return x[:0]
    have, y = 1, x
    while have * 2 <= w:
        y = np.minimum(y[:-have], y[have:])
        have *= 2
    if have < w:
        y = np.minimum(y[: len(y) - (w - have)], y[w - have :])
    return y


def find_words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, and the first word of each row (n + 1 bounds); runs end with their row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    at = offs[:-1][offs[:-1] < offs[1:]]
    before[at] = False
    after[at[1:] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def concat_ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, ..."""
    size = end - start
    keep = size > 0
    start, size = start[keep], size[keep]
    if not len(size):
        return np.zeros(0, np.int64)
    out = np.ones(int(size.sum()), np.int64)
    out[0] = start[0]
    first = np.cumsum(size)[:-1]
    out[first] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out)
