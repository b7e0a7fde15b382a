"""Shared plumbing of the training-data operators: shared-folder tables, Arrow helpers, hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import discard, materialize, shared_dir  # noqa: F401  (one way to shared tables for all operators)

#: Text handled at once by a Python worker; bounds its memory whatever the row sizes are.
SLICE_BYTES = 2 << 20
#: Tables of up to this many rows (some 20 MB at most) may be sent to all tasks; beyond, rows meet by a shuffled join.
SMALL_TABLE = 100_000


#: Bytes of an Arrow batch on its way to a Python worker; rows are bounded by Spark's own setting.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the bytes of the session's Arrow batches: rows hold whole texts, so a number of rows bounds nothing."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and idle ones would keep it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with about `limit` bytes in `column` (a longer row stands alone)."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def arrow_append(df: DataFrame, fields: list[T.StructField], text_col: str, fn, drop: tuple[str, ...] = (), done=None) -> DataFrame:
    """Rows of df with `fields` appended; fn maps a record batch to their arrays, done ends a task.

    Input columns named like an appended one give way to it (compared without case, as Spark resolves names).
    """
    taken = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [c for c in df.columns if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + fn(batch), names=keep + [f.name for f in fields])
        if done is not None:
            done()
        release()

    return small_batches(df).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift-multiply rounds of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_bytes(values: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, values), dtype=np.uint64, count=len(values))


def word_arrays(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-white-space words of each text: (offsets per row, code of each word, the distinct words as binary).

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; `lower` maps A-Z only.  Null counts as empty.
    """
    texts = pc.fill_null(texts, "")  # no cast to large_string: of a slice, ascii_lower would then read wrong bytes
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary.cast(pa.large_binary())


def spread(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

