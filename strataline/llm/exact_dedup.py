"""Exact dedup by an extendible-hash index kept as files in the shared folder.

DataFrame functions only.  A text's key is the 64-bit hash of its normalised bytes; a bucket is a range of keys, named by
leading bits, and the directory maps every combination of leading bits to its bucket.

1. A first pass counts rows per key.  The directory doubles (one more leading bit) wherever a bucket would hold more than
   `bucket_rows` rows, until no bucket is overfull or the directory has 2 ** MAX_DEPTH cells; with more than
   `bucket_rows` * 2 ** (MAX_DEPTH - 1) rows the bound of a bucket grows in proportion, so the directory does not.
2. Every text travels to the owner of its bucket: an owner task holds whole buckets, that is ranges of keys.  Keys of
   very many rows (HOT_ROWS, or a SMALL_TABLE-th of all rows where that is more; a table of bounded size) are combined
   first, map-side and in SALTS parts, so that a text that a third of all rows hold reaches its owner SALTS times.
3. The owner compares texts of one key byte by byte and chains different ones (`chain` = 0, 1, ...).  Its entries, with
   the SHA-256 of each distinct text, are the index.  Entries of a chain of several texts keep their text.
4. Documents find their bucket through the directory and look their key up there; where a key has a chain, the bytes are
   compared with each entry's text.

Defined results: null text counts as empty (all empty texts are copies of each other); of rows tied on the largest
doc_id all are kept; null doc_ids count as smaller than any other (a group of only null ids has keep_id null and keeps
its rows); an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_TABLE, discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most leading bits of the directory: 65,536 cells at most on the driver and in the table that is sent to all tasks.
MAX_DEPTH = 16
BUCKET_ROWS, HOT_ROWS, SALTS = 1_024, 1_024, 16


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def directory(keys: DataFrame, bucket_rows: int) -> list[tuple[int, int]]:
    """(leading bits as a number, depth) of every bucket, in key order, from a table of (key, weight)."""
    cell = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    sizes = {r[0]: r[1] for r in keys.groupBy(cell.alias("cell")).agg(F.sum("weight")).collect()}  # 2 ** MAX_DEPTH rows at most
    levels = [sizes]  # rows per cell, from the most leading bits to none
    for _ in range(MAX_DEPTH):
        wider: dict[int, int] = {}
        for c, n in levels[-1].items():
            wider[c >> 1] = wider.get(c >> 1, 0) + n
        levels.append(wider)
    room = max(bucket_rows, levels[-1].get(0, 0) >> (MAX_DEPTH - 1))
    done, overfull = [], [(0, 0)]
    while overfull:  # one more leading bit for the buckets that hold too much
        bits, depth = overfull.pop()
        if depth == MAX_DEPTH or levels[MAX_DEPTH - depth].get(bits, 0) <= room:
            done.append((bits, depth))
        else:
            overfull += [(2 * bits, depth + 1), (2 * bits + 1, depth + 1)]
    return sorted(done, key=lambda b: b[0] << (MAX_DEPTH - b[1]))


@dataclass(frozen=True)
class Directory:
    """The bucket of every combination of `depth` leading bits, in order; and the keys of very many rows."""

    buckets: list[int]
    depth: int
    hot: DataFrame | None

    def bucket(self, key: Column) -> Column:
        """The bucket of a key: a look-up in a constant of 2 ** MAX_DEPTH numbers at most."""
        cell = F.shiftrightunsigned(key, 64 - self.depth) if self.depth else F.lit(0).cast("long")
        found = F.element_at(F.split(F.lit(",".join(map(str, self.buckets))), ","), (cell + 1).cast("int")).cast("int")
        return F.coalesce(found, F.lit(0))  # never null, so that joins on it need no filter that would hash texts again


def plan_directory(docs: DataFrame, text_col: str = "text", bucket_rows: int = BUCKET_ROWS, key: Callable[[Column], Column] = F.xxhash64, hot_rows: int = HOT_ROWS) -> Directory:
    """Counts the rows of every key and splits overfull buckets."""
    counts = materialize(docs.select(key(normalised(F.col(text_col))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    limit = max(hot_rows, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SMALL_TABLE)
    found = directory(counts.select("key", F.when(F.col("n") > limit, F.lit(SALTS)).otherwise(F.col("n")).alias("weight")), bucket_rows)
    deepest = max(d for _, d in found)
    # SMALL_TABLE rows at most: each holds more than a SMALL_TABLE-th of all rows
    hot = materialize(counts.where(F.col("n") > limit).select(F.col("key").alias("hot_key")), "exact-hot")
    discard(counts)
    if hot.isEmpty():
        discard(hot)
        hot = None
    return Directory([i for i, (_, d) in enumerate(found) for _ in range(1 << (deepest - d))], deepest, hot)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS,
                key: Callable[[Column], Column] = F.xxhash64, hot_rows: int = HOT_ROWS, plan: Directory | None = None) -> DataFrame:
    """The written index: bucket, key, chain, texts (of its key), text_sha256, n_bytes, keep_id, group_size, bytes.

    One row per distinct text; `bytes` is the normalised text where its key has several, else null.
    """
    plan = plan or plan_directory(docs, text_col, bucket_rows, key, hot_rows)
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("key", key(F.col("norm")))
    if plan.hot is None:
        sent = rows.select("key", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    else:
        hot, same = F.broadcast(plan.hot), F.col("key") == F.col("hot_key")
        many = rows.join(hot, same).groupBy("key", "norm", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(
            F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        sent = rows.join(hot, same, "left_anti").select(
            "key", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).union(many.select("key", "norm", "keep_id", "group_size"))
    # to the owners: whole buckets meet in one task, and everything below stays within it
    owned = sent.withColumn("bucket", plan.bucket(F.col("key"))).repartition("bucket")
    entries = owned.groupBy("bucket", "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chains = entries.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(F.struct("norm", "keep_id", "group_size"))).alias("chain"))
    found = chains.select("bucket", "key", F.size("chain").alias("texts"), F.posexplode("chain").alias("chain", "entry"))
    index = materialize(found.select(
        "bucket", "key", "chain", "texts", F.sha2("entry.norm", 256).alias("text_sha256"), F.octet_length("entry.norm").alias("n_bytes"), "entry.keep_id",
        "entry.group_size", F.when(F.col("texts") > 1, F.col("entry.norm")).alias("bytes")), "exact-index")
    if plan.hot is not None:
        discard(plan.hot)
    return index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS,
                key: Callable[[Column], Column] = F.xxhash64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (of the normalised text) for every row, dropped ones too."""
    plan = plan_directory(docs, text_col, bucket_rows, key, hot_rows)
    index = build_index(docs, id_col, text_col, key=key, plan=plan)
    norm, found = normalised(F.col(text_col)), ["keep_id", "group_size", "text_sha256"]
    place = [F.col("bucket").alias("_bucket"), F.col("key").alias("_key")]
    rows = docs.select(*[c for c in docs.columns if c.lower() not in (*found, "kept", "_bucket", "_key", "_bytes")]).withColumn("_key", key(norm)).withColumn("_bucket", plan.bucket(F.col("_key")))
    out = rows.join(index.where("texts = 1").select(*place, *found), ["_bucket", "_key"])
    chained = index.where("texts > 1").select(*place, *found, F.col("bytes").alias("_bytes"))
    if not chained.isEmpty():  # different texts of one key: bytes decide
        beside = rows.withColumn("_norm", norm).join(chained, ["_bucket", "_key"]).where(F.col("_norm") == F.col("_bytes")).drop("_norm", "_bytes")
        out = out.unionByName(beside)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).drop("_bucket", "_key")
