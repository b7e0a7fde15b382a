"""Near-duplicate detection: fast similarity sketching, banding, exact verification.

A document's set is its distinct shingles of `k` words (A-Z lower-cased; with fewer words the whole sequence).  Its
sketch has BANDS * ROWS coordinates, filled by rounds of hashed bin placement: in each of the first t rounds every
element falls into one random bin with a random value; in rounds t+1..2t element bins are no longer random but every
element visits bin (round - t), so each coordinate surely fills; a coordinate keeps the smallest (round, value) seen, and
rounds stop once all are full.  Agreement of coordinates then estimates the Jaccard similarity with concentration bounds
like independent samples, at cost O(set + t log t) instead of O(set * t).

Pairs that agree on a whole band are candidates.  At similarity 0.8 a pair misses all bands with probability about 1e-7.

1. Rows with equal sets form one class, combined map-side before anything else; a class is named by a 64-bit digest of its
   set (two of 1e10 classes share a name with a chance of 3e-10 each, far below that of missing all bands).
2. Per bucket only pairs (member, smallest member) are compared, so a bucket of n classes gives n - 1 pairs.
3. Verified pairs are contracted to parts (connected components).  In buckets that still hold several parts, members of
   different parts are compared inside the worker (each pair in the first bucket it shares) on 32-bit shingle hashes, with
   room for as many as collide within a set, so that no pair of such a bucket becomes a row unless it may be a link.  Work
   is dealt in blocks of BLOCK members; blocks of one large part do not meet each other, so a large group of near copies
   beside a few strangers costs in proportion to its size.  No candidate is dropped.
4. Links are confirmed by intersecting the full shingle sets (64-bit shingle hashes; two distinct shingles of a pair of
   1,000-shingle sets agree by chance with probability 1e-13).  Links between parts connect parts, not documents again.

Defined results: null or empty texts, or texts of white space only, have n_shingles 0 and stay alone; rows that share
a doc_id are judged each by its own text (and are copies of each other only if their sets are); null doc_ids are never
linked and keep component_id null; input columns other than id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_bytes, materialize, mix64, release, slices, small_batches, word_arrays
from .components import components

BANDS, ROWS = 40, 5
#: Members of a bucket that are compared in one piece.
BLOCK = 2_000
#: Shingle hashes that are looked up at once.
LOOKUP = 1 << 20


def shingle_sets(texts: pa.Array, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct 64-bit shingle hashes of each text."""
    offsets, codes, words = word_arrays(texts, lower=True)
    n = np.diff(offsets)
    hashed = mix64(hash_bytes(words.to_pylist())) if len(words) else np.empty(0, np.uint64)
    h = hashed[codes]
    rows = np.arange(len(n))
    # a shingle starts at each word that has k - 1 words of its row after it; short rows have one, of all their words
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    row = np.repeat(rows, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][row]
    mixed = np.zeros(len(start), np.uint64)
    for j in range(k):
        there = (start + j) < offsets[1:][row]
        part = h[np.minimum(start + j, len(h) - 1)] if len(h) else h
        mixed = np.where(there, mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(j + 1)), mixed)
    ends = np.cumsum(count).tolist()
    for lo, hi in zip([0, *ends], ends):
        mixed[lo:hi].sort()
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1])
    row, mixed = row[first], mixed[first]
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))).astype(np.int64), mixed


def sketch(offsets: np.ndarray, sets: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketches (rows of t coordinates) of sets given by offsets; rows of empty sets are all ones."""
    n = len(offsets) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    live, element = row, sets
    for r in range(2 * t):
        if not len(live):
            break
        h = mix64(element + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if r < t else np.full(len(h), r - t, np.uint64)
        # a smaller round always wins; within a round the value decides
        value = (np.uint64(r) << np.uint64(52)) | (mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(12))
        np.minimum.at(out, live * t + place.astype(np.int64), value)
        if r + 1 < 2 * t:
            open_rows = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(1)
            on = open_rows[live]
            live, element = live[on], element[on]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, distinct between bands."""
    keys = np.zeros((len(sketches), BANDS), np.uint64)
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    for j in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return mix64(keys + np.arange(1, BANDS + 1, dtype=np.uint64))


def _longs(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.uint64).view(np.int64)))


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, hash of the text, n_shingles, the class (a 64-bit digest of the whole set), band keys."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                offsets, sets = shingle_sets(batch.column("text"), k)
                n = np.diff(offsets)
                keys = band_keys(sketch(offsets, sets))
                some = n > 0
                at = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"), pa.array(n), pa.array(class_of(offsets, sets)), _longs(at, keys[some].ravel())], names=["id", "text_hash", "n", "class", "bands"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, text_hash long, n long, class long, bands array<long>")


def class_of(offsets: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A digest of each whole set: equal for equal sets."""
    digest = np.diff(offsets).astype(np.uint64)
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(salt)), dtype=np.uint64)))
        digest = mix64(digest * np.uint64(0x9E3779B97F4A7C15) + mix64(total[offsets[1:]] - total[offsets[:-1]]))
    return digest.view(np.int64)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id (the class) and the full shingle set of the texts of the documents in ids."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                offsets, sets = shingle_sets(batch.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(class_of(offsets, sets)), _longs(offsets, sets)], names=["id", "items"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id long, items array<long>").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and what else they have) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select(*pairs.columns, both.alias("both"), (F.size("items_a") + F.size("items_b")).alias("total"))
        .where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select(*pairs.columns)
    )


def cross_links(members: DataFrame, detail: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts (pa, pb) within a bucket whose sets look similar enough; counted on 32-bit shingle hashes.

    members: band, id, part, n; detail: id, bands, items, one row per id, which travels to the blocks alone.
    """

    def pairs_of(band: int, ids, part, size, keys, items, left, right):
        lens = np.array([len(items[i]) for i in right])
        twin = left is right
        for x in left.tolist():
            near = np.flatnonzero((part[right] != part[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])))
            if twin:
                near = near[ids[right[near]] > ids[x]]
            if not len(near):
                continue
            same = keys[right[near]] == keys[x]
            near = near[same.any(1) & (keys[x][same.argmax(1)] == band)]
            mine = items[x]
            for some in np.split(near, np.flatnonzero(np.diff(np.cumsum(lens[near]) // LOOKUP)) + 1) if len(near) else ():
                flat = np.concatenate([items[right[i]] for i in some])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(lens[some]) - lens[some], dtype=np.int64)
                both += np.maximum(0, np.minimum(size[x] - len(mine), size[right[some]] - lens[some]))  # hashes that agree within a set
                for y in right[some[100 * both >= percent * (size[right[some]] + size[x] - both)]].tolist():
                    yield (ids[x], ids[y], part[x], part[y]) if ids[x] > ids[y] else (ids[y], ids[x], part[y], part[x])

    def run(batches):
        key, held = None, []

        def flush():
            if not held:
                return
            ids, part, size, side, keys = (np.concatenate([h[c] for h in held]) for c in range(5))
            items = [np.frombuffer(b, np.uint32) for h in held for b in h[5]]
            every = np.arange(len(ids))
            left, right = (every, every) if key[2] == "twin" else (every[side == 0], every[side == 1])
            found = list(pairs_of(key[0], ids, part, size, keys, items, left, right)) if len(left) and len(right) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "pa", "pb"])

        for batch in batches:
            group = list(zip(*(batch.column(c).to_pylist() for c in ("band", "meets", "kind"))))
            cuts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if group[lo] != key:
                    yield from flush()
                    key, held = group[lo], []
                part = batch.slice(lo, hi - lo)
                ids, parts, size, side = (np.asarray(part.column(c)) for c in ("id", "part", "n", "side"))
                held.append((ids, parts, size, side, np.asarray(part.column("bands").flatten()).reshape(hi - lo, -1), part.column("items").to_pylist()))
        yield from flush()
        release()

    # a block: up to BLOCK members or so of one large part, or of several parts that are smaller each
    sizes = members.groupBy("band", "part").agg(F.count(F.lit(1)).alias("m"))
    large = F.col("m") > BLOCK
    block = lambda part, k: F.concat_ws(":", F.coalesce(part.cast("string"), F.lit("")), k.cast("string"))
    buckets = sizes.groupBy("band").agg(
        F.ceil(F.sum(F.when(~large, F.col("m")).otherwise(0)) / BLOCK).cast("int").alias("small"),
        F.collect_list(F.when(large, F.struct("part", F.ceil(F.col("m") / BLOCK).cast("int").alias("k")))).alias("large"))  # no more than members / BLOCK
    of = F.when(F.size("mine") > 0, F.col("part"))
    rows = (
        members.join(buckets, "band").withColumn("mine", F.filter("large", lambda x: x["part"] == F.col("part")))
        .withColumn("own", F.when(F.size("mine") > 0, block(F.col("part"), F.pmod(F.xxhash64("id"), F.col("mine")[0]["k"]))).otherwise(
            block(F.lit(None), F.pmod(F.xxhash64("part"), F.greatest("small", F.lit(1))))))
        .withColumn("others", F.concat(
            F.transform(F.sequence(F.lit(1), F.greatest("small", F.lit(1))), lambda k: block(F.lit(None), k - 1)),
            F.flatten(F.transform(F.filter("large", lambda x: ~x["part"].eqNullSafe(of)), lambda x: F.transform(F.sequence(F.lit(1), x["k"]), lambda k: block(x["part"], k - 1))))))
        .withColumn("other", F.explode("others"))
        .withColumn("meets", F.concat_ws("|", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("kind", F.when(F.col("own") == F.col("other"), "twin").otherwise("pair"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .select("band", "meets", "kind", "side", "id", "part", "n").join(detail, "id")
        .select("band", "meets", "kind", "side", "id", "part", "n", "bands", "items")
    )
    return rows.repartition("band", "meets").sortWithinPartitions("band", "meets").mapInArrow(run, "a long, b long, pa long, pb long").distinct()


def packed(sets: DataFrame) -> DataFrame:
    """id and its shingles as sorted distinct 32-bit hashes, packed."""

    def run(batches):
        for batch in batches:
            column = batch.column("items")
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
            rows = [np.unique((flat[lo:hi] >> np.uint64(32)).astype(np.uint32)).tobytes() for lo, hi in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], names=["id", "items"])

    return sets.mapInArrow(run, "id long, items binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (smallest id reachable by links), kept, text_hash (xxhash64 of the text)."""
    rows = materialize(sketched(small_batches(docs), id_col, text_col, k), "sketches")
    some = rows.where("n > 0 AND id IS NOT NULL")
    classes = materialize(some.groupBy("class").agg(F.min("id").alias("rep")), "set-classes")
    reps = some.join(classes.select(F.col("rep").alias("id"), "class"), ["id", "class"], "left_semi").dropDuplicates(["class"]).select(
        F.col("class").alias("id"), F.col("id").alias("rep"), "n", "bands")
    placed = reps.select("id", "rep", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "low")
    members = materialize(placed.join(shared, "band"), "band-members")
    sets = materialize(full_sets(docs, members.select(F.col("rep").alias("id")).distinct(), id_col, text_col, k), "full-sets")

    star = members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    links = materialize(verified(star, sets, percent), "links")
    parts = components(links)

    tagged = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", "n", F.coalesce("component", "id").alias("part"))
    mixed = tagged.groupBy("band").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("band")
    open_rows = materialize(tagged.join(mixed, "band", "left_semi"), "open-members")
    detail = reps.select("id", "bands").join(packed(sets), "id")
    more = materialize(verified(cross_links(open_rows, detail, percent), sets, percent).select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
    wider = components(more)  # of parts: what the first pass connected is not gone through again
    light = materialize(rows.select("id", "text_hash", "n", "class"), "sketched")
    discard(rows, members, sets, open_rows, links, more)

    # the name of a component is the smallest doc_id of its classes
    linked = parts.union(wider.select("node", F.col("node").alias("component"))).dropDuplicates(["node"]).alias("x").join(
        wider.alias("y"), F.col("x.component") == F.col("y.node"), "left").select(
        F.col("x.node").alias("class"), F.coalesce("y.component", "x.component").alias("whole"))
    linked = classes.join(linked, "class")
    named = linked.join(linked.groupBy("whole").agg(F.min("rep").alias("component")), "whole").select("class", "component")
    known = materialize(classes.join(named, "class", "left").select("class", F.coalesce("component", "rep").alias("component")), "set-components")
    discard(classes, parts, wider)
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return light.join(known, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"), "text_hash")
