"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Rows with equal vectors become one node that keeps its `k + 1` smallest ids (no query can return more of them); the
limit is applied inside the map tasks, so a vector held by a third of all rows does not meet in one task.  Inner products
are searched as distances of vectors extended by one component that evens out their norms.

1. Nodes fall into cells around centroids (spherical k-means of the extended vectors, at most MAX_CELLS).  The centroids
   are fitted on a bounded sample, SAMPLE nodes per cell; every node is indexed, in the cell of its nearest centroid.  A
   cell of more than SHARD nodes is dealt by hash to shards of about that many.
2. A shard's graph has geometrically drawn levels; on each level a node's neighbours are chosen among its nearest by the
   diversity rule (a candidate closer to a chosen neighbour than to the node is passed over) and made mutual within the
   degree bound.  All levels are int32 arrays of fixed width.
3. A query goes to the shards of its `probes` nearest cells.  Their number is the smallest that holds ROUTED of the exact
   neighbours of sample nodes among the sample (whose neighbours are further away than those among all nodes); data
   without clusters thus get more probes, up to all.  A worker descends the levels and runs a beam search for BLOCK queries
   at once; a shard that many queries ask is copied, so that no task answers more than ASKED of them.
4. The answers of the shards are merged by rank, k per query and map task before the shuffle.

Scores are inner products of the original vectors in double precision, summed in component order; ties go to smaller
ids.  Recall against brute force is measured in the tests and the README (0.9 or more).

Defined results: null vectors, zero vectors, vectors with null or non-finite components, and vectors of another length
than the index's most frequent one (ties: the longer) take no part, neither do rows with a null id; repeated ids count as
separate rows, save that a query never returns its own id; equal query rows are asked once, different vectors under one
query id are ranked apart; with fewer than k candidates all are returned; no queries or an empty table give an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_TABLE, discard, materialize, release, small_batches

SHARD, DEGREE, BEAM, BLOCK, SEED = 4096, 24, 128, 256, 7
#: Cells at most, sample nodes per cell that centroids are fitted on, share of neighbours that the probed cells must hold.
MAX_CELLS, SAMPLE, ROUTED = 2048, 32, 0.95
#: Tasks at most that shards are dealt to; beyond, a task takes several, one after the other.
TASKS = 20_000
#: Queries that one copy of a shard answers.
ASKED = 8192


@dataclass(frozen=True)
class Index:
    """The written graphs, one row per shard, and how queries find them: centroids, first shard and shards of each cell."""

    graphs: DataFrame
    centroids: np.ndarray
    first: np.ndarray
    shards: np.ndarray
    probes: int
    dim: int


def valid(vectors: DataFrame, vec_col: str, id_col: str, dim: int | None = None) -> DataFrame:
    """(id, v) of the rows that take part, as floats where the column holds floats, else as doubles."""
    column = vectors.schema[vec_col].dataType
    kind = "array<float>" if isinstance(column, T.ArrayType) and isinstance(column.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))
    if dim is None:
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = common[0] if common else 0
    return rows.where(F.size("v") == dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of lists of one length."""
    return np.asarray(column.flatten()).reshape(-1, dim)


def _extended(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that brings their squared norms to `most`."""
    x = x.astype(np.float32)
    rest = np.maximum(most - (x.astype(np.float64) ** 2).sum(1), 0)
    return np.concatenate((x, np.sqrt(rest)[:, None].astype(np.float32)), axis=1)


def centroids_of(y: np.ndarray, cells: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: unit centroids of extended vectors; a cell without members moves to a node that fits badly."""
    r = np.random.default_rng(seed)
    c = y[r.choice(len(y), cells, replace=False)].copy()
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = y @ c.T
        own = near.argmax(1)
        order = np.argsort(own, kind="stable")
        size = np.bincount(own, minlength=cells)
        some = np.flatnonzero(size)
        c[some] = np.add.reduceat(y[order], (np.cumsum(size) - size)[some])
        none = np.flatnonzero(size == 0)
        c[none] = y[np.argsort(near.max(1), kind="stable")[: len(none)]]
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def probes_of(x: np.ndarray, y: np.ndarray, c: np.ndarray, k: int, share: float = ROUTED, asked: int = 512) -> int:
    """How many of the nearest cells hold `share` of the k exact neighbours of sample nodes, among the sample."""
    q = np.random.default_rng(SEED + 1).choice(len(x), min(asked, len(x)), replace=False)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(x[q] @ c[:, :-1].T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell, by query
    at = np.sort(np.take_along_axis(rank, (y @ c.T).argmax(1)[found], 1).ravel())
    return int(at[math.ceil(share * len(at)) - 1]) + 1


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 smallest ids; the rank limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _choose(order: np.ndarray, near: np.ndarray, full: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours by the diversity rule for all nodes at once: order holds candidates, near their similarity (ascending distance)."""
    n, width = order.shape
    out = np.full((n, degree), -1, np.int32)
    count, skipped = np.zeros(n, np.int64), np.zeros((n, width), bool)
    rows = np.arange(n)
    for j in range(width):
        c = order[:, j]
        closer = np.zeros(n, bool)
        for s in range(min(j, degree)):
            has = count > s
            other = np.where(has, out[:, s], 0)
            closer |= has & (full[c, other] > near[:, j])
        take = ~closer & (count < degree) & (c >= 0)
        out[rows[take], count[take]] = c[take]
        count += take
        skipped[:, j] = closer
    for j in range(width):  # fill up with the nearest that were passed over
        take = skipped[:, j] & (count < degree)
        out[rows[take], count[take]] = order[take, j]
        count += take
    return out


def _mutual(out: np.ndarray, full: np.ndarray, width: int) -> np.ndarray:
    """Neighbour arrays of twice the degree with the links back, nearest first."""
    n, degree = out.shape
    a, b = np.repeat(np.arange(n), degree), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pair = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = pair // n, pair % n
    own = np.zeros(len(pair), bool)
    own[np.searchsorted(pair, np.unique((np.repeat(np.arange(n), degree) * n + out.ravel())[out.ravel() >= 0]))] = True
    order = np.lexsort((-full[a, b], ~own, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - first[a]
    flat = np.full((n, width), -1, np.int32)
    on = place < width
    flat[a[on], place[on]] = b[on]
    return flat


def build(x: np.ndarray, degree: int = DEGREE, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the bottom: (members, neighbour array in member positions)."""
    norms = (x.astype(np.float64) ** 2).sum(1)
    y = np.concatenate((x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))[:, None].astype(np.float32)), axis=1)
    height = np.floor(-np.log(np.random.default_rng(seed).random(len(x))) / math.log(degree)).astype(int)
    levels = []
    for level in range(int(height.max(initial=0)) + 1):
        members = np.flatnonzero(height >= level).astype(np.int32)
        z = y[members]
        full = z @ z.T  # a shard is bounded; equal extended norms: order by product is order by distance
        np.fill_diagonal(full, -np.inf)
        width = min(len(members) - 1, 3 * degree)
        if width < 1:
            levels.append((members, np.full((len(members), 1), -1, np.int32)))
            continue
        order = np.concatenate([np.argpartition(-full[lo: lo + 256], width - 1, axis=1)[:, :width] for lo in range(0, len(members), 256)])
        near = np.take_along_axis(full, order, 1)
        by = np.argsort(-near, axis=1, kind="stable")
        order, near = np.take_along_axis(order, by, 1), np.take_along_axis(near, by, 1)
        levels.append((members, _mutual(_choose(order, near, full, degree), full, 2 * degree)))
    return levels


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Node positions found for each query, best first by float32 score, -1 where there are none."""
    n, rows = len(x), np.arange(len(q))
    if n <= beam:
        return np.argsort(-(q @ x.T), axis=1, kind="stable")
    at = np.zeros(len(q), np.int64) + levels[-1][0][0]
    for members, near in reversed(levels[1:]):  # greedy descent
        position = np.searchsorted(members, at)
        best = np.einsum("ij,ij->i", q, x[members[position]])
        moving = np.ones(len(q), bool)
        while moving.any():
            options = near[position[moving]]
            score = np.einsum("ij,ikj->ik", q[moving], x[members[np.maximum(options, 0)]])
            score[options < 0] = -np.inf
            top = score.argmax(1)
            value = score[np.arange(len(top)), top]
            better = value > best[moving]
            now = np.flatnonzero(moving)
            position[now[better]], best[now[better]] = options[np.arange(len(top)), top][better], value[better]
            moving[now[~better]] = False
        at = members[position].astype(np.int64)
    near = levels[0][1]
    seen = np.zeros((len(q), n), bool)
    ids = np.full((len(q), beam), -1, np.int64)
    score = np.full((len(q), beam), -np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    ids[:, 0], score[:, 0], done[:, 0] = at, np.einsum("ij,ij->i", q, x[at]), False
    seen[rows, at] = True
    while True:
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            break
        step = 4  # nodes opened at once per query
        waiting = np.where(done[active], -np.inf, score[active])
        pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        real = np.take_along_axis(waiting, pick, 1) > -np.inf
        r = np.repeat(active, step).reshape(-1, step)
        done[r[real], pick[real]] = True
        opened = np.where(real, ids[r, pick], -1)
        options = np.where(opened[:, :, None] >= 0, near[np.maximum(opened, 0)], -1).reshape(len(active), -1)
        options = np.sort(options, axis=1)
        fresh = options >= 0
        fresh[:, 1:] &= options[:, 1:] != options[:, :-1]
        fresh &= ~seen[active[:, None], np.maximum(options, 0)]
        who, which = np.nonzero(fresh)
        found = options[who, which]
        seen[active[who], found] = True
        value = np.full(options.shape, -np.inf, np.float32)
        value[who, which] = np.einsum("ij,ij->i", q[active[who]], x[found])
        every = np.concatenate((score[active], value), axis=1)
        names = np.concatenate((ids[active], np.where(fresh, options, -1)), axis=1)
        state = np.concatenate((done[active], ~fresh), axis=1)
        keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        score[active], ids[active] = np.take_along_axis(every, keep, 1), np.take_along_axis(names, keep, 1)
        done[active] = np.take_along_axis(state, keep, 1)
    by = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, by, 1)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in component order."""
    return np.cumsum(q.astype(np.float64) * v.astype(np.float64), axis=-1)[..., -1]


GRAPH = "shard long, dim int, wide boolean, vectors binary, lens binary, ids binary, members array<binary>, links array<binary>"
GRAPH_SCHEMA = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), ("vectors", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary()), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, shard: int = SHARD) -> Index:
    """The written index: per shard its vectors, id lists and the flat neighbour arrays of each level; and its routing."""
    nodes = materialize(nodes_of(valid(small_batches(vectors), vec_col, id_col), k), "ann-nodes")
    squares = F.aggregate(F.transform("v", lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, a: s + a)
    n, most, dim = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(squares), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cells = max(1, min(MAX_CELLS, math.ceil(n / shard)))
    wide = isinstance(nodes.schema["v"].dataType.elementType, T.DoubleType)
    if cells > 1:
        share = min(1.0, 1.1 * SAMPLE * cells / n)
        drawn = nodes.where(F.pmod(F.xxhash64("h", F.lit(SEED + 2)), F.lit(1 << 30)) < int((1 << 30) * share)).select("h", F.col("v").cast("array<float>").alias("v")).limit(2 * SAMPLE * cells).toArrow()
        x = _matrix(drawn.column("v").combine_chunks(), dim)[np.argsort(np.asarray(drawn.column("h")), kind="stable")]  # whatever the tasks' order was
        y = _extended(x, most)
        c = centroids_of(y, min(cells, len(y)))
        probes = probes_of(x, y, c, k)
    else:
        c, probes = np.zeros((1, dim + 1), np.float32), 1

    def cell(batches):
        for batch in batches:
            own = (_extended(_matrix(batch.column("v"), dim), most) @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32())], names=["cell"])

    sizes = np.zeros(len(c), np.int64)
    for r in nodes.select("v").mapInArrow(cell, "cell int").groupBy("cell").count().collect():  # MAX_CELLS rows at most
        sizes[r[0]] = r[1]
    shards = np.ceil(sizes / shard).astype(np.int64)
    first = np.cumsum(shards) - shards

    def deal(batches):
        for batch in batches:
            own = (_extended(_matrix(batch.column("v"), dim), most) @ c.T).argmax(1)
            place = first[own] + (np.asarray(batch.column("h")).view(np.uint64) % np.maximum(shards[own], 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("v"), batch.column("ids")], names=["shard", "v", "ids"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            x, ids, place = _matrix(batch.column("v"), dim), batch.column("ids").to_pylist(), np.asarray(batch.column("shard"))
            for s in np.unique(place).tolist():
                at = np.flatnonzero(place == s)
                held.setdefault(s, []).append((x[at], [ids[i] for i in at]))
        for s in sorted(held):
            parts = held.pop(s)
            ids = [i for _, some in parts for i in some]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            x = np.concatenate([p for p, _ in parts])[order]
            levels = build(x.astype(np.float32))
            yield pa.RecordBatch.from_pydict({
                "shard": [s], "dim": [dim], "wide": [wide], "vectors": [x.tobytes()], "lens": [np.array([len(ids[i]) for i in order], np.int32).tobytes()],
                "ids": [np.concatenate([np.array(ids[i], np.int64) for i in order]).tobytes()],
                "members": [[m.tobytes() for m, _ in levels]], "links": [[a.tobytes() for _, a in levels]]}, schema=GRAPH_SCHEMA)
            release()

    placed = nodes.select(F.xxhash64("h", F.lit(SEED)).alias("h"), "v", "ids").mapInArrow(deal, T.StructType([T.StructField("shard", T.LongType()), nodes.schema["v"], nodes.schema["ids"]]))
    graphs = materialize(placed.repartition(max(1, min(TASKS, int(shards.sum()))), "shard").mapInArrow(run, GRAPH), "ann-index")
    discard(nodes)
    return Index(graphs, c, first, shards, probes, dim)


def query(index: Index, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, beam: int = BEAM, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row (its own id excepted)."""
    asked = valid(small_batches(queries), vec_col, id_col, index.dim).dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("v"))
    dim, c, first, shards = index.dim, index.centroids, index.first, index.shards
    probes = min(len(c), index.probes if probes is None else probes)

    def ways(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) pairs: all shards of the nearest cells."""
        near = np.argsort(-(_matrix(v, dim).astype(np.float32) @ c[:, :-1].T), axis=1, kind="stable")[:, :probes].ravel()
        count = shards[near]
        who = np.repeat(np.repeat(np.arange(len(v)), probes), count)
        return who, np.repeat(first[near], count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ways(batch.column("v"))[1], pa.int64())], names=["shard"])

    def routed(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                who, to = ways(batch.column("v"))
                for at in range(0, len(who), 10_000):
                    part = pa.array(who[at: at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(to[at: at + 10_000], pa.int64()), *(batch.column(x).take(part) for x in ("id", "key", "v"))], names=["shard", "qid", "qkey", "q"])

    # copies of a shard by the number of its queries; one row per shard
    copies = materialize(asked.select("v").mapInArrow(counted, "shard long").groupBy("shard").agg(
        F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("copies")), "ann-copies")
    total, tasks = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    small = F.broadcast(copies) if total <= SMALL_TABLE else copies
    ways_schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("qid", T.LongType()), T.StructField("qkey", T.LongType()), T.StructField("q", asked.schema["v"].dataType)])
    dealt = asked.select("id", "key", "v").mapInArrow(routed, ways_schema).join(small, "shard").withColumn("copy", F.pmod(F.xxhash64("qid", "qkey"), F.col("copies")).cast("int")).drop("copies")
    graphs = index.graphs.join(small, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = graphs.unionByName(dealt, allowMissingColumns=True).withColumn("after", F.col("vectors").isNull())

    def answers(graph, qids: np.ndarray, keys: np.ndarray, q: np.ndarray):
        exact, x, lens, ids, start, levels = graph
        found = search(x, levels, q.astype(np.float32), max(beam, k + 1))
        rows = []
        for row, (own, key) in enumerate(zip(qids.tolist(), keys.tolist())):
            nodes = found[row][found[row] >= 0]
            if len(nodes) < min(k + 1, len(x)):  # a part of the graph that the walk did not reach
                nodes = np.arange(len(x))
            value = exact_scores(q[row], exact[nodes])
            # all nodes as good as the (k + 1)-th: ties are settled by id
            top = np.flatnonzero(value >= np.sort(value)[::-1][min(k, len(nodes) - 1)])
            mine = sorted((-float(value[j]), int(i)) for j in top.tolist() for i in ids[start[nodes[j]]: start[nodes[j]] + lens[nodes[j]]] if i != own)
            rows += [(own, key, i, -s) for s, i in mine[:k]]
        if rows:
            a, b, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "query_key", "vec_id", "score"])

    def run(batches):
        graph, here = None, None
        for batch in batches:
            place, copy, heads = np.asarray(batch.column("shard")), np.asarray(batch.column("copy")), np.asarray(batch.column("vectors").is_valid())
            cuts = np.unique(np.concatenate(([0, batch.num_rows], np.flatnonzero(heads), np.flatnonzero(heads) + 1)))
            for lo, hi in zip(cuts, cuts[1:]):
                if heads[lo]:  # a shard's graph comes before its queries
                    r = batch.slice(lo, 1).to_pylist()[0]
                    exact = np.frombuffer(r["vectors"], np.float64 if r["wide"] else np.float32).reshape(-1, r["dim"])
                    lens, ids = np.frombuffer(r["lens"], np.int32), np.frombuffer(r["ids"], np.int64)
                    members = [np.frombuffer(m, np.int32) for m in r["members"]]
                    levels = [(m, np.frombuffer(a, np.int32).reshape(len(m), -1)) for m, a in zip(members, r["links"])]
                    graph, here = (exact, exact.astype(np.float32), lens, ids, np.cumsum(lens) - lens, levels), (r["shard"], r["copy"])
                    continue
                if here != (place[lo], copy[lo]):
                    raise RuntimeError(f"no graph came before the queries of shard {place[lo]}")
                for at in range(lo, hi, BLOCK):
                    part = batch.slice(at, min(BLOCK, hi - at))
                    yield from answers(graph, np.asarray(part.column("qid")), np.asarray(part.column("qkey")), _matrix(part.column("q"), dim))
        release()

    found = both.repartition(max(1, min(TASKS, 2 * tasks)), "shard", "copy").sortWithinPartitions("shard", "copy", "after").mapInArrow(run, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.select("*", rank.alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
