"""Quality classifier with hierarchical empirical-Bayes site evidence.

1. A logistic regression over character and word statistics of the whole text, trained here on a bounded sample of
   labelled rows (`max_train`), gives each document a log-odds of being good.
2. Grouped aggregation adds up these probabilities per path (host and sub-path) and per host.  Host means are shrunk to
   the global mean and path means to their host's, each by a prior strength estimated from the spread between groups
   (moments of a beta-binomial): a sparse site stays at its prior, a large one speaks for itself.
3. A document's final log-odds is its own plus `site_weight` times the log-odds its path (without the document itself)
   gains over the global mean.  The threshold is set over all labelled rows so that at most `max_loss` of the good ones
   are rejected; it is found by counting in the tasks.  No row counts there by weights that were fitted on it: the rows
   of the sample are scored by cross-fitting (FOLDS fits, each without the rows it scores), at every size alike.

Features are computed in Arrow batches; site tables hold one row per path; the join back lets Spark's adaptive planner
choose, so a large host splits.  Defined results: null text counts as empty; null hosts and paths form groups of their
own; null labels are ignored; repeated labels of a document count once each; without labels of both kinds in
the sample all documents are kept with score 0; a kind with one labelled document is unknown to the fit that scores it; an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_TABLE, arrow_append, discard, materialize

MARKS = b"!|#$%&*<>{}[]()=+/\\_-.,;:?\"'"
NAMES = ["log_chars", "upper", "lower", "digit", "space", "line", "high", "control", "word_len", "long_words", "caps_words"] + [f"mark_{c}" for c in MARKS]

#: Parts of the sample that are scored for the threshold by a fit on the other parts.
FOLDS = 4


def _classes() -> np.ndarray:
    """Class of each byte value."""
    table = np.full(256, 7, np.uint8)
    table[65:91], table[97:123], table[48:58], table[32], table[128:] = 1, 2, 3, 4, 6
    table[[10, 13]] = 5
    for i, c in enumerate(MARKS):
        table[c] = 8 + i
    return table


_TABLE = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(flat)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset: flat.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]] if n else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    kinds = 8 + len(MARKS)
    code = _TABLE[data]
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * kinds + code, minlength=n * kinds).reshape(n, kinds).astype(np.float64)
    white = (code == 4) | (code == 5)
    start = ~white & np.concatenate(([True], white[:-1])) if len(code) else white
    if len(code):
        start[offsets[:-1][size > 0]] = ~white[offsets[:-1][size > 0]]
    at = np.flatnonzero(start)
    words = np.bincount(row[at], minlength=n).astype(np.float64)
    caps = np.bincount(row[at], weights=(code[at] == 1) & (np.append(code, 0)[at + 1] == 1), minlength=n)
    long = np.bincount(row[at], weights=np.diff(np.append(at, len(code))) > 24, minlength=n)
    total, some = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    solid = size - counts[:, 4] - counts[:, 5]
    parts = [np.log1p(size), *(counts[:, [1, 2, 3, 4, 5, 6, 0 + 7]] / total).T, solid / some, long / some, caps / some, *(counts[:, 8:] / total).T]
    return np.stack(parts, axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method on standardised features; weights for raw features, intercept last."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def folds(ids: list[int], good: np.ndarray) -> np.ndarray:
    """The fold of each row: rows of one id stay together, and the ids of each kind are dealt out evenly as they come."""
    kind: dict[int, float] = {}
    for i, g in zip(ids, good):
        kind[i] = max(g, kind.get(i, 0.0))
    fold = {i: n % FOLDS for n, i in enumerate(sorted(kind, key=kind.get))}
    return np.array([fold[i] for i in ids])


def _posterior(total: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (strength * prior + total) / (strength + n)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def prior_strength(groups: DataFrame) -> float:
    """Beta-binomial prior strength from group sums (total, n): the between-group variance beyond sampling noise."""
    r = groups.agg(F.sum("n"), F.sum("total"), F.count(F.lit(1)), F.sum(F.col("total") * F.col("total") / F.col("n")), F.sum(F.col("n") * F.col("n"))).first()
    if not r[0] or r[2] < 2:
        return 10.0
    n, k, mean = float(r[0]), float(r[2]), float(r[1]) / float(r[0])
    noise = mean * (1 - mean)
    between = (float(r[3]) - n * mean * mean - (k - 1) * noise) / max(1e-9, n - float(r[4]) / n)
    return float(min(1e6, max(1.0, noise / between - 1))) if between > 1e-9 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality", max_train: int = 20_000, site_weight: float = 0.5,
             max_loss: float = 0.002) -> DataFrame:
    """docs with doc_logit, host_posterior, path_posterior, score (log-odds over the threshold) and accepted."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    outputs = ("doc_logit", "host_posterior", "path_posterior", "score", "accepted", "_host", "_path", "_x")
    keep = [c for c in docs.columns if c.lower() not in outputs]
    base = docs.select(*keep, host.cast("string").alias("_host"), path.cast("string").alias("_path"))
    as_list = T.StructField("_x", T.ArrayType(T.FloatType(), True))

    def arrays(batch):
        x = features(batch.column("_text"))
        flat = pa.array(x.astype(np.float32).ravel())
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)]

    light = materialize(arrow_append(base.select(F.col(id_col).alias("_id"), "_host", "_path", F.col(text_col).alias("_text")), [as_list], "_text", arrays, drop=()).drop("_text"), "quality-features")
    # a bounded sample of labelled rows: by hash of the id, so that no more than it travels; the limit only guards
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("_y"))
    labelled = known.count()
    drawn = known
    if labelled > max_train:
        drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * max_train / labelled))
    sample = light.join(drawn, "_id").select("_id", "_x", "_y", "_host", "_path").limit(max_train).collect()
    sample.sort(key=lambda r: (r["_id"] * 0x9E3779B97F4A7C15 % 2**64, r["_y"], r["_x"]))  # whatever the input's order was
    x = np.array([r["_x"] for r in sample], np.float64).reshape(len(sample), len(NAMES))
    y = np.array([r["_y"] for r in sample], np.float64)
    if not 0 < y.sum() < len(y):
        nothing = F.lit(0.0)
        return base.select(*keep, nothing.alias("doc_logit"), nothing.alias("host_posterior"), nothing.alias("path_posterior"), nothing.alias("score"), F.lit(True).alias("accepted"))
    weights, fold = fit_logistic(x, y), folds([r["_id"] for r in sample], y)
    each = np.array([fit_logistic(x[fold != k], y[fold != k]) for k in range(FOLDS)] + [weights])
    sample_ids, first = np.unique(np.array([r["_id"] for r in sample], np.int64), return_index=True)
    sample_folds = fold[first]

    def logit(batch):  # of the features as `light` holds them, so that the threshold meets the scores it was set on
        x = features(batch.column(text_col)).astype(np.float32).astype(np.float64)
        return [pa.array(np.clip(x @ weights[:-1] + weights[-1], -30, 30), pa.float64())]

    def light_logit(batch):
        flat = np.asarray(batch.column("_x").flatten(), np.float64).reshape(-1, len(NAMES))
        return [pa.array(np.clip(flat @ weights[:-1] + weights[-1], -30, 30), pa.float64())]

    value = T.StructField("doc_logit", T.DoubleType())

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("_path"), *light_logit(batch)], names=["_host", "_path", "doc_logit"])

    def crossed(batches):
        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column("_id").cast(pa.int64()), 0))
            at = np.minimum(np.searchsorted(sample_ids, ids), len(sample_ids) - 1)
            by = np.where(sample_ids[at] == ids, sample_folds[at], FOLDS)
            flat = np.asarray(batch.column("_x").flatten(), np.float64).reshape(-1, len(NAMES))
            held = np.clip(flat @ each[:, :-1].T + each[:, -1], -30, 30)[np.arange(len(ids)), by]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_host", "_path")), *light_logit(batch), pa.array(held)],
                                             names=["_id", "_host", "_path", "doc_logit", "held_logit"])

    p = 1 / (1 + F.exp(-F.col("doc_logit")))
    paths = materialize(light.mapInArrow(scored, "_host string, _path string, doc_logit double").groupBy("_host", "_path").agg(
        F.sum(p).alias("total"), F.count(F.lit(1)).cast("double").alias("n")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    whole = paths.agg(F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.5))).first()[0]
    host_k, path_k = prior_strength(hosts), prior_strength(paths)
    hosts = hosts.withColumn("host_posterior", _posterior(F.col("total"), F.col("n"), F.lit(whole), F.lit(host_k)))
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p._host").eqNullSafe(F.col("h._host"))).select(
        F.col("p._host").alias("_site_host"), F.col("p._path").alias("_site_path"), "p.total", "p.n", "h.host_posterior")
    if paths.count() <= SMALL_TABLE:
        sites = F.broadcast(sites)

    def combined(rows: DataFrame, carried: list[str], by: str = "doc_logit") -> DataFrame:
        own = 1 / (1 + F.exp(-F.col("doc_logit")))
        joined = rows.join(sites, F.col("_host").eqNullSafe(F.col("_site_host")) & F.col("_path").eqNullSafe(F.col("_site_path")))
        others = _posterior(F.greatest(F.col("total") - own, F.lit(0.0)), F.col("n") - 1, F.col("host_posterior"), F.lit(path_k))
        return joined.withColumn("path_posterior", others).withColumn(
            "score", F.col(by) + site_weight * (_logit(F.col("path_posterior")) - _logit(F.lit(whole)))).select(
            *carried, "doc_logit", "host_posterior", "path_posterior", "score")

    # the threshold, over every labelled row, by weights that did not see it
    row = T.StructType([light.schema[c] for c in ("_id", "_host", "_path")] + [value, T.StructField("held_logit", T.DoubleType())])
    judged = materialize(combined(light.mapInArrow(crossed, row).join(known, "_id"), ["_y"], "held_logit").select("score", "_y"), "quality-judged")
    threshold = calibrate(judged, max_loss)
    discard(light, judged)
    final = combined(arrow_append(base, [value], text_col, logit), keep)
    return final.withColumn("score", F.col("score") - threshold).withColumn("accepted", F.col("score") >= 0)


def ranked_score(scores: DataFrame, rank: int, low: float, high: float, cells: int = 4096) -> float:
    """The score with `rank` smaller ones (ties in any order) of a table within low..high, exactly.

    Each pass counts the rows of equal ranges of scores inside the tasks and goes on within the range that holds the rank.
    """
    while low < high:
        cell = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * cells), F.lit(cells - 1))
        found = scores.where(F.col("score").between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()  # at most `cells` rows
        for r in sorted(found, key=lambda r: r["cell"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def calibrate(judged: DataFrame, max_loss: float) -> float:
    """The threshold over all rows (score, _y): halfway between the kinds where they separate, else the lowest that loses at most max_loss of the good."""
    good = judged.where("_y")
    n, low, high = good.agg(F.count("score"), F.min("score"), F.max("score")).first()
    if not n:
        return float(judged.agg(F.greatest(F.max("score"), F.lit(0.0))).first()[0]) + 1.0
    floor = ranked_score(good, int(max_loss * n), low, high)
    below = judged.where(~F.col("_y") & (F.col("score") < F.lit(floor))).agg(F.max("score")).first()[0]
    return floor - 1.0 if below is None else (floor + below) / 2
