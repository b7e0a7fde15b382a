"""Operators that compare documents, against brute force on small tables with the edge cases of all of them."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import ann, exact_dedup, minhash_dedup, passages, suffix_array_dedup, suffix_tree_dedup
from strataline.llm.components import components

SCHEMA = "doc_id long, text string, bucket int, id string, band string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, shared passages, periodic texts."""
    r = random.Random(5)
    base = "".join(r.choice("ab c") for _ in range(400))
    out = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 300), (5, "é" * 60), (6, " ".join(["x"] * 100)), (7, "a b " * 100), (7, "a b " * 100), (8, "A B " * 100)]
    for i in range(10, 120):
        s = r.randrange(300)
        out.append((i, base[s: s + r.randrange(120)] + "".join(r.choice("abcd ") for _ in range(r.randrange(30))) + base[: r.randrange(90)]))
    words = [f"w{i}" for i in range(6)]
    for i in range(140, 190):
        out.append((i, " ".join(r.choice(words) for _ in range(r.randrange(60))) + " " + " ".join(words * 6)[: r.randrange(120)]))
    text = " ".join(f"t{r.randrange(500)}" for _ in range(200)).split()
    for i in range(200, 230):  # near copies
        copy = list(text)
        for _ in range(r.randrange(0, 18)):
            copy[r.randrange(len(copy))] = f"e{r.randrange(999)}"
        out.append((i, " ".join(copy)))
    r.shuffle(out)
    return out


def test_exact(spark, rows):
    lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for bucket_rows, hot_rows in ((1_024, 1_024), (3, 1)):
        got = exact_dedup.exact_dedup(frame(spark, rows), bucket_rows=bucket_rows, hot_rows=hot_rows).collect()
        assert len(got) == len(rows)
        for x in got:
            g = groups[lower(x["text"])]
            assert (x["keep_id"], x["group_size"], x["kept"]) == (max(g), len(g), x["doc_id"] == max(g))
            assert x["text_sha256"] == hashlib.sha256(lower(x["text"]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_index_directory(spark, rows):
    index = exact_dedup.build_index(frame(spark, rows), bucket_rows=3)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 3 and index.where("chain > 0 OR bytes IS NOT NULL").count() == 0
    keys = spark.createDataFrame([(i * 7919 * 10**12, 1) for i in range(-900, 900)], "key long, weight long")
    found = exact_dedup.directory(keys, 100)
    assert sum(2.0 ** -d for _, d in found) == 1.0 and len(found) > 8


def test_owners_chain_and_compare_bytes(spark, rows):
    """All keys collide: every text is told from the others by its bytes alone; hot keys take the combined way."""
    key = lambda text: F.octet_length(text).cast("long") % 3
    want = {(x["doc_id"], x["text"]): (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    for hot_rows in (1_000_000, 5):
        index = exact_dedup.build_index(frame(spark, rows), key=key, hot_rows=hot_rows)
        assert index.where("chain > 5").count() > 5 and index.select("bucket", "key").distinct().count() == 3
        got = exact_dedup.exact_dedup(frame(spark, rows), key=key, hot_rows=hot_rows).collect()
        assert len(got) == len(rows)
        assert all((x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) == want[x["doc_id"], x["text"]] for x in got)


def test_plan_goes_through_the_directory(spark, rows):
    found = exact_dedup.exact_dedup(frame(spark, rows), bucket_rows=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "Python" not in plan


def test_owners_hold_whole_buckets(spark, rows):
    parts = exact_dedup.build_index(frame(spark, rows), bucket_rows=3).withColumn("file", F.input_file_name()).groupBy("bucket").agg(F.countDistinct("file").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1


def brute_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = root(a), root(b)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, rows, k):
    want = brute_components(rows, k, 80)
    got = minhash_dedup.near_duplicates(frame(spark, rows), k=k).collect()
    assert len(got) == len(rows)
    assert [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got if (x["n_shingles"], x["component_id"]) != want[x["doc_id"]]] == []
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_near_links_of_one_shared_band(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LOOKUP", 3)
    items = lambda *x: np.array(x, np.uint32).tobytes()
    rows = [  # 1-2: equal sets; 3-4: half of the hashes collide within each set; 5: too small; all share band 7 alone
        (7, 1, 5, [7, 11], 1, items(1, 2, 3, 4, 5)), (7, 2, 5, [7, 12], 2, items(1, 2, 3, 4, 5)),
        (7, 3, 10, [7, 13], 3, items(20, 21, 22, 23, 24)), (7, 4, 10, [7, 14], 4, items(20, 21, 22, 23, 24)), (7, 5, 3, [7, 15], 5, items(1, 2, 3)),
    ]
    members = spark.createDataFrame(rows, "band long, id long, n long, bands array<long>, part long, items binary")
    for block in (2_000, 1):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        assert {(x["a"], x["b"], x["pa"], x["pb"]) for x in minhash_dedup.cross_links(members.select("band", "id", "part", "n"), members.select("id", "bands", "items"), 80).collect()} == {(2, 1, 2, 1), (4, 3, 4, 3)}


def test_blocks_of_one_large_part_do_not_meet(spark, monkeypatch):
    """Each member meets the blocks of other parts alone; every pair of different parts meets exactly once."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 10)
    sets = [np.arange(i * 50, i * 50 + 20, dtype=np.uint32) for i in range(3)]
    rows = [(7, i, 20, [7], 0 if i < 95 else i, sets[0 if i < 95 else 0 if i in (97, 98) else 1 + i % 2].tobytes()) for i in range(100)]
    members = spark.createDataFrame(rows, "band long, id long, n long, bands array<long>, part long, items binary")
    got = [(x["a"], x["b"]) for x in minhash_dedup.cross_links(members.select("band", "id", "part", "n"), members.select("id", "bands", "items"), 80).collect()]
    want = {(a, b) for a in range(100) for b in range(a) if rows[a][4] != rows[b][4] and rows[a][5] == rows[b][5]}
    assert set(got) == want and len(got) == len(want)


def test_near_with_repeated_ids_of_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, b), (5, "else where")]
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash_dedup.near_duplicates(frame(spark, rows), k=2).collect())
    assert got == [(1, 29, 1, True), (1, 29, 1, True), (2, 30, 1, False), (3, 30, 1, False), (4, 29, 1, False), (5, 1, 5, True)]


def test_near_edges(spark):
    got = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c"), (1, "a b c"), (2, " \n"), (3, None)]), k=2).collect()
    assert {(x["doc_id"], x["component_id"], x["kept"]) for x in got} == {(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True)}
    assert minhash_dedup.near_duplicates(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_blocks_lose_no_pair(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    want = brute_components(rows, 2, 80)
    got = minhash_dedup.near_duplicates(frame(spark, rows), k=2).collect()
    assert all((x["n_shingles"], x["component_id"]) == want[x["doc_id"]] for x in got)


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    error = []
    for _ in range(60):
        a = r.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate((a[: r.integers(0, 400)], r.integers(0, 2**63, 200).astype(np.uint64)))
        s = minhash_dedup.sketch(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)))
        assert (s != np.iinfo(np.uint64).max).all()
        both = len(np.intersect1d(a, b))
        error.append((s[0] == s[1]).mean() - both / (len(a) + len(b) - both))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05
    assert (minhash_dedup.sketch(np.array([0, 1]), np.array([5], np.uint64)) != np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)] + [(300, x) for x in range(301, 330)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[201] == 200 and got[329] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s: s + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if first[b[s: s + length]] < i:
                mask[s: s + length] = True
        spans = int((mask[1:] & ~mask[:-1]).sum() + mask[0])
        out.setdefault(i, set()).add((len(b), int(mask.sum()), spans, hashlib.sha256(bytes(c for c, x in zip(b, mask) if not x)).hexdigest()))
    return out


def test_bytes(spark, rows):
    want = brute_bytes(rows)
    got = suffix_array_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all((x["n"], x["n_removed"], x["n_spans"], x["kept_sha256"]) in want[x["id"]] for x in got)
    assert sum(x["n_removed"] for x in got) > 1000
    assert suffix_array_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def brute_words(rows, length=20):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - length + 1):
            key = tuple(w[s: s + length])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        mask = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s: s + length])] < (i, s):
                mask[s: s + length] = True
        out.setdefault(i, set()).add((len(w), int(mask.sum()), hashlib.sha256(b" ".join(c for c, x in zip(w, mask) if not x)).hexdigest()))
    return out


def test_words(spark, rows):
    want = brute_words(rows)
    got = suffix_tree_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all((x["n"], x["n_removed"], x["kept_sha256"]) in want[x["id"]] for x in got)
    assert sum(x["n_removed"] for x in got) > 500
    assert suffix_tree_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("operator,brute,n", [(suffix_array_dedup, brute_bytes, 4), (suffix_tree_dedup, brute_words, 3)])
def test_hot_anchors_and_passes_lose_nothing(spark, rows, monkeypatch, operator, brute, n):
    """Every window by itself, and owners that unpack a few runs at a time."""
    for name, size in (("HOT_CONTEXTS", 3), ("PASS_RUNS", 50), ("PASS_WINDOWS", 40)):
        monkeypatch.setattr(passages, name, size)
    want = brute(rows)
    got = operator.remove_repeats(frame(spark, rows)).collect()
    columns = ("n", "n_removed", "n_spans", "kept_sha256") if n == 4 else ("n", "n_removed", "kept_sha256")
    assert len(got) == len(rows) and all(tuple(x[c] for c in columns) in want[x["id"]] for x in got)


def test_hash_collisions_are_settled_by_bytes(rows, monkeypatch):
    """All hashes agree: bytes alone tell strings apart."""
    monkeypatch.setattr(suffix_array_dedup, "prefix_hashes", lambda symbols, pw: np.zeros(len(symbols) + 1, np.uint64))
    texts = [(i, t.encode()) for i, t in rows if t and len(t) >= 50]
    ids, span = np.array([i for i, _ in texts]), np.array([len(t) - 49 for _, t in texts])
    flags = suffix_array_dedup.match([t for _, t in texts], np.zeros(len(texts), np.uint64), ids, np.zeros(len(texts), np.int64), span)
    first = {}
    for i, t in texts:
        for s in range(len(t) - 49):
            first[t[s: s + 50]] = min(first.get(t[s: s + 50], i), i)
    assert flags.tolist() == [first[t[s: s + 50]] < i for i, t in texts for s in range(len(t) - 49)]


def test_matchers_on_their_own(rows):
    texts = [(i, t.encode()) for i, t in rows if t and len(t) >= 50]
    ids, span = np.array([i for i, _ in texts]), np.array([len(t) - 49 for _, t in texts])
    flags = suffix_array_dedup.match([t for _, t in texts], np.zeros(len(texts), np.uint64), ids, np.zeros(len(texts), np.int64), span)
    first = {}
    for i, t in texts:
        for s in range(len(t) - 49):
            first[t[s: s + 50]] = min(first.get(t[s: s + 50], i), i)
    assert flags.tolist() == [first[t[s: s + 50]] < i for i, t in texts for s in range(len(t) - 49)]
    words = [(i, t.encode()) for i, t in rows if t and len(t.split()) >= 20]
    span = np.array([len(t.split()) - 19 for _, t in words])
    whole = suffix_tree_dedup.match([t for _, t in words], span, np.array([i for i, _ in words]), np.zeros(len(words), np.int64), span)
    small = suffix_tree_dedup.match([t for _, t in words], span, np.array([i for i, _ in words]), np.zeros(len(words), np.int64), span, limit=50)
    assert whole.tolist() == small.tolist() and whole.any()


def test_packing():
    a, b = np.array([5, 2**63], np.uint64), np.array([True, False])
    x, y = passages.unpack(passages.pack(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and y.dtype == bool
    assert passages.merged([(5, 9), (1, 3), (3, 4), (6, 7)]) == [(1, 4), (5, 9)]


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 24)).astype(np.float32) * r.uniform(0.2, 3, (3000, 1)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0] * 3), (5080, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.query(ann.build_index(df, shard=500), df.where("vec_id % 20 == 0")).collect()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    recall, by = [], {}
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert sorted(by) == list(range(0, 3000, 20))
    for q, found in by.items():
        found.sort()
        order = [i for i in np.lexsort((np.arange(3000), -exact[q])) if i != q][:20]
        recall.append(len(set(order) & {v for _, v, _ in found}) / 20)
        assert [k for k, *_ in found] == list(range(1, 21)) and all(abs(s - exact[q, v]) < 1e-9 for _, v, s in found)
    assert np.mean(recall) >= 0.95
    assert [v for _, v, _ in by[100]][:20] == sorted([v for _, v, _ in by[100]][:20]) or len({s for *_, s in by[100]}) > 1


def recall_of(got, x, ids, k=20):
    """Share of the exact neighbours found, of all queries; scores and ranks are checked on the way."""
    x = np.asarray(x, np.float64)
    by, place, recall = {}, {int(i): n for n, i in enumerate(ids)}, []
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    for q, found in by.items():
        exact = x @ x[place[q]]
        found.sort()
        order = [i for i in np.lexsort((ids, -exact)) if ids[i] != q][:k]
        recall.append(len({int(ids[i]) for i in order} & {v for _, v, _ in found}) / len(order))
        assert [r for r, *_ in found] == list(range(1, len(order) + 1)) and all(abs(s - exact[place[v]]) < 1e-12 for _, v, s in found)
    return np.mean(recall), sorted(by)


def test_routed_neighbours_over_many_shards(spark):
    """Clustered vectors as in the embeddings table, norms apart, doubles; twenty shards and fewer probes than cells."""
    r = np.random.default_rng(8)
    centre = r.standard_normal((40, 32))
    x = (centre[r.integers(0, 40, 8000)] + 0.3 * r.standard_normal((8000, 32))) * r.uniform(0.5, 1.5, (8000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    index = ann.build_index(df, shard=400)
    assert index.shards.sum() >= 20 and index.graphs.count() == index.shards.sum() and index.probes < len(index.centroids)
    recall, asked = recall_of(ann.query(index, df.where("vec_id % 20 = 0")).collect(), x, np.arange(8000))
    assert recall >= 0.95 and asked == list(range(0, 8000, 20))


def test_neighbours_of_the_embeddings_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x, ids = (np.array(c) for c in zip(*[(r["embedding"], r["vec_id"]) for r in rows.orderBy("vec_id").collect()]))
    recall, asked = recall_of(ann.query(ann.build_index(rows, shard=150), rows.where("vec_id % 20 = 0")).collect(), x, ids)
    assert recall >= 0.95 and asked == [i for i in ids.tolist() if i % 20 == 0]


def test_neighbours_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 2)  # many copies of a shard
    one, two = [1.0, 0.1234567890123456], [0.3, 0.7]
    rows = [(0, one), (0, one), (0, two), (1, one), (2, two), (20, two), (40, [1.0, 2.0, 3.0]), (None, one), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.query(ann.build_index(df), df.where("vec_id % 20 = 0"), k=3).collect()
    assert sorted((g["query_id"], g["rank"], g["vec_id"]) for g in got) == [(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 2, 20), (0, 3, 1), (0, 3, 20), (20, 1, 0), (20, 2, 2), (20, 3, 0)]
    assert max(g["score"] for g in got) == one[0] * one[0] + one[1] * one[1]  # doubles stay doubles
    # queries of which most have another length: those of the index's length are answered
    other = spark.createDataFrame([(100, [1.0, 2.0, 3.0]), (120, [1.0, 2.0, 3.0]), (140, one)], "vec_id long, embedding array<double>")
    assert {g["query_id"] for g in ann.query(ann.build_index(df), other).collect()} == {140}
    assert ann.query(ann.build_index(df), other.limit(0)).count() == 0


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.query(ann.build_index(df), df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(g["query_id"], g["vec_id"]) for g in got] == [(0, 20), (0, 1), (0, 2), (20, 0), (20, 1), (20, 2)]
    assert ann.query(ann.build_index(df.limit(0)), df.limit(0)).count() == 0
