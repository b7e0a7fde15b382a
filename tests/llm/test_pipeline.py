"""The pipeline stage by stage against brute force on a small table, and every stage on odd tables."""

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_dedup_operators import brute_components
from test_text_operators import brute_mix, brute_quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strataline.llm.queries import DOMAINS, MIX, tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows, labels):
    """The ids that every stage keeps.  rows: {id: (text, lang, source)}."""
    kept = {}
    scores = brute_quality([(i, t, s, lang) for i, (t, lang, s) in sorted(rows.items())], labels)
    now = kept["quality"] = {i for i in rows if scores[i][3] >= 0}
    best = {}
    for i in now:
        key = (rows[i][0] or "").encode().lower()
        best[key] = max(best.get(key, i), i)
    now = kept["exact dedup"] = set(best.values())
    classes = brute_components([(i, rows[i][0]) for i in now], 5, 80)
    now = kept["near dedup"] = {i for i in now if classes[i][1] == i}
    domain = {s: d for d, names in DOMAINS.items() for s in names}
    tokens = lambda t: 0 if not t else sum(c in " \t\n\r\x0b\x0c" for c in t) + 1
    mixed = [(i, domain.get(rows[i][2], "other"), rows[i][1], rows[i][2], tokens(rows[i][0])) for i in now]
    copies = brute_mix(mixed, MIX, int(sum(x[4] for x in mixed) * 0.9), 1, 17)
    kept["mixing"] = {i for i in now if copies[i][1] > 0}
    return kept


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in docs.collect()}
    labels = {r["doc_id"]: int(r["quality"] > 0) for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").collect()}
    want, now = brute(rows, labels), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        found = [r["doc_id"] for r in now.collect()]
        assert sorted(found) == sorted(want[name]), name
        now = docs.where(F.col("doc_id").isin(found))
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == want["mixing"]
    assert all(r["ids"] == model.encode(rows[r["doc_id"]][0] or "", add_eos=True) and r["decoded"] == model.decode(r["ids"]) for r in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, KEPT int, score string, copies string, level_0 string, class string, ids string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows, one id with two texts, clashing columns."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "src0"), (2, words + " end", "en", "src0"), (3, words.upper(), "en", "src1"), (4, None, None, None), (5, "", "de", "src12"), (5, "", "de", "src12"),
            (6, "long " * 40_000, "fr", "src17"), (None, words, "en", "src0"), (None, None, None, None), (7, "one text of id seven that stands alone", "es", "src3"), (7, words + " other", "en", "src0"), (8, " \n\t ", "en", "x")]
    out = str(tmp_path_factory.mktemp("odd"))
    made = [(i, t, lang, s, len(t or ""), "k", 1, "s", "c", "l", "x", "i") for i, t, lang, s in rows]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    return out


def kept(stage, spark, docs, sf):
    out = stage(spark, docs, sf)
    return out, sorted(((r["doc_id"], (r["text"] or "")[:60].strip()) for r in out.collect()), key=str)


def test_stages_on_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, rows = kept(stage, spark, docs, odd)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), odd).count() == 0, name
    every = kept(lambda spark, d, sf: d, spark, docs, odd)[1]
    exact = kept(corpus_pipeline.exact_stage, spark, docs, odd)[1]
    # of equal texts the largest id, 3 for the words; both equal rows of 5 tie for the empty texts, null ids come last
    assert [i for i, _ in exact] == [2, 3, 5, 5, 6, 7, 7, 8]
    near = kept(corpus_pipeline.near_stage, spark, docs, odd)[1]
    # 1, 2, 3 and one text of 7 are near copies: 1 stays; the other text of 7 stays; null ids are linked with nothing
    assert near == [r for r in every if r[0] not in (2, 3) and not (r[0] == 7 and r[1].startswith("word"))]
    mixed = kept(corpus_pipeline.mixing_stage, spark, docs, odd)[1]
    assert set(mixed) <= set(every) and all(mixed.count(r) in (0, every.count(r)) for r in every)
    out = corpus_pipeline.encoding_stage(spark, docs, odd).collect()
    assert len(out) == len(every) and all(r["ids"][-1] == 2 for r in out) and sum(r["decoded"] == "" for r in out) >= 4
    assert corpus_pipeline.encoding_stage(spark, docs.limit(0), odd).count() == 0
    labels_gone = spark.read.parquet(f"{odd}/labels.parquet").limit(0)
    assert corpus_pipeline.quality.classify(docs, labels_gone).where("accepted").count() == docs.count()
