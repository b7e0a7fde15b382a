"""The queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, html_extract, minhash_dedup, quality, secret_scan, sentencepiece_codec, source_mixing, suffix_array_dedup, suffix_tree_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The mix: which sources make up a domain, and the target weights per level of the tree.
DOMAINS = {"web": [f"src{i}" for i in range(10)], "books": [f"src{i}" for i in range(10, 16)], "reference": [f"src{i}" for i in range(16, 20)]}
MIX = {"domain": {"web": 0.45, "books": 0.35, "reference": 0.2}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode_decode(docs, tokenizer())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_array_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return source_mixing.mix(docs, MIX, domains=DOMAINS).select("doc_id", "lang", "source", "n_tokens", "leaf_budget", "copies")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_tree_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.build_index(vectors)
    return ann.query(index, vectors.where(F.col("vec_id") % 20 == 0)).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "doc_logit", "host_posterior", "path_posterior", "score", "accepted")


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_html_extraction, op3_minhash_near_dedup, op4_secret_scan, op5_exact_dedup, op6_suffix_array_dedup, op7_source_mixing,
    op8_substring_dedup, op9_nearest_neighbours, op10_quality_classifier)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(d, r) AS (SELECT a, a FROM edges UNION SELECT reach.d, edges.b FROM reach JOIN edges ON reach.r = edges.a),
        part AS (SELECT d, min(r) AS c FROM reach GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(part.c, d.doc_id) AS component_id, coalesce(part.c, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN part ON part.d = d.doc_id""",
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_FOLD} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op6_suffix_array_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM h)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
        e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f),
        r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
        x AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY 1, 2),
        y AS (SELECT doc_id, list_sort(list({'a': a, 'b': b})) AS cut FROM x GROUP BY 1),
        k AS (SELECT h.doc_id, h.h, coalesce(y.cut, []) AS cut FROM h LEFT JOIN y USING (doc_id))
        SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(list_sum(list_transform(cut, lambda z: z.b - z.a)), 0) AS BIGINT) AS n_removed, CAST(len(cut) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN len(cut) = 0 THEN h ELSE array_to_string(list_transform(range(0, len(cut) + 1), lambda q:
                substr(h, 2 * (CASE WHEN q = 0 THEN 0 ELSE cut[q].b END) + 1, 2 * ((CASE WHEN q = len(cut) THEN len(h) // 2 ELSE cut[q + 1].a END) - (CASE WHEN q = 0 THEN 0 ELSE cut[q].b END)))), '') END)) AS kept_sha256
        FROM k""",
    "op8_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM w)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f),
        m AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1),
        k AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN c USING (doc_id, i)),
        t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM k GROUP BY 1)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(m.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
        FROM w LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
