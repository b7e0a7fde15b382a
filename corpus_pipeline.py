"""From raw documents to token ids: quality, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's rows as Parquet in the shared folder and reads them again for the next; tables that no later
stage reads are deleted.

In every stage: null texts count as empty; an empty table gives an empty table; columns beyond those of documents pass
through, whatever their names (the last stage drops them); very long texts are read whole; equal rows are kept or dropped
together, so a table that repeats a row goes on repeating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import exact_dedup, minhash_dedup, quality, sentencepiece_codec, source_mixing
from strataline.llm.common import discard, materialize
from strataline.llm.queries import DOMAINS, MIX, tokenizer


#: The columns of documents that operators read; others travel under names that clash with nothing.
READ = ("doc_id", "text", "lang", "source")


def aside(docs: DataFrame) -> DataFrame:
    """docs with its other columns renamed."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"_other_{i}") for i, c in enumerate(docs.columns)])


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, under their names and in their order."""
    return rows.select(*[F.col(c if c in READ else f"_other_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them where labels do not hold both kinds.  Null sources and languages are sites of their own."""
    return back(quality.classify(aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("accepted"), docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest doc_id; rows tied on it all stay, null ids come last."""
    return back(exact_dedup.exact_dedup(aside(docs)).where("kept"), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Texts without words and rows with a null id are copies of nothing; different texts of one id are judged apart.
    """
    classes = minhash_dedup.near_duplicates(docs, k=5, percent=80)
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of one seeded epoch, by hierarchical budgets over nine tenths of the tokens; null levels are leaves of their own."""
    return back(source_mixing.mix(aside(docs), MIX, domains=DOMAINS, budget_share=0.9, max_epochs=1).where("copies > 0"), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (end id last; alone for an empty text) and the text decoded from them, for every row."""
    return sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), tokenizer()).select("doc_id", "ids", "decoded")


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier's fit and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the whole documents table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, rows = rows, stage(spark, rows, sf_dir)
        if i + 1 < len(STAGES):
            rows = materialize(rows, f"stage-{i}")
            if i:
                discard(before)
    return rows
