"""Artifact and vector catalogs, and similarity search whose results re-enter as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import visible
from ..functions.similarity import cosine, dot
from ..model import EngineError, Scope

ARTIFACT = "sidecar_id string, artifact_id string, entity long, uri string, media_type string, byte_length long, digest string, metadata map<string,string>, registered_at long, policy struct<capabilities:array<string>,visibilities:array<string>>"
VECTOR = "sidecar_id string, vector_id string, entity long, source_artifact_id string, embedding_ref string, dimensions int, metric string, embedding array<float>, metadata map<string,string>, registered_at long, policy struct<capabilities:array<string>,visibilities:array<string>>"


def register_errors(records: DataFrame, catalog: DataFrame, tail: int, id_col: str, artifacts: DataFrame | None = None) -> DataFrame:
    """(id, code) of records that may not be registered: late anchors, used anchors or ids, wrong dimensions, later artifacts."""
    rows = records.select(F.col(id_col).alias("id"), "*")
    out = rows.where(F.col("registered_at") != tail).select("id", F.lit("NotAtTail").alias("code"))
    out = out.union(rows.join(catalog.select("registered_at"), "registered_at", "left_semi").select("id", F.lit("AnchorUsed").alias("code")))
    out = out.union(rows.join(catalog.select(id_col), id_col, "left_semi").select("id", F.lit("DuplicateId").alias("code")))
    out = out.union(rows.groupBy("id").count().where("count > 1").select("id", F.lit("DuplicateId").alias("code")))
    out = out.union(rows.groupBy("registered_at").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n > 1").select("id", F.lit("AnchorUsed").alias("code")))
    if "dimensions" in records.columns:
        out = out.union(rows.where(F.size("embedding") != F.col("dimensions")).select("id", F.lit("Dimensions").alias("code")))
    if artifacts is not None:
        known = artifacts.select(F.col("artifact_id").alias("source_artifact_id"), F.col("registered_at").alias("a"))
        joined = rows.where(F.col("source_artifact_id").isNotNull()).join(known, "source_artifact_id", "left")
        out = out.union(joined.where(F.col("a").isNull() | (F.col("a") > F.col("registered_at"))).select("id", F.lit("ArtifactOrder").alias("code")))
    return out.distinct()


class Sidecar:
    """The artifact and vector catalogs of one sidecar, as tables under a folder; records are appended or refused as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def artifacts(self) -> DataFrame:
        return self._table("artifacts", ARTIFACT)

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTOR)

    def _append(self, records: DataFrame, name: str, schema: str, faults: DataFrame) -> None:
        bad = faults.take(20)
        if bad:
            raise EngineError("RegistrationRefused", str([r.asDict() for r in bad]))
        names = [c.split()[0] for c in schema.split(", ")]
        records.select(*names).write.mode("append").parquet(f"{self.path}/{name}")

    def register_artifacts(self, records: DataFrame, tail: int) -> None:
        used = self.artifacts.select("artifact_id", "registered_at").unionByName(self.vectors.select(F.lit(None).cast("string").alias("artifact_id"), "registered_at"))
        self._append(records, "artifacts", ARTIFACT, register_errors(records, used, tail, "artifact_id"))

    def register_vectors(self, records: DataFrame, tail: int) -> None:
        used = self.vectors.select("vector_id", "registered_at").unionByName(self.artifacts.select(F.lit(None).cast("string").alias("vector_id"), "registered_at"))
        self._append(records, "vectors", VECTOR, register_errors(records, used, tail, "vector_id", self.artifacts))


def artifact(catalog: DataFrame, artifact_id: str, scope: Scope) -> dict:
    """One artifact; a hidden one is unknown."""
    row = catalog.where(F.col("artifact_id") == artifact_id).where(visible(F.col("policy.capabilities"), F.col("policy.visibilities"), scope)).first()
    if row is None:
        raise EngineError("UnknownArtifact", artifact_id)
    return row.asDict(recursive=True)


def search(vectors: DataFrame, artifacts: DataFrame | None, query: list[float], *, sidecar: str, metric: str = "cosine", top_k: int = 10, scope: Scope = Scope(), journal: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
    """The nearest visible vectors: score desc, vector_id asc; the matching artifact, if visible, beside them.

    Filters run before scoring, and the ordered limit keeps k rows per task: nothing else is shuffled.
    """
    seen = lambda df: df.where(visible(F.col("policy.capabilities"), F.col("policy.visibilities"), scope))
    rows = seen(vectors).where((F.col("sidecar_id") == sidecar) & (F.col("metric") == metric) & (F.col("dimensions") == len(query)))
    if journal is not None:
        places = journal.select(F.col("element").alias("registered_at"), F.col("seq").alias("anchor_seq"))
        rows = rows.join(places, "registered_at", "left")
        lost = rows.where(F.col("anchor_seq").isNull()).first()
        if lost is not None:
            raise EngineError("UnavailableAnchor", f"{lost['vector_id']} at element {lost['registered_at']}")
        if as_of is not None:
            limit = journal.where(F.col("element") == as_of).agg(F.min("seq")).first()[0]
            if limit is None:
                raise EngineError("UnknownElement", f"element {as_of}")
            rows = rows.where(F.col("anchor_seq") <= limit)
    measure = {"cosine": cosine, "dot": dot}[metric]
    asked = F.array(*[F.lit(float(x)) for x in query])
    if artifacts is not None:
        mine = seen(artifacts).where(F.col("sidecar_id") == sidecar).select(F.col("artifact_id").alias("source_artifact_id"), "uri", F.col("registered_at").alias("artifact_at"), F.col("policy").alias("artifact_policy"), F.lit(True).alias("_there"))
        rows = rows.join(mine, "source_artifact_id", "left").where(F.col("source_artifact_id").isNull() | F.col("_there")).drop("_there")
    return rows.withColumn("score", measure(F.col("embedding"), asked)).orderBy(F.desc("score"), "vector_id").limit(max(top_k, 1))


def as_facts(matches: DataFrame, query_entity: int) -> DataFrame:
    """(query entity, entity, score) with sources and policy, to be bound to a predicate of three fields."""
    none = F.array().cast("array<string>")
    source = F.array_compact(F.array("registered_at", "artifact_at")) if "artifact_at" in matches.columns else F.array("registered_at")
    return matches.select(
        F.lit(query_entity).cast("long").alias("c0"), F.col("entity").alias("c1"), "score", source.alias("_src"),
        F.coalesce("policy.capabilities", none).alias("_caps"), F.coalesce("policy.visibilities", none).alias("_vis")).withColumnRenamed("score", "c2")
