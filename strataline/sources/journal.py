"""The append-only journal: a directory of Parquet files with an explicit, monotone seq; admission, receipts, schemas.

An append writes its batch to a directory of its own and then its receipt, which names that directory: readers read the
batches that receipts name.  A batch without receipt (a lost driver) is not part of the journal and in nobody's way.
Receipt n is put in place by a rename that fails if there is one, so of two drivers that append at once one is refused.
The cost of an append follows its batch: the cut comes from the last receipt, whose digest adds up over rows; of the
history only elements within the range that the batch mentions, and the entities that it touches, are read.
Joins of rows with rows ask for a sort-merge: Spark estimates a table by its files, which are a small part of what its rows
take in memory, and would broadcast millions of rows by way of the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import contains
from ..model import CLEARS, SETS, Attribute, AttributeClass, EngineError, Schema, Type
from ..operators.replay import VALUE, prefix, sequences, state
from ..storage import Documents
from ..storage import numbered as placed

# The fields of a stored row.
PROVENANCE = "struct<author_principal:string,agent_id:string,tool_id:string,session_id:string,source_ref:struct<uri:string,digest:string>,parent_datom_ids:array<long>,confidence:float,trust_domain:string,schema_version:string>"
POLICY = "struct<capabilities:array<string>,visibilities:array<string>>"
DATOM = f"entity long, attribute long, value {VALUE}, op string, element long, replica long, frontier array<long>, provenance {PROVENANCE}, policy {POLICY}"
JOURNAL = "seq long, " + DATOM
RECEIPT = "batch long, path string, first_seq long, rows long, entry_count long, last_element long, marks string, digest string, schema_ref string, idempotency_key string, request_digest string"


def value(tag: str, content) -> dict | None:
    """One tagged value."""
    field = {"Bool": "b", "I64": "i", "U64": "i", "Entity": "i", "F64": "f", "String": "s", "Bytes": "x", "List": "items"}
    if tag == "Null":
        return {"tag": "Null"}
    if tag == "U64" and content >= 2**63:
        raise EngineError("U64Range", f"{content} does not fit a long")
    return {"tag": tag, field[tag]: [json.dumps(c) for c in content] if tag == "List" else content}


def datom(entity: int, attribute: int, tag: str, content, op: str, element: int, *, parents=(), policy=None, replica: int = 1, **provenance) -> dict:
    return {"entity": entity, "attribute": attribute, "value": value(tag, content), "op": op, "element": element, "replica": replica, "frontier": [],
            "provenance": {"parent_datom_ids": list(parents), "confidence": 1.0, **provenance}, "policy": policy}


def datoms(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(DATOM))


def numbered(rows: DataFrame, first: int = 1) -> DataFrame:
    """Rows with seq in input order, as a written table."""
    names = [f.name for f in T._parse_datatype_string(DATOM).fields]
    table, _ = placed(rows.select(*[c for c in names if c in rows.columns]), "batch")
    return table.select((F.col("_n") + first).alias("seq"), *[c for c in names if c in rows.columns])


def marks(rows: DataFrame, first: int = 0):
    """A number per row that depends on all its columns (seq counted from `first`); whatever order lists of a policy are written in."""
    policy = F.when(F.col("policy").isNotNull(), F.struct(*[F.array_sort(F.array_distinct(F.coalesce(f"policy.{c}", F.array().cast("array<string>")))).alias(c) for c in ("capabilities", "visibilities")]))
    own = {"policy": policy.alias("policy"), "seq": (F.col("seq") - first).alias("seq")}
    columns = [own.get(c, F.col(c)) for c in sorted(rows.columns) if c in {f.split()[0] for f in JOURNAL.split(", ")}]
    return F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")


def _digest(total, count) -> str:
    return hashlib.sha256(f"{total}|{count}".encode()).hexdigest()


def cut(journal: DataFrame) -> DataFrame:
    """Reference of a prefix: last element, row count and a digest of all columns that does not depend on partitioning."""
    total = F.coalesce(F.sum(marks(journal)), F.lit(0)).cast("string")
    return journal.agg(F.max_by("element", "seq").alias("last_element"), F.count(F.lit(1)).alias("entry_count"), total.alias("marks")).select(
        "last_element", "entry_count", F.sha2(F.concat_ws("|", "marks", F.col("entry_count").cast("string")), 256).alias("digest"))


def append_errors(rows: DataFrame, history: DataFrame, schema: Schema, schema_ref: str | None = None) -> DataFrame:
    """(element, code) of every violation in a batch; empty when it may be appended.  Commits nothing."""
    code = F.lit("UnknownAttribute")
    for a in schema.attributes.values():
        tag = "List" if a.type.item else a.type.name
        fault = F.when(F.col("value").isNull() | F.col("value.tag").isNull() | (F.col("value.tag") == "Null"), "NullValue").when(
            F.col("value.tag") != tag, "ValueType").when((F.col("value.tag") == "F64") & (F.isnan("value.f") | (F.abs("value.f") == float("inf"))), "NonFiniteFloat").when(
            ~F.col("op").isin(*SETS[a.cls], *CLEARS[a.cls]), "InvalidOperation")
        code = F.when(F.col("attribute") == a.id, fault).otherwise(code)
    confidence = F.col("provenance.confidence")
    per_row = [code, F.when(confidence.isNull() | ~confidence.between(0.0, 1.0), "Confidence")]
    if schema_ref is not None:
        blank = lambda c: F.length(F.trim(F.coalesce(F.col(f"provenance.{c}"), F.lit("")))) == 0
        per_row += [F.when(~F.col("provenance.schema_version").eqNullSafe(F.lit(schema_ref)), "SchemaVersion"),
                    F.when(blank("author_principal") | blank("tool_id") | blank("session_id") | blank("trust_domain"), "IncompleteProvenance")]
    own = reduce(DataFrame.union, [rows.select("element", fault.alias("code")).where("code IS NOT NULL") for fault in per_row])
    twice = rows.groupBy("element").count().where("count > 1").select("element", F.lit("DuplicateInBatch").alias("code"))
    known = rows.join(history.select("element").distinct().hint("merge"), "element", "left_semi").select("element", F.lit("DuplicateElement").alias("code"))
    return own.union(twice).union(known).distinct()


def dependency_errors(journal: DataFrame, schema: Schema, children: DataFrame | None = None) -> DataFrame:
    """(element, dependency, code): parents, frontiers and anchors must exist, come before and be no more restricted.

    Of all rows, or of `children` among them; `journal` then needs to hold only what they may depend on.
    """
    sequences = [a.id for a in schema.attributes.values() if a.cls == AttributeClass.SEQUENCE] or [-1]
    insert = F.col("attribute").isin(sequences) & (F.col("op") == "InsertAfter")
    parents = F.coalesce("provenance.parent_datom_ids", F.array().cast("array<long>"))
    rows = (journal if children is None else children).select("seq", "element", "entity", "attribute", "policy", insert.alias("insert"), parents.alias("parents"), F.coalesce("frontier", F.array().cast("array<long>")).alias("frontier"))
    edges = rows.select("*", F.explode(F.array_distinct(F.concat("parents", "frontier"))).alias("dependency"))
    known = journal.select(F.col("element").alias("dependency"), F.col("seq").alias("d_seq"), F.col("entity").alias("d_entity"), F.col("attribute").alias("d_attribute"), F.col("policy").alias("d_policy"),
                           (F.col("attribute").isin(sequences) & (F.col("op") == "InsertAfter")).alias("d_insert"))
    anchor = F.col("insert") & F.array_contains("parents", F.col("dependency"))
    found = edges.join(known.hint("merge"), "dependency", "left")
    code = F.when(F.col("d_seq").isNull(), "Missing").when(F.col("d_seq") >= F.col("seq"), "Forward").when(
        ~(contains(F.col("d_policy.capabilities"), F.col("policy.capabilities")) & contains(F.col("d_policy.visibilities"), F.col("policy.visibilities"))), "PolicyNotClosed").when(
        anchor & ((F.col("d_entity") != F.col("entity")) | (F.col("d_attribute") != F.col("attribute")) | ~F.col("d_insert")), "InvalidSequenceAnchor")
    by_edge = found.select("element", "dependency", code.alias("code")).where("code IS NOT NULL")
    first = journal.select("seq", "entity", "attribute", insert.alias("insert")).where("insert").groupBy("entity", "attribute").agg(F.min("seq").alias("first"))
    single = rows.where("insert").join(first.hint("merge"), ["entity", "attribute"]).select("element", F.lit(None).cast("long").alias("dependency"), F.when(
        F.size("parents") > 1, "MalformedSequenceAnchor").when((F.size("parents") == 0) & (F.col("seq") > F.col("first")), "MissingSequenceAnchor").alias("code")).where("code IS NOT NULL")
    return by_edge.union(single).distinct().orderBy("element", "dependency", "code")


def inferred(journal: DataFrame) -> DataFrame:
    """Class and type of attributes that no schema declares, from their operations and first values."""
    ops = journal.groupBy("attribute").agg(F.max(F.col("op") == "InsertAfter").alias("inserts"), F.max(F.col("op").isin("Add", "Remove")).alias("adds"), F.min_by("value.tag", "seq").alias("type"))
    entity = F.col("type") == "Entity"
    return ops.select("attribute", "type", F.when(F.col("inserts"), "SequenceRga").when(F.col("adds") & entity, "RefSet").when(F.col("adds"), "SetAddWins").when(entity, "RefScalar").otherwise("ScalarLww").alias("class"))


def extended(schema: Schema, journal: DataFrame) -> Schema:
    """The schema with the inferred attributes it lacks."""
    out = Schema(schema.version, dict(schema.attributes), dict(schema.predicates))
    for r in inferred(journal).collect():  # one row per attribute
        if out.by_id(r["attribute"]) is None:
            out.attributes[f"attribute_{r['attribute']}"] = Attribute(r["attribute"], f"attribute_{r['attribute']}", AttributeClass(r["class"]), Type(r["type"]))
    return out


def type_of(text: str) -> Type:
    return Type("List", type_of(text[5:-1])) if text.startswith("List<") else Type(text)


def written(schema: Schema) -> dict:
    """A schema as plain data."""
    return {"version": schema.version, "attributes": [[a.id, a.name, a.cls.value, str(a.type)] for a in schema.attributes.values()],
            "predicates": [[p.name, [str(t) for t in p.types]] for p in schema.predicates.values()]}


def read_schema(data: dict) -> Schema:
    schema = Schema(data["version"])
    for id, name, cls, type in data["attributes"]:
        schema.attribute(name, AttributeClass(cls), type_of(type), id)
    for name, types in data["predicates"]:
        schema.predicate(name, *map(type_of, types))
    return schema


class Journal:
    """One namespace's journal under a directory that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.documents = Documents(spark, self.path)
        active = self.active()
        self.schema = read_schema(active["schema"]) if active and schema is None else schema

    # --- reading -----------------------------------------------------------------------------------------------------

    def _receipts(self) -> list[dict]:
        return self.documents.all("receipts")

    def receipts(self) -> DataFrame:
        names = [f.name for f in T._parse_datatype_string(RECEIPT).fields]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self._receipts()], T._parse_datatype_string(RECEIPT)).orderBy("batch")

    def scan(self) -> DataFrame:
        """All committed rows, in no particular order (seq tells it)."""
        paths = [f"{self.path}/{r['path']}" for r in self._receipts()]
        types = T._parse_datatype_string(JOURNAL)
        return self.spark.read.schema(types).parquet(*paths) if paths else self.spark.createDataFrame([], types)

    def history(self) -> DataFrame:
        return self.scan().orderBy("seq")

    def prefix(self, as_of: int) -> DataFrame:
        return prefix(self.scan(), as_of)

    def cut(self) -> dict:
        """Where the journal ends, from its last receipt."""
        last = (self._receipts() or [None])[-1]
        if last is None:
            return {"last_element": None, "entry_count": 0, "digest": _digest(0, 0)}
        return {k: last[k] for k in ("last_element", "entry_count", "digest")}

    # --- schemas -----------------------------------------------------------------------------------------------------

    def register(self, schema: Schema, predecessor: str | None = None, compatibility: str = "Exact") -> str:
        """Store a revision and return its reference; an Additive one must keep its predecessor's attributes."""
        data = written(schema)
        ref = fingerprint(data)
        if compatibility not in ("Exact", "Additive"):
            raise EngineError("UnknownCompatibility", compatibility)
        if predecessor is None and compatibility == "Additive":
            raise EngineError("IncompatibleSchema", "an additive revision needs a predecessor")
        if predecessor is not None:
            older = read_schema(self._revision(predecessor)["schema"])
            kind = schema.extends(older)
            if compatibility == "Exact" and (kind != "Exact" or data != written(older)):
                raise EngineError("IncompatibleSchema", "an exact revision equals its predecessor")
        self.documents.put("schemas", ref, {"ref": ref, "schema": data, "predecessor": predecessor, "compatibility": compatibility})
        return ref

    def _revision(self, ref: str) -> dict:
        found = next((r for r in self.documents.all("schemas") if r["ref"] == ref), None)
        if found is None:
            raise EngineError("UnknownSchema", ref)
        return found

    def active(self) -> dict | None:
        """The revision that was activated last."""
        done = self.documents.all("activations")
        return self._revision(done[-1]["ref"]) if done else None

    def activate(self, ref: str) -> str:
        """Make a revision the active one, if it follows that and the whole history replays under it; else quarantine it."""
        revision, before = self._revision(ref), self.active()
        if before is not None and ref != before["ref"] and revision["predecessor"] != before["ref"]:
            raise EngineError("SchemaPrecondition", f"the active schema is {before['ref']}")
        schema, rows = read_schema(revision["schema"]), self.scan()
        faults = [r.asDict() for r in append_errors(rows, rows.limit(0), schema).take(20)] or [r.asDict() for r in dependency_errors(rows, schema).take(20)]
        status = "Quarantined" if faults else "Certified"
        self.documents.put("certifications", f"{len(self.documents.all('certifications')):08d}-{uuid.uuid4().hex}", {"ref": ref, "status": status, "cut": self.cut(), "diagnostics": faults})
        if faults:
            raise EngineError("SchemaQuarantined", str(faults))
        state(rows, schema).agg(F.count(F.lit(1))).first()  # a trial replay
        if not self.documents.put("activations", f"{len(self.documents.all('activations')):08d}", {"ref": ref, "cut": self.cut()}):
            raise EngineError("SchemaPrecondition", "another schema was activated meanwhile")
        self.schema = schema
        return revision["compatibility"]

    def schemas(self) -> list[dict]:
        """All revisions with their status: Registered, Active or Quarantined."""
        active = self.active()
        refused = {c["ref"] for c in self.documents.all("certifications") if c["status"] == "Quarantined"}
        return [{**r, "status": "Quarantined" if r["ref"] in refused else "Active" if active and r["ref"] == active["ref"] else "Registered"} for r in self.documents.all("schemas")]

    # --- appending ---------------------------------------------------------------------------------------------------

    def dry_run(self, rows: DataFrame, schema_ref: str | None = None) -> DataFrame:
        """What append would refuse."""
        return append_errors(rows, self.scan(), self.schema or extended(Schema(), numbered(rows)), schema_ref)

    def append(self, rows: DataFrame, *, expected: dict | None = None, idempotency_key: str | None = None, schema_ref: str | None = None) -> dict:
        """Append a batch as a whole and return its receipt.

        With `expected`, only if the current cut is that one; with an idempotency key, a repeated request returns the
        stored receipt and a different request under the same key is refused.
        """
        receipts = self._receipts()
        last = receipts[-1] if receipts else {"batch": 0, "entry_count": 0, "last_element": None, "marks": "0", "digest": _digest(0, 0)}
        first = last["entry_count"] + 1
        batch = numbered(rows, first)
        size = batch.agg(
            F.coalesce(F.sum(marks(batch)), F.lit(0)).cast("string"), F.coalesce(F.sum(marks(batch, first)), F.lit(0)).cast("string"),
            F.count(F.lit(1)), F.max_by("element", "seq"), F.min("element"), F.max("element")).first()
        total, own, count, end, low, high = size
        request = _digest(own, count)
        if idempotency_key is not None:
            old = next((r for r in receipts if r["idempotency_key"] == idempotency_key), None)
            if old is not None:
                if old["request_digest"] != request or old["schema_ref"] != schema_ref:
                    raise EngineError("IdempotencyConflict", idempotency_key)
                return old
        if expected is not None and any(last[k] != expected[k] for k in ("last_element", "entry_count", "digest")):
            raise EngineError("CutMismatch", f"the journal is at {self.cut()}")
        history = self.scan()
        schema = self.schema or extended(Schema(), batch.unionByName(history))
        faults = append_errors(batch, history.where(F.col("element").between(low, high)), schema, schema_ref).take(20)
        if faults:
            raise EngineError("AppendRefused", str([r.asDict() for r in faults]))
        bad = dependency_errors(self._reachable(history, batch).unionByName(batch), schema, batch).take(20)
        if bad:
            raise EngineError("DependencyRefused", str([r.asDict() for r in bad]))
        ordered = [a.id for a in schema.attributes.values() if a.cls == AttributeClass.SEQUENCE]
        grown = batch.where(F.col("attribute").isin(ordered)) if ordered else None
        if grown is not None and not grown.isEmpty():  # of valid operations only sequences can fail: a trial replay of those touched
            touched = history.where(F.col("attribute").isin(ordered)).join(grown.select("entity", "attribute").distinct().hint("merge"), ["entity", "attribute"], "left_semi").select(*batch.columns)
            sequences(touched.unionByName(grown), schema).agg(F.count(F.lit(1))).first()
        path = f"batches/first={first:020d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{path}")
        marked, entries = str(int(last["marks"]) + int(total)), last["entry_count"] + count
        receipt = {"batch": last["batch"] + 1, "path": path, "first_seq": first, "rows": count, "entry_count": entries, "last_element": end if count else last["last_element"],
                   "marks": marked, "digest": _digest(marked, entries), "schema_ref": schema_ref, "idempotency_key": idempotency_key, "request_digest": request}
        if not self.documents.put("receipts", f"batch={receipt['batch']:020d}", receipt):
            self.documents.delete(path)
            raise EngineError("CutMismatch", "another append came first")
        return receipt

    def _reachable(self, history: DataFrame, batch: DataFrame) -> DataFrame:
        """The rows of the history that a batch's dependencies can name: elements that it mentions, insertions of its sequences."""
        none = F.array().cast("array<long>")
        named = batch.select(F.explode(F.array_distinct(F.concat(F.coalesce("provenance.parent_datom_ids", none), F.coalesce("frontier", none)))).alias("element")).distinct()
        low, high = named.agg(F.min("element"), F.max("element")).first()
        rows = history.where(F.col("op") == "InsertAfter").join(
            batch.where(F.col("op") == "InsertAfter").select("entity", "attribute").distinct().hint("merge"), ["entity", "attribute"], "left_semi")
        if low is not None:
            mentioned = history.where(F.col("element").between(low, high)).join(named.hint("merge"), "element", "left_semi")
            rows = rows.select(*batch.columns).unionByName(mentioned.select(*batch.columns)).dropDuplicates(["seq"])
        return rows.select(*batch.columns)


class Namespaces:
    """Journals by namespace under one root; none sees another's rows, receipts or schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def journal(self, name: str, schema: Schema | None = None) -> Journal:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,62}", name):
            raise EngineError("InvalidNamespace", name)
        return Journal(self.spark, f"{self.root}/{name}", schema)


def prefix_divergence(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Replication check: (seq, leader, follower) where a follower's rows, in any column, are not the leader's prefix."""
    mine = follower.select("seq", F.col("element").alias("follower"), marks(follower).alias("follower_mark"))
    theirs = leader.select("seq", F.col("element").alias("leader"), marks(leader).alias("leader_mark"))
    return mine.join(theirs.hint("merge"), "seq", "left").where(~F.col("leader_mark").eqNullSafe(F.col("follower_mark"))).select("seq", "leader", "follower")


def lag(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """How many rows a follower is behind."""
    return leader.agg(F.count(F.lit(1)).alias("leader_rows")).crossJoin(follower.agg(F.count(F.lit(1)).alias("follower_rows"))).withColumn(
        "lag", F.col("leader_rows") - F.col("follower_rows"))  # two single rows


def fingerprint(parts: dict) -> str:
    """Execution identity: SHA-256 over the canonical JSON of what an evaluation depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
