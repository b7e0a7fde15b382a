"""Executions and trace handles in a folder: what a run derived, resolved and checked again later, by any driver.

An execution is its document, view and scope, and the written lineage of all its derived tuples.  A handle is an opaque
name for one tuple's derivation, kept with a digest of it.  Of more than `retained` executions the oldest go and leave a
tombstone; so do of these the oldest beyond TOMBSTONES.
"""

from __future__ import annotations

import secrets
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .model import PUBLIC, EngineError, Scope
from .operators.explain import trace
from .session import Engine
from .sources.journal import fingerprint
from .storage import Documents

RETAINED, TOMBSTONES = 1024, 65536


@dataclass(frozen=True)
class Handle:
    execution: str
    tuple_id: int
    token: str
    digest: str


def trace_digest(rows: DataFrame) -> str:
    """A digest of one derivation (a trace is as long as a proof, not as a relation)."""
    return fingerprint({"trace": [r.asDict(recursive=True) for r in rows.orderBy("tuple_id").collect()]})


class ExecutionStore:
    def __init__(self, spark: SparkSession, path: str, retained: int = RETAINED):
        self.spark, self.path, self.retained = spark, path.rstrip("/"), retained
        self.documents = Documents(spark, self.path)

    def run(self, engine: Engine, document: str, as_of: int | None = None, scope: Scope = PUBLIC) -> str:
        """Evaluate a document's program with lineage and keep it; returns the execution's name."""
        program = engine.parse(document)
        result = engine.evaluate(program, as_of, scope, full=True)
        name, at = secrets.token_hex(16), time.time_ns()
        result.lineage().write.parquet(f"{self.path}/lineage/{name}")
        record = {"execution": name, "at": at, "document": document, "as_of": as_of, "scope": [scope.capabilities, scope.visibilities], "identity": engine.identity(program, as_of, scope)}
        self.documents.put("executions", f"{at:020d}-{name}", record)
        self._retain()
        return name

    def _retain(self) -> None:
        kept = self.documents.all("executions")
        for old in kept[: max(0, len(kept) - self.retained)]:
            self.documents.put("tombstones", f"{old['at']:020d}-{old['execution']}", {"execution": old["execution"], "at": old["at"]})
            for gone in (f"executions/{old['at']:020d}-{old['execution']}.json", f"lineage/{old['execution']}", f"handles/{old['execution']}"):
                self.documents.delete(gone)
        stones = self.documents.all("tombstones")
        for old in stones[: max(0, len(stones) - TOMBSTONES)]:
            self.documents.delete(f"tombstones/{old['at']:020d}-{old['execution']}.json")

    def record(self, execution: str) -> dict:
        found = next((r for r in self.documents.all("executions") if r["execution"] == execution), None)
        if found is None:
            gone = any(r["execution"] == execution for r in self.documents.all("tombstones"))
            raise EngineError("ExecutionExpired" if gone else "UnknownExecution", execution)
        return found

    def lineage(self, execution: str) -> DataFrame:
        self.record(execution)
        return self.spark.read.parquet(f"{self.path}/lineage/{execution}")

    def handle(self, execution: str, tuple_id: int) -> Handle:
        """An opaque handle to one derived tuple's trace."""
        made = Handle(execution, tuple_id, f"{execution}.{secrets.token_urlsafe(24)}", trace_digest(trace(self.lineage(execution), tuple_id)))
        self.documents.put(f"handles/{execution}", fingerprint({"token": made.token}), made.__dict__)
        return made

    def find(self, token: str) -> Handle:
        execution = token.split(".")[0]
        if len(execution) != 32 or set(execution) - set("0123456789abcdef"):
            raise EngineError("UnknownHandle", token)
        self.record(execution)
        found = next((h for h in self.documents.all(f"handles/{execution}") if h["token"] == token), None)
        if found is None:
            raise EngineError("UnknownHandle", token)
        return Handle(**found)

    def resolve(self, token: str) -> DataFrame:
        """The derivation that a handle names, from the lineage as it was written."""
        h = self.find(token)
        return trace(self.lineage(h.execution), h.tuple_id)

    def verify(self, token: str, engine: Engine) -> bool:
        """Evaluate the execution's document and view again and compare the derivation with the handle's digest."""
        h = self.find(token)
        old = self.record(h.execution)
        again = engine.evaluate(engine.parse(old["document"]), old["as_of"], Scope(*map(tuple, old["scope"])), full=True)
        return trace_digest(trace(again.lineage(), h.tuple_id)) == h.digest
