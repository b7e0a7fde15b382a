"""A tuple space over three tables: records, claims, completions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError


@dataclass(frozen=True)
class Claim:
    claim_id: int
    tuple_id: int
    owner: str
    lease_epoch: int
    expires_at: float | None = None


def matching(records: DataFrame, pattern: list, claims: DataFrame | None = None, completions: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """Records whose fields match (None is a wildcard) and that are neither completed nor under a live claim, oldest first."""
    conditions = [F.size("fields") == len(pattern)] + [F.element_at("fields", i + 1) == str(p) for i, p in enumerate(pattern) if p is not None]
    rows = records.where(reduce(lambda a, b: a & b, conditions))
    if completions is not None:
        rows = rows.join(completions.select("tuple_id"), "tuple_id", "left_anti")
    if claims is not None:
        live = claims.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))) if now is not None else claims
        rows = rows.join(live.select("tuple_id"), "tuple_id", "left_anti")
    return rows.orderBy("tuple_id")


@dataclass
class TupleSpace:
    """A driver-side space for coordination (small by nature); matching runs on Spark."""

    spark: SparkSession
    records: list[tuple] = field(default_factory=list)
    claims: dict[int, Claim] = field(default_factory=dict)
    completed: set[int] = field(default_factory=set)
    events: list[tuple[str, int]] = field(default_factory=list)
    epochs: dict[int, int] = field(default_factory=dict)
    issued: int = 0

    def out(self, *fields, payload: dict | None = None, created_at: float = 0.0) -> int:
        self.records.append((len(self.records) + 1, [str(f) for f in fields], {k: str(v) for k, v in (payload or {}).items()}, created_at))
        self.events.append(("out", len(self.records)))
        return len(self.records)

    def _frames(self):
        records = self.spark.createDataFrame(self.records, "tuple_id long, fields array<string>, payload map<string,string>, created_at double")
        claims = self.spark.createDataFrame([(c.tuple_id, c.owner, c.expires_at) for c in self.claims.values()], "tuple_id long, owner string, expires_at double")
        return records, claims, self.spark.createDataFrame([(t,) for t in sorted(self.completed)], "tuple_id long")

    def read(self, pattern: list, limit: int = 10, now: float | None = None) -> DataFrame:
        records, claims, completed = self._frames()
        return matching(records, pattern, claims, completed, now).limit(limit)

    def claim(self, pattern: list, owner: str, now: float = 0.0, ttl: float | None = None) -> Claim | None:
        """The first available match, under a new lease epoch."""
        row = self.read(pattern, 1, now).first()
        if row is None:
            return None
        t = row["tuple_id"]
        self.epochs[t], self.issued = self.epochs.get(t, 0) + 1, self.issued + 1
        self.claims[t] = Claim(self.issued, t, owner, self.epochs[t], None if ttl is None else now + ttl)
        self.events.append(("claim", t))
        return self.claims[t]

    def _current(self, claim: Claim) -> None:
        if self.claims.get(claim.tuple_id) != claim:
            raise EngineError("StaleClaim", f"claim {claim.claim_id} is not the current one of tuple {claim.tuple_id}")

    def release(self, claim: Claim) -> None:
        self._current(claim)
        del self.claims[claim.tuple_id]
        self.events.append(("release", claim.tuple_id))

    def renew(self, claim: Claim, expires_at: float) -> Claim:
        self._current(claim)
        self.claims[claim.tuple_id] = replace(claim, expires_at=expires_at)
        return self.claims[claim.tuple_id]

    def complete(self, claim: Claim, *result) -> int:
        self._current(claim)
        del self.claims[claim.tuple_id]
        self.completed.add(claim.tuple_id)
        self.events.append(("complete", claim.tuple_id))
        return self.out("completed", claim.tuple_id, *result)

    def explain(self, tuple_id: int) -> list[str]:
        return [what for what, t in self.events if t == tuple_id]
