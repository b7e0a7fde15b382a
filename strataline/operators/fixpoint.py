"""Evaluation of a plan: components in order, recursive ones by semi-naive rounds.

Each round joins the rows that the round before found (the delta) with the relations as they stood when the round began,
removes what is known by a null-safe anti join, and writes the new rows to the shared folder: lineage stays short and a
lost executor costs one round at most.  A component that is a plain transitive closure is, in `values` mode, evaluated by
doubling: paths known so far are joined with the newest ones, so the number of rounds is the logarithm of the depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Atom, EngineError, Rule, Var
from ..plans.compiler import PLAN_VERSION, Component, Plan, delta_positions
from ..storage import counted, materialize, numbered
from .relations import LINEAGE, META, body, columns, head, minus


#: A relation of up to this many rows stays in one partition: joins among such need no shuffle, a round is one task.
TINY = 10_000


def tiny(rows: DataFrame, count: int) -> DataFrame:
    return rows.coalesce(1) if count <= TINY else rows


@dataclass(frozen=True)
class Limits:
    iterations: int = 4096
    tuples: int | None = None
    rules: int = 512
    document_bytes: int = 1 << 20


@dataclass
class Derived:
    """Derived relations by predicate, and (iteration, new rows) of every round."""

    relations: dict[str, DataFrame] = field(default_factory=dict)
    rounds: list[tuple[int, int]] = field(default_factory=list)
    tuples: int = 0


def empty(spark: SparkSession, plan: Plan, predicate: str, full: bool) -> DataFrame:
    fields = [T.StructField(f"c{i}", t.spark()) for i, t in enumerate(plan.schema.predicates[predicate].types)]
    df = spark.createDataFrame([], T.StructType(fields))
    for name, type in ({**META, **LINEAGE} if full else {}).items():
        df = df.withColumn(name, F.lit(None).cast(type))
    return df


def closure(component: Component) -> tuple[Rule, int, int] | None:
    """(base rule, source position, target position) of a plain transitive closure over p <- e.

    Its step is p(..x..z..) <- p(..x..y..), e(..y..z..), or the same with p for e: both derive the same set.
    """
    if len(component.predicates) != 1 or len(component.rules) != 2 or any(x.negated for r in component.rules for x in r.body):
        return None
    p = component.predicates[0]
    base = next((r for r in component.rules if all(x.atom.predicate != p for x in r.body)), None)
    step = next((r for r in component.rules if r is not base), None)
    if base is None or step is None or len(base.body) != 1 or len(step.body) != 2 or base.aggregates:
        return None
    if base.body[0].atom.terms != base.head.terms or len(set(base.head.variables())) != len(base.head.terms):
        return None
    e, h = base.body[0].atom.predicate, step.head.terms
    if not all(isinstance(t, Var) for a in (*step.positives, step.head) for t in a.terms) or len(set(h)) != len(h):
        return None
    for left, right in (step.positives, step.positives[::-1]):  # the path so far, and what makes it longer
        if left.predicate != p or right.predicate not in (p, e):
            continue
        changed = [[i for i in range(len(h)) if atom.terms[i] != h[i]] for atom in (left, right)]
        if any(len(c) != 1 for c in changed) or changed[0] == changed[1]:
            continue
        i, j = changed[0][0], changed[1][0]
        middle = left.terms[i]
        if middle == right.terms[j] and middle not in h:
            return base, j, i
    return None


class Evaluation:
    def __init__(self, spark: SparkSession, plan: Plan, source, limits: Limits = Limits(), full: bool = False, iterations: bool = False):
        """source(predicate) gives an extensional relation; `iterations` asks for exact round numbers (no doubling)."""
        if plan.version != PLAN_VERSION:
            raise EngineError("PlanVersion", f"the plan has version {plan.version}, this engine evaluates {PLAN_VERSION}")
        if len(plan.program.rules) > limits.rules:
            raise EngineError("RuleLimit", f"{len(plan.program.rules)} rules; the limit is {limits.rules}")
        self.spark, self.plan, self.source, self.limits, self.full, self.exact = spark, plan, source, limits, full, iterations or full
        self.out, self.round = Derived(), 0
        self.derived = plan.derived

    def read(self, predicate: str) -> DataFrame:
        """A predicate that heads a rule is read from its derivations only, whatever facts it has."""
        return self.out.relations[predicate] if predicate in self.derived else self.source(predicate)

    def run(self) -> Derived:
        for component in self.plan.components:
            pattern = None if self.exact or not component.recursive else closure(component)
            if not component.recursive and not self.exact and self.limits.tuples is None:
                self._inline(component)
            elif pattern:
                self._doubling(component, *pattern)
            else:
                self._rounds(component)
        self.out.rounds.append((self.round + 1, 0))
        return self.out

    def _inline(self, component: Component) -> None:
        """A component without recursion stays part of the plan that reads it; one that is read again becomes a table."""
        p = component.predicates[0]
        self.out.relations[p] = empty(self.spark, self.plan, p, False)
        rows = reduce(DataFrame.union, [rows for *_, rows in self._variants(component, None)]).distinct()
        uses = sum(x.atom.predicate == p for c in self.plan.components for r in c.rules for x in r.body)
        self.out.relations[p] = materialize(rows, f"relation-{p}") if uses > 1 else rows

    def _start(self) -> None:
        self.round += 1
        if self.round > self.limits.iterations:
            raise EngineError("IterationLimit", f"more than {self.limits.iterations} iterations")

    def _keep(self, found: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, int]]:
        """Write a round's new rows and count them."""
        out = {}
        for p, rows in found.items():
            out[p] = rows if isinstance(rows, tuple) else counted(rows, f"round-{p}")
        total = sum(n for _, n in out.values())
        self.out.tuples += total
        if self.limits.tuples is not None and self.out.tuples > self.limits.tuples:
            raise EngineError("TupleLimit", f"more than {self.limits.tuples} derived tuples")
        if total:
            self.out.rounds.append((self.round, total))
        return out

    def _variants(self, component: Component, deltas: dict[str, DataFrame] | None):
        """(rule, anchor, matches projected to the head) of one round: seed rules first, then one variant per delta position."""
        predicates = self.plan.schema.predicates
        for rule in component.rules:
            anchors = delta_positions(rule, component)
            if bool(anchors) != (deltas is not None):
                continue
            for k, anchor in enumerate(anchors or [None]):
                def read(i, atom: Atom, negated: bool, anchor=anchor):
                    return deltas[atom.predicate] if i == anchor and not negated and anchor is not None else self.read(atom.predicate)

                if anchor is not None and rule.positives[anchor].predicate not in deltas:
                    continue
                rows = body(self.spark, rule, read, predicates, self.full)
                yield rule, k, head(rows, rule, predicates[rule.head.predicate], self.full)

    def _new(self, component: Component, variants: list) -> dict[str, DataFrame]:
        found = {}
        for p in component.predicates:
            n = self.plan.schema.predicates[p].arity
            mine = [(r, k, rows) for r, k, rows in variants if r.head.predicate == p]
            if not mine:
                continue
            if not self.full:
                rows = reduce(DataFrame.union, [rows for *_, rows in mine]).distinct()
            else:
                # the first derivation of a value wins: rule, anchor, then the places of the rows it joins
                parts = [rows.select("*", F.struct(F.lit(r.id).alias("rule"), F.lit(k).alias("anchor"), F.col("_place").alias("place")).alias("_first")) for r, k, rows in mine]
                rows = reduce(DataFrame.unionByName, parts)
                first = Window.partitionBy(*columns(n)).orderBy("_first", *columns(n)) if n else Window.partitionBy(F.lit(0)).orderBy("_first")  # a predicate without fields has one tuple
                rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
            rows = minus(rows, self.out.relations[p], n)
            if self.full:
                # ids follow the order of derivation over the whole round; only this mode pays for it
                base = self.out.tuples + 1 + sum(count for _, count in found.values())
                rows, count = numbered(rows.orderBy("_first", *columns(n)), f"round-{p}")
                rows = rows.withColumn("_tid", F.col("_n") + F.lit(base)).select(
                    *columns(n), "_tid", "_src", "_cuts", "_caps", "_vis", F.col("_tid").alias("_ord"), F.col("_first.rule").cast("int").alias("_rule"),
                    F.lit(component.stratum).cast("int").alias("_stratum"), F.lit(component.number).cast("int").alias("_scc"), F.lit(self.round).cast("int").alias("_iter"), "_parents")
                rows = (rows, count)
            found[p] = rows
        return found

    def _rounds(self, component: Component) -> None:
        for p in component.predicates:
            self.out.relations[p] = empty(self.spark, self.plan, p, self.full)
        self._start()
        held: dict[str, list[DataFrame]] = {}
        size = dict.fromkeys(component.predicates, 0)
        kept = self._keep(self._new(component, list(self._variants(component, None))))
        while True:
            deltas = {p: tiny(rows, n) for p, (rows, n) in kept.items() if n}
            for p, rows in deltas.items():
                parts = held[p] = [*held.get(p, []), rows]
                size[p] += kept[p][1]
                if len(parts) > 8:  # keep plans short: the accumulated rounds become one table
                    parts = held[p] = [materialize(reduce(DataFrame.unionByName, parts), f"relation-{p}")]
                self.out.relations[p] = tiny(reduce(DataFrame.unionByName, parts), size[p])
            if not deltas or not component.recursive:
                return
            self._start()
            kept = self._keep(self._new(component, list(self._variants(component, deltas))))

    def _doubling(self, component: Component, base: Rule, source: int, target: int) -> None:
        p = component.predicates[0]
        n = self.plan.schema.predicates[p].arity
        self.out.relations[p] = empty(self.spark, self.plan, p, False)
        self._start()
        kept = self._keep({p: self.read(base.body[0].atom.predicate).select(*columns(n)).distinct()})
        known, (delta, new) = kept[p][0], kept[p]
        total = new
        while new:
            self._start()
            known, delta = tiny(known, total), tiny(delta, new)
            left = known.select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(columns(n))])
            right = delta.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(columns(n))])
            on = [F.col(f"l{target}").eqNullSafe(F.col(f"r{source}"))] + [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) for i in range(n) if i not in (source, target)]
            longer = left.join(right, on).select(*[F.col(f"r{i}" if i == target else f"l{i}").alias(f"c{i}") for i in range(n)]).distinct()
            delta, new = self._keep({p: minus(longer, known, n)})[p]
            known, total = known.union(delta), total + new
        self.out.relations[p] = known
