"""Partitions with their own journals, explicit cuts across them, and documents over facts imported at cuts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PUBLIC, EngineError, Program, Scope
from ..operators.replay import scoped, state
from ..session import Engine, Run


@dataclass(frozen=True)
class Cut:
    """A place in a partition's journal: an element, or its end."""

    partition: str
    as_of: int | None = None


@dataclass(frozen=True)
class Import:
    """A document to run on a partition and the local predicate that its rows become."""

    cut: Cut
    document: str
    predicate: str


def normalised(cuts: list[Cut]) -> list[Cut]:
    """Cuts by partition, equal ones once; two different cuts of one partition are refused."""
    out = sorted(set(cuts), key=lambda c: (c.partition, c.as_of or 0))
    for a, b in zip(out, out[1:]):
        if a.partition == b.partition:
            raise EngineError("ConflictingCuts", a.partition)
    return out


class Federation:
    """Journals by partition id: a table with a `partition` column, so that Spark prunes to the partitions asked."""

    def __init__(self, spark: SparkSession, journals: dict[str, DataFrame]):
        self.spark, self.journals = spark, journals

    def journal(self, partition: str) -> DataFrame:
        if partition not in self.journals:
            raise EngineError("UnknownPartition", partition)
        return self.journals[partition]

    def history(self, cuts: list[Cut], scope: Scope = PUBLIC) -> DataFrame:
        """Rows of all partitions up to their cuts as the scope sees them, with the partition's name; a hidden cut is unknown."""
        if len({c.partition for c in cuts}) != len(cuts):
            raise EngineError("DuplicatePartition", str(cuts))
        parts = [scoped(self.journal(c.partition), c.as_of, scope).withColumn("partition", F.lit(c.partition)) for c in normalised(cuts)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def state(self, cut: Cut, schema, scope: Scope = PUBLIC) -> DataFrame:
        return state(scoped(self.journal(cut.partition), cut.as_of, scope), schema).withColumn("partition", F.lit(cut.partition))

    def imported(self, item: Import, scope: Scope = PUBLIC, full: bool = True) -> DataFrame:
        """Rows of the document's primary query as facts, in full mode with their sources, policy and this cut added to their cuts.

        The query has one goal, on a derived predicate, and its view must be the cut's.  Without `full` only values are
        evaluated and carried: all of them are visible in the scope already.
        """
        engine = Engine(self.spark, self.journal(item.cut.partition))
        program = engine.parse(item.document)
        query = program.primary
        if query is None or len(query.goals) != 1:
            raise EngineError("ImportGoals", f"an import needs one goal, not {0 if query is None else len(query.goals)}")
        if query.goals[0].predicate not in {r.head.predicate for r in program.rules}:
            raise EngineError("ImportNotDerived", query.goals[0].predicate)
        if query.as_of != item.cut.as_of:
            raise EngineError("ImportView", f"the query reads {query.as_of}, the cut is {item.cut.as_of}")
        rows = engine.evaluate(program, query.as_of, scope, full, [query.goals[0].predicate]).query(query)
        if not full:
            return rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
        values = [c for c in rows.columns if c not in ("tuple_id", "sources", "cuts", "capabilities", "visibilities")]
        here = F.array(F.struct(F.lit(item.cut.partition).alias("partition"), F.lit(item.cut.as_of).cast("long").alias("as_of")))
        return rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(values)], F.col("sources").alias("_src"), F.array_sort(F.array_distinct(F.concat("cuts", here))).alias("_cuts"), F.col("capabilities").alias("_caps"), F.col("visibilities").alias("_vis"))

    def run(self, document: str, imports: list[Import], scope: Scope = PUBLIC, full: bool = True) -> Run:
        """A document over imported facts only; it reads the current view."""
        normalised([i.cut for i in imports])
        engine = Engine(self.spark)
        engine.context = {"imports": [[i.cut.partition, i.cut.as_of, i.predicate, i.document] for i in imports]}
        program: Program = engine.parse(document)
        if any(q.as_of is not None for q in program.queries):
            raise EngineError("FederatedView", "a federated document reads the current view")
        for item in imports:
            if item.predicate not in program.schema.predicates:
                raise EngineError("UnknownPredicate", item.predicate)
            facts = self.imported(item, scope, full)
            arity = sum(c[1:].isdigit() for c in facts.columns)
            if arity != program.schema.predicates[item.predicate].arity:
                raise EngineError("ArityMismatch", f"{item.predicate} has {program.schema.predicates[item.predicate].arity} fields, the import {arity}")
            engine.bind(item.predicate, facts)
        return engine.run(program, scope, full)

    def explained(self, document: str, imports: list[Import], scope: Scope = PUBLIC) -> dict:
        """A federated document's report: its imports, the rows of its queries, and its tuple traces with their merged cuts."""
        run = self.run(document, imports, scope, full=True)
        traces = {name: found for name, found in run.explains.items() if isinstance(found, DataFrame)}
        summaries = {}
        for name, found in traces.items():
            cuts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts")
            summaries[name] = found.agg(F.count(F.lit(1)).alias("tuples"), F.max("tuple_id").alias("last"), cuts).first().asDict(recursive=True)
        return {"imports": [{"cut": i.cut, "predicate": i.predicate} for i in imports], "primary": run.primary, "queries": run.queries, "traces": traces, "summaries": summaries}
