"""The front door: documents or programs in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dsl
from .functions.policy import visible
from .model import PUBLIC, EngineError, Program, Query, Scope, Type
from .operators import explain as explaining
from .operators import query as querying
from .operators.fixpoint import Derived, Evaluation, Limits
from .operators.relations import META, columns, typed, with_meta
from .operators.replay import bound, prefix, scoped, state
from .plans.compiler import Plan, compile_program
from .sources.journal import Journal, cut, fingerprint
from .storage import materialize

ENGINE_VERSION = "1"


@dataclass
class Result:
    """One evaluated view: relations by predicate, on demand."""

    engine: "Engine"
    plan: Plan
    as_of: int | None
    scope: Scope
    full: bool
    derived: Derived
    source: object
    memo: dict = field(default_factory=dict)

    def relation(self, predicate: str) -> DataFrame:
        """A predicate's rows; derived ones as a set, others as they came."""
        return self.derived.relations[predicate] if predicate in self.plan.derived else self.source(predicate)

    def query(self, query: Query, ordered: bool = False) -> DataFrame:
        rows = querying.answer(query, self.relation, self.plan.schema, self.full)
        return querying.ordered(rows, query, self.plan.schema) if ordered else rows

    def trace(self, atom_text: str) -> DataFrame:
        """Derivation of a ground atom (full mode)."""
        atom = dsl.parse_atom(atom_text, self.plan.schema)
        return self.trace_atom(atom)

    def trace_atom(self, atom) -> DataFrame:
        if not self.full:
            raise EngineError("NoLineage", "evaluate with full=True")
        if atom.predicate not in self.plan.derived:
            raise EngineError("UnknownTuple", f"{atom.predicate} is not derived")
        types = self.plan.schema.predicates[atom.predicate].types
        return explaining.trace(self.lineage(), explaining.find(self.derived.relations[atom.predicate], atom, types))

    def lineage(self) -> DataFrame:
        """All derived tuples with their parents, written once however many traces read it."""
        if "lineage" not in self.memo:
            self.memo["lineage"] = materialize(explaining.lineage(self.derived.relations), "lineage")
        return self.memo["lineage"]


@dataclass
class Run:
    """A document's results: queries and explanations by name (None: unnamed), and the relations it materializes."""

    program: Program
    primary: DataFrame | None
    queries: dict[str | None, DataFrame]
    explains: dict[str | None, object]
    materialized: dict[str, DataFrame]
    views: dict[int | None, Result]
    identity: str


class Engine:
    """Evaluates programs over a journal and over DataFrames bound to predicates."""

    def __init__(self, spark: SparkSession, journal: DataFrame | Journal | None = None, limits: Limits = Limits()):
        self.spark, self.limits = spark, limits
        self.journal = journal.scan() if isinstance(journal, Journal) else journal
        self.bound: dict[str, DataFrame] = {}
        #: What else an execution's identity depends on: the journal's place, the cuts of imported facts.
        self.context: dict = {"journal": journal.path} if isinstance(journal, Journal) else {}

    def bind(self, predicate: str, df: DataFrame) -> "Engine":
        """Make df's columns, in order, the rows of a predicate; columns _caps and _vis, if any, are its policy."""
        self.bound[predicate] = df
        return self

    def parse(self, document: str) -> Program:
        if len(document.encode()) > self.limits.document_bytes:
            raise EngineError("DocumentSize", f"more than {self.limits.document_bytes} bytes")
        return dsl.parse(document)

    def state(self, schema, as_of: int | None = None, scope: Scope | None = None) -> DataFrame:
        """The journal's state, current or as of an element, as a scope sees it."""
        rows = prefix(self.journal, as_of) if scope is None else scoped(self.journal, as_of, scope)
        return state(rows, schema)

    def _facts(self, plan: Plan, predicate: str, full: bool) -> DataFrame | None:
        rows = [f for f in plan.program.facts if f.predicate == predicate]
        if not rows:
            return None
        types = plan.schema.predicates[predicate].types
        fields = [T.StructField(f"c{i}", t.spark()) for i, t in enumerate(types)]
        if not full:
            return self.spark.createDataFrame([tuple(c.value for c in f.values) for f in rows], T.StructType(fields))
        strings = T.ArrayType(T.StringType())
        meta = [T.StructField("_caps", strings), T.StructField("_vis", strings), T.StructField("_ord", T.LongType())]
        data = [(*[c.value for c in f.values], list(f.capabilities), list(f.visibilities), (1 << 40) + i) for i, f in enumerate(rows)]
        return with_meta(self.spark.createDataFrame(data, T.StructType(fields + meta)))

    def evaluate(self, program: Program, as_of: int | None = None, scope: Scope = PUBLIC, full: bool = False, wanted: list[str] | None = None, iterations: bool = False) -> Result:
        """Evaluate a program on one view.  Only what `wanted` predicates need is evaluated (all, if None)."""
        plan = compile_program(program, scope)
        needed = plan if wanted is None else plan.needed(wanted)
        memo: dict[str, DataFrame] = {}
        rows = None if self.journal is None else scoped(self.journal, as_of, scope)
        current = None

        def source(predicate: str) -> DataFrame:
            """Attribute rows, then the document's facts, then bound DataFrames; hidden rows never get here."""
            nonlocal current
            if predicate in memo:
                return memo[predicate]
            parts = []
            signature = plan.schema.predicates[predicate]
            if predicate in plan.bindings and rows is not None:
                if current is None:
                    current = state(rows, plan.schema)
                    if len(plan.bindings) > 1:  # several predicates read it
                        current = materialize(current, "state")
                touched = rows.groupBy("entity").agg(F.min("seq").alias("first")) if full else None
                parts.append(bound(current, touched, plan.bindings[predicate], signature.types[1], full))
            facts = self._facts(plan, predicate, full)
            if facts is not None:
                parts.append(facts)
            if predicate in self.bound:
                df = self.bound[predicate]
                if "_caps" in df.columns or "_vis" in df.columns:
                    none = F.array().cast("array<string>")
                    df = df.where(visible(F.col("_caps") if "_caps" in df.columns else none, F.col("_vis") if "_vis" in df.columns else none, scope))
                df = typed(df, signature)
                parts.append(with_meta(df) if full else df.select(*columns(signature.arity)))
            if not parts and (predicate in plan.emptied or predicate in plan.bindings):
                fields = [T.StructField(f"c{i}", t.spark()) for i, t in enumerate(signature.types)]
                df = self.spark.createDataFrame([], T.StructType(fields))
                parts.append(with_meta(df) if full else df)
            if not parts:
                raise EngineError("MissingSource", f"{predicate} has no rule, fact, attribute or bound DataFrame")
            names = columns(signature.arity) + (list(META) if full else [])
            out = parts[0].select(*names)
            for p in parts[1:]:
                out = out.union(p.select(*names))
            memo[predicate] = out
            return out

        derived = Evaluation(self.spark, needed, source, self.limits, full, iterations).run()
        return Result(self, plan, as_of, scope, full, derived, source)

    def run(self, document: str | Program, scope: Scope = PUBLIC, full: bool = False) -> Run:
        """Run a document: one evaluation per distinct view, then its queries, explanations and materialized relations."""
        program = self.parse(document) if isinstance(document, str) else document
        views: dict[int | None, Result] = {}
        lineage = full or any(e.target is not None for e in program.explains)
        reads = [(q.as_of, [g.predicate for g in q.goals]) for q in program.queries] + [(e.as_of, [e.target.predicate]) for e in program.explains if e.target]
        main = program.primary.as_of if program.primary else None
        reads.append((main, program.materialize))

        def view(as_of):
            if as_of not in views:
                wanted = sorted({p for at, names in reads if at == as_of for p in names}) if not lineage else None
                views[as_of] = self.evaluate(program, as_of, scope, lineage, wanted)
            return views[as_of]

        def answer(q: Query) -> DataFrame:
            rows = view(q.as_of).query(q)
            return rows if full or not lineage else rows.drop("tuple_id", "sources", "cuts", "capabilities", "visibilities")

        queries = {q.name: answer(q) for q in program.queries}
        explains = {e.name: view(e.as_of).trace_atom(e.target) if e.target else compile_program(program, scope).phases() for e in program.explains}
        materialized = {p: view(main).relation(p).select(*columns(program.schema.predicates[p].arity)) for p in program.materialize}
        primary = queries[program.primary.name] if program.primary else None
        return Run(program, primary, queries, explains, materialized, views, self.identity(program, main, scope))

    def identity(self, program: Program, as_of: int | None, scope: Scope) -> str:
        """What an evaluation depends on, as one digest."""
        seen = None if self.journal is None else cut(scoped(self.journal, as_of, scope)).first().asDict()
        return fingerprint({"engine": ENGINE_VERSION, "context": self.context, "scope": [scope.capabilities, scope.visibilities], "as_of": as_of, "history": seen, "schema": repr(program.schema), "rules": repr(program.rules), "facts": repr(program.facts)})


U64, I64, F64, STRING, BOOL, ENTITY = (Type(n) for n in ("U64", "I64", "F64", "String", "Bool", "Entity"))
