"""Relations and rule bodies.

A relation is a DataFrame with value columns c0..cN.  In `full` mode it also has META columns: who derived it and from
what.  In `values` mode there are none, so that column pruning reaches the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import merged
from ..model import Agg, Atom, Const, Predicate, Rule, Var

META = {"_tid": "long", "_src": "array<long>", "_cuts": "array<struct<partition:string,as_of:long>>", "_caps": "array<string>", "_vis": "array<string>", "_ord": "long"}
LINEAGE = {"_rule": "int", "_stratum": "int", "_scc": "int", "_iter": "int", "_parents": "array<long>"}


def columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def literal(c: Const, type):
    return F.lit(c.value).cast(type.spark())


def typed(df: DataFrame, predicate: Predicate) -> DataFrame:
    """The first columns of df as the predicate's value columns, cast to its types; META columns, if any, stay."""
    values = [F.col(f"`{c}`").cast(t.spark()).alias(f"c{i}") for i, (c, t) in enumerate(zip([c for c in df.columns if c not in META], predicate.types))]
    return df.select(*values, *[F.col(m) for m in META if m in df.columns])


def with_meta(df: DataFrame) -> DataFrame:
    """df with all META columns; the order of rows without one is their place in the input."""
    for name, type in META.items():
        if name not in df.columns:
            value = F.monotonically_increasing_id() if name == "_ord" else F.lit(None).cast(type) if name == "_tid" else F.array().cast(type)
            df = df.withColumn(name, value)
    return df


def scan(relation: DataFrame, atom: Atom, predicate: Predicate, index: int, full: bool) -> DataFrame:
    """An atom over its relation: constants filter, repeated variables compare, variables become v_ columns."""
    conditions, first = [], {}
    for i, (term, type) in enumerate(zip(atom.terms, predicate.types)):
        if isinstance(term, Const):
            conditions.append(F.col(f"c{i}").eqNullSafe(literal(term, type)))
        elif term.name in first:
            conditions.append(F.col(f"c{i}").eqNullSafe(F.col(first[term.name])))
        else:
            first[term.name] = f"c{i}"
    rows = relation.where(reduce(lambda a, b: a & b, conditions)) if conditions else relation
    out = [F.col(c).alias(f"v_{v}") for v, c in first.items()]
    if full:
        out += [F.col(m).alias(f"{m}_{index}") for m in META]
    return rows.select(*out, *([] if out else [F.lit(1).alias("v_")]))


def _variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("v_") and c != "v_"]


def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Natural join on shared variables, null-safe (Null unifies with Null); without shared ones every pair, as rules ask."""
    shared = [v for v in _variables(right) if v in left.columns]
    renamed = right.select(*[F.col(c).alias(f"r_{c}") if c in shared or c == "v_" else F.col(c) for c in right.columns])
    on = [left[v].eqNullSafe(renamed[f"r_{v}"]) for v in shared]
    if how == "left_anti":
        return left.join(renamed, on, how) if on else left.join(renamed.limit(1), F.lit(True), how)
    joined = left.join(renamed, on, how) if on else left.crossJoin(renamed)
    return joined.select(*left.columns, *[c for c in right.columns if c not in shared and c != "v_"])


def body(spark: SparkSession, rule: Rule, read, predicates: dict[str, Predicate], full: bool) -> DataFrame:
    """All matches of a rule's body.  read(literal position among positives, atom, negated) gives the relation to read."""
    rows = None
    for i, atom in enumerate(rule.positives):
        part = scan(read(i, atom, False), atom, predicates[atom.predicate], i, full)
        rows = part if rows is None else join(rows, part)
    if rows is None:
        rows = spark.range(1).select(F.lit(1).alias("v_"))
    for atom in (x.atom for x in rule.body if x.negated):
        rows = join(rows, scan(read(None, atom, True), atom, predicates[atom.predicate], -1, False), "left_anti")
    return _combined(rows, len(rule.positives)) if full else rows


def _combined(rows: DataFrame, n: int) -> DataFrame:
    """The META columns of the joined rows as one set."""
    values = [c for c in rows.columns if c.startswith("v_")]
    every = lambda m: [F.col(f"{m}_{i}") for i in range(n)]
    empty = lambda type: F.array().cast(type)
    if n == 0:
        return rows.select(*values, empty("array<long>").alias("_parents"), *[empty(META[m]).alias(m) for m in ("_src", "_cuts", "_caps", "_vis")], empty("array<long>").alias("_place"))
    return rows.select(
        *values, F.array_distinct(F.array_compact(F.array(*every("_tid")))).alias("_parents"), F.array_distinct(F.concat(*every("_src"))).alias("_src"),
        F.array_sort(F.array_distinct(F.concat(*every("_cuts")))).alias("_cuts"), merged(*every("_caps")).alias("_caps"), merged(*every("_vis")).alias("_vis"),
        F.array(*every("_ord")).alias("_place"))


def head(rows: DataFrame, rule: Rule, predicate: Predicate, full: bool) -> DataFrame:
    """Project the matches to the rule's head; aggregates group by the other head terms."""
    meta = ["_parents", "_src", "_cuts", "_caps", "_vis", "_place"] if full else []
    if not rule.aggregates:
        out = [F.col(f"v_{t.name}") if isinstance(t, Var) else literal(t, type) for t, type in zip(rule.head.terms, predicate.types)]
        return rows.select(*[c.cast(type.spark()).alias(f"c{i}") for i, (c, type) in enumerate(zip(out, predicate.types))], *meta)
    names = _variables(rows)
    # aggregates see each binding of the body's variables once
    if full:
        rows = rows.groupBy(*names).agg(F.min(F.struct("_place", *meta[:-1])).alias("m")).select(*names, *[F.col(f"m.{c}").alias(c) for c in meta])
    else:
        rows = rows.dropDuplicates(names) if names else rows.limit(1)
    keys, aggregates = [], [F.count(F.lit(1)).alias("_n")]
    for i, (t, type) in enumerate(zip(rule.head.terms, predicate.types)):
        if isinstance(t, Agg):
            aggregates.append(_aggregate(t, type).alias(f"c{i}"))
        elif isinstance(t, Var):
            keys.append(F.col(f"v_{t.name}").alias(f"c{i}"))
    if full:
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        aggregates += [union(c) for c in meta[:-1]]
    # a group without rows does not exist, not even the one without keys
    grouped = rows.groupBy(*keys).agg(*aggregates).where("_n > 0")
    constants = {i: literal(t, type).alias(f"c{i}") for i, (t, type) in enumerate(zip(rule.head.terms, predicate.types)) if isinstance(t, Const)}
    value = lambda i: constants.get(i, F.col(f"c{i}").cast(predicate.types[i].spark()).alias(f"c{i}"))
    return grouped.select(*[value(i) for i in range(predicate.arity)], *([F.col(c) for c in meta[:-1]] + [F.array().cast("array<long>").alias("_place")] if full else []))


def _aggregate(t: Agg, type):
    column = F.col(f"v_{t.var.name}")
    if t.function == "count":
        return F.count(F.lit(1))
    if t.function == "sum":
        strict = F.when(column.isNull(), F.raise_error(F.lit("sum over a null value"))).otherwise(column)
        return F.sum(strict).cast(type.spark())
    return F.min(column) if t.function == "min" else F.max(column)


def minus(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows whose values are not known yet."""
    other = known.select(*[F.col(c).alias(f"k_{c}") for c in columns(n)], F.lit(1).alias("k_"))
    on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in columns(n)]
    return rows.join(other, on if on else F.lit(True), "left_anti")
