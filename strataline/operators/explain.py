"""Derivations of a tuple, walked from the tuple to its parents as joins on the frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Atom, EngineError
from ..storage import materialize
from .relations import literal

TRACE = ["predicate", "tuple_id", "values", "rule_id", "stratum", "scc", "iteration", "parents", "sources", "cuts", "capabilities", "visibilities"]


def lineage(relations: dict[str, DataFrame]) -> DataFrame:
    """All derived tuples of all predicates in one table, values as JSON."""
    parts = []
    for p, df in relations.items():
        values = [c for c in df.columns if c.startswith("c") and c[1:].isdigit()]
        parts.append(df.select(
            F.lit(p).alias("predicate"), F.col("_tid").alias("tuple_id"), F.to_json(F.array(*[F.col(c).cast("string") for c in values])).alias("values"), F.col("_rule").alias("rule_id"),
            F.col("_stratum").alias("stratum"), F.col("_scc").alias("scc"), F.col("_iter").alias("iteration"), F.col("_parents").alias("parents"), F.col("_src").alias("sources"),
            F.col("_cuts").alias("cuts"), F.col("_caps").alias("capabilities"), F.col("_vis").alias("visibilities")))
    return reduce(DataFrame.unionByName, parts)


def trace(table: DataFrame, target: int) -> DataFrame:
    """The derivation of one tuple within a lineage: itself and all it was derived from.  A parent that is not there is an error."""
    found = frontier = table.where(F.col("tuple_id") == target)
    if found.isEmpty():
        raise EngineError("UnknownTuple", str(target))
    while True:
        wanted = frontier.select(F.explode("parents").alias("tuple_id")).distinct()
        missing = wanted.join(table, "tuple_id", "left_anti")
        if not missing.isEmpty():
            raise EngineError("DanglingParent", str(missing.first()[0]))
        frontier = materialize(table.join(wanted, "tuple_id", "left_semi").join(found.select("tuple_id"), "tuple_id", "left_anti").select(*TRACE), "frontier")
        if frontier.isEmpty():
            return found.select(*TRACE)
        found = found.select(*TRACE).unionByName(frontier)


def find(relation: DataFrame, atom: Atom, types) -> int:
    """Id of the first tuple that a ground atom names."""
    conditions = [F.col(f"c{i}").eqNullSafe(literal(t, type)) for i, (t, type) in enumerate(zip(atom.terms, types))]
    row = relation.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).agg(F.min("_tid")).first()
    if row[0] is None:
        raise EngineError("UnknownTuple", atom.predicate)
    return row[0]
