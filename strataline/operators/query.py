"""Queries over evaluated relations: goals, order, paging, deltas between two results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import typed_key
from ..model import EngineError, Query, Schema, Var
from .relations import META, join, scan


def answer(query: Query, read, schema: Schema, full: bool = False) -> DataFrame:
    """Rows of a conjunctive query, duplicates included; columns are the kept variables (all, in order, when none is named).

    Kept names that no goal binds are dropped.  In full mode the row's `tuple_id` is that of the last goal that has one,
    beside the merged sources, cuts and policy.
    """
    if not query.goals:
        raise EngineError("EmptyQuery", query.name or "")
    rows = None
    for i, atom in enumerate(query.goals):
        part = scan(read(atom.predicate), atom, schema.predicates[atom.predicate], i, full)
        rows = part if rows is None else join(rows, part)
    bound = list(dict.fromkeys(t.name for a in query.goals for t in a.terms if isinstance(t, Var)))
    kept = [v for v in query.keep if v in bound] if query.keep else bound
    out = [F.col(f"v_{v}").alias(v) for v in dict.fromkeys(kept)]
    if full:
        n = len(query.goals)
        ids = [F.col(f"_tid_{i}") for i in reversed(range(n))]
        union = lambda m: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(f"{m}_{i}"), F.array().cast(META[m])) for i in range(n)])))
        out += [F.coalesce(*ids).alias("tuple_id"), union("_src").alias("sources"), union("_cuts").alias("cuts"), union("_caps").alias("capabilities"), union("_vis").alias("visibilities")]
    return rows.select(*out) if out else rows.select(F.lit(True).alias("holds"))


def variable_types(query: Query, schema: Schema) -> dict:
    return {t.name: type for a in query.goals for t, type in zip(a.terms, schema.predicates[a.predicate].types) if isinstance(t, Var)}


def ordered(rows: DataFrame, query: Query, schema: Schema) -> DataFrame:
    """The documented order: typed keys of all columns, each ended by a bar."""
    types = variable_types(query, schema)
    return rows.orderBy(F.concat(*[F.concat(typed_key(F.col(c), types[c]), F.lit("|")) for c in rows.columns if c in types]))


def page(rows: DataFrame, offset: int = 0, limit: int = 100, most: int = 1000) -> DataFrame:
    """One page of an ordered result, with next_offset (null on the last page)."""
    if not 1 <= limit <= most:
        raise EngineError("InvalidPage", f"limit {limit} is not within 1 and {most}")
    if offset < 0:
        raise EngineError("InvalidPage", f"offset {offset}")
    more = not rows.offset(offset + limit).limit(1).isEmpty()
    return rows.offset(offset).limit(limit).withColumn("next_offset", F.lit(offset + limit if more else None).cast("long"))


def delta(before: DataFrame, after: DataFrame, key: str | None = None) -> DataFrame:
    """change (added, removed, changed), key, before, after: exact matches cancel as a multiset, the rest pair by key.

    The key is the first column unless named.  Values compare; execution-local tuple ids do not take part.
    """
    columns = before.columns
    key = key or columns[0]

    def count(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(side))

    a, b = count(before, "_n_before").alias("a"), count(after, "_n_after").alias("b")
    both = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns], "full")
    value = [F.when(F.col("_n_before").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns]
    net = both.select(*value, (F.coalesce("_n_after", F.lit(0)) - F.coalesce("_n_before", F.lit(0))).alias("_net")).where("_net <> 0")
    each = net.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_net").cast("long"))).alias("_copy"), (F.col("_net") > 0).alias("_new"))
    numbered = each.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_new").orderBy(*columns, "_copy")))
    image = F.struct(*columns)
    old = numbered.where(~F.col("_new")).select(F.col(key).alias("key"), "_rank", image.alias("before")).alias("o")
    new = numbered.where("_new").select(F.col(key).alias("key"), "_rank", image.alias("after")).alias("n")
    paired = old.join(new, F.col("o.key").eqNullSafe(F.col("n.key")) & (F.col("o._rank") == F.col("n._rank")), "full")
    return paired.select(
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("change"),
        F.when(F.col("before").isNull(), F.col("n.key")).otherwise(F.col("o.key")).alias("key"), "before", "after")
