"""A worked application over orders: which supplier holds an order at a cut, which deliveries count, what is still open.

Suppliers take turns on an order.  The journal records each take-over (supplier and turn); a delivery counts only if its
supplier held the order in that very turn, so deliveries of suppliers that were replaced are told apart, and what is
settled is derived from what counts.  The report asks seven questions over three views of one journal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import PUBLIC, Atom, Query, Scope, Var
from .operators.query import delta
from .session import Engine
from .sources.journal import POLICY, PROVENANCE

DOCUMENT = """
schema v1 {
  attr order.supplier: RefScalar<Entity>
  attr order.turn: ScalarLww<U64>
}
predicates {
  order_supplier(Entity, Entity)
  order_turn(Entity, U64)
  delivered(Entity, Entity, U64)
  returned(Entity, U64)
  holder(Entity, Entity, U64)
  honoured(Entity, Entity, U64)
  superseded(Entity, Entity, U64)
  settled(Entity)
  pending(Entity)
  load(Entity, U64)
  may_take(Entity, Entity)
}
rules {
  holder(o, s, n) <- order_supplier(o, s), order_turn(o, n)
  honoured(o, s, n) <- delivered(o, s, n), holder(o, s, n)
  superseded(o, s, n) <- delivered(o, s, n), not holder(o, s, n)
  settled(o) <- honoured(o, s, n), not returned(o, n)
  pending(o) <- holder(o, s, n), not settled(o)
  load(s, count(o)) <- holder(o, s, n), pending(o)
  may_take(o, s) <- pending(o), superseded(o, s, n)
}
"""


@dataclass(frozen=True)
class Board:
    """The journal of take-overs and the deliveries (order, supplier, turn, returned)."""

    journal: DataFrame
    deliveries: DataFrame


def board(lines: DataFrame) -> Board:
    """From order lines: line n is turn n of its order, taken by the smallest supplier of that line.

    All first turns come before all second ones, so a turn is a cut; seq and element of a row are one number.
    """
    turns = lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_suppkey").alias("s"), F.max(F.col("l_returnflag") == "R").alias("r"))
    none = lambda kind: F.lit(None).cast(kind)
    value = lambda tag, content: F.struct(F.lit(tag).alias("tag"), none("boolean").alias("b"), content.alias("i"), none("double").alias("f"), none("string").alias("s"), none("binary").alias("x"), none("array<string>").alias("items"))
    both = F.array(F.struct(F.lit(1).alias("attribute"), value("Entity", F.col("s")).alias("value")), F.struct(F.lit(2).alias("attribute"), value("U64", F.col("n")).alias("value")))
    at = place(F.col("n"), F.col("o")) + F.col("row.attribute") - 1
    journal = turns.withColumn("row", F.explode(both)).select(
        at.cast("long").alias("seq"), F.col("o").alias("entity"), F.col("row.attribute").cast("long").alias("attribute"), F.col("row.value").alias("value"), F.lit("Claim").alias("op"), at.cast("long").alias("element"),
        F.lit(1).cast("long").alias("replica"), F.array().cast("array<long>").alias("frontier"), none(PROVENANCE).alias("provenance"), none(POLICY).alias("policy"))
    return Board(journal, turns.select("o", "s", "n", "r"))


def place(turn, order):
    """Where an order's take-over stands in the journal: turns first, then orders, two rows each."""
    return turn * F.lit(1 << 44) + order * F.lit(2)


def after_turn(found: Board, turn: int) -> int:
    """The last element of a turn."""
    return found.journal.where(F.col("seq") < F.lit((turn + 1) << 44)).agg(F.max("element")).first()[0]


def report(spark: SparkSession, found: Board, first: int, later: int, scope: Scope = PUBLIC) -> dict[str, DataFrame]:
    """Seven results: holders after two turns and now; what counts, what does not, the load and who may take over now."""
    engine = Engine(spark, found.journal)
    engine.bind("delivered", found.deliveries.select("o", "s", "n")).bind("returned", found.deliveries.where("r").select("o", "n"))
    program = engine.parse(DOCUMENT)
    now = ["holder", "honoured", "superseded", "load", "may_take"]
    views = {name: engine.evaluate(program, at, scope, wanted=wanted) for name, at, wanted in (
        ("first", after_turn(found, first), ["holder"]), ("later", after_turn(found, later), ["holder"]), ("now", None, now))}

    def ask(view: str, predicate: str) -> DataFrame:
        names = ("o", "s", "n")[: program.schema.predicates[predicate].arity] if predicate != "load" else ("s", "n")
        return views[view].query(Query((Atom(predicate, tuple(map(Var, names))),)))

    return {"first": ask("first", "holder"), "later": ask("later", "holder"), **{("now" if p == "holder" else p): ask("now", p) for p in now}}


def handovers(found: dict[str, DataFrame]) -> DataFrame:
    """How holders changed from the later turn to now."""
    return delta(found["later"], found["now"])


def markdown(found: dict[str, DataFrame], most: int = 50) -> str:
    """A report as text; each section shows `most` rows at most and says how many there are."""
    out = ["# Fulfilment report"]
    for name, df in found.items():
        rows = df.limit(most).collect()
        out += ["", f"## {name} ({df.count()})", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    return "\n".join(out)
