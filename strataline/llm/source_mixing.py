"""Mixing sources to target weights by hierarchical budgets.

The sources form a tree (domain, language, source by default).  A token budget enters at the root and every node hands
its budget to its children by weight; a child takes no more than its subtree can supply (tokens times `max_epochs` of the
leaves whose weights are positive all the way up), and what it cannot take goes to its siblings first.  Because a node's
supply counts its whole subtree, a family that cannot use its budget leaves the rest to the ancestors' other children:
siblings before ancestors.  Shares are whole tokens: those lost to rounding go, one each, to the children with the largest
remainders (ties by name), so a family hands on all it was given as long as it can supply it.  Each leaf then reads
`whole` full epochs and, of one more epoch in seeded order, the longest prefix whose tokens fit the rest.

Which domain a source belongs to is configuration (`domains`), as the weights are: the table does not say.

Everything is grouped aggregation and windows over leaves (not over documents).  A leaf's prefix is found digit by digit of
the order key: each pass adds up the tokens of 256 cells a leaf and goes on within the cell that holds the cut, until a
cell is small; so no window sees more than 256 rows of a leaf, or CELL_ROWS at the end, however many rows the leaf has.
Decisions go back to the documents as one cut per leaf.

Defined results: null level values form a child of their own; null or empty texts have no tokens and are taken with
whichever rows sort before the cut; rows that repeat a doc_id share its place in the order and are taken or left
together; a missing weight counts as `default_weight`; weights of zero get nothing; a source without a domain belongs to
"other"; an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_TABLE, discard, materialize

#: Rows of a cell of a leaf's order that are looked at one by one; with more, its order is cut finer.
CELL_ROWS = 1_000
#: Weights are held as whole multiples of one such part, so that shares are exact.
WEIGHT_PARTS = 1_000_000
WIDE = "decimal(38,0)"


def token_count(text: Column) -> Column:
    """White-space characters plus one; none for null or empty texts."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(
        F.length(t) - F.length(F.translate(t, " \t\n\r\x0b\x0c", "")) + 1).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: 128 bits as hex, equal for equal ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _weight(level: str, given: dict[str, float], default_weight: float) -> Column:
    """A node's weight as a whole number of parts."""
    parts = lambda w: F.lit(round(w * WEIGHT_PARTS))
    if not given:
        return parts(default_weight).cast("long")
    table = F.create_map(*[x for k, v in sorted(given.items()) for x in (F.lit(k), parts(v))])
    return F.coalesce(table[F.coalesce(F.col(level), F.lit("\u0000"))], parts(default_weight)).cast("long")


def _shares(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], default_weight: float, budget: Column) -> DataFrame:
    """leaves (levels, tokens, supply) with `budget`, handed down the tree level by level, in exact whole numbers."""
    weight = {k: _weight(k, weights.get(k, {}), default_weight) for k in levels}
    live = F.least(F.lit(1), *weight.values())  # no branch of weight zero supplies anything
    leaves = leaves.withColumn("supply", F.when(live > 0, F.col("supply")).otherwise(F.lit(0)).cast("long"))
    down = None
    for depth in range(1, len(levels) + 1):
        keys, parent = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply")).withColumn("weight", weight[keys[-1]])
        family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        if down is None:
            nodes = nodes.withColumn("have", F.least(budget.cast("long"), F.sum("supply").over(family)))
        else:
            on = [F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}")) for k in parent]
            nodes = nodes.alias("n").join(down.alias("p"), on).select("n.*", F.col("p.budget").alias("have"))
        # water-filling: children in the order in which a growing level would exhaust them
        wide = lambda c: F.col(c).cast(WIDE)
        ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(math.inf))
        nodes = nodes.withColumn("ratio", ratio).withColumn("weight_all", F.sum("weight").over(family))
        run = family.orderBy("ratio", keys[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        nodes = (
            nodes.withColumn("supply_to", F.sum("supply").over(run)).withColumn("weight_to", F.sum("weight").over(run))
            .withColumn("full", (F.col("weight") > 0) & (
                wide("supply_to") * F.col("weight") + wide("supply") * (F.col("weight_all") - F.col("weight_to")) <= wide("have") * F.col("weight")))
            .withColumn("left", F.col("have") - F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0)).over(family))
            .withColumn("weight_left", F.col("weight_all") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(family))
            .withColumn("open", ~F.col("full") & (F.col("weight") > 0))
            .withColumn("share", F.when(F.col("full"), F.col("supply")).when(F.col("open"), F.expr(f"CAST(left AS {WIDE}) * weight DIV weight_left")).otherwise(0).cast("long"))
            .withColumn("over", F.when(F.col("open"), F.expr(f"CAST(left AS {WIDE}) * weight % weight_left")).cast("long"))
            # what rounding left over: one token each, by the largest remainder
            .withColumn("lost", F.col("left") - F.sum(F.when(F.col("open"), F.col("share")).otherwise(0)).over(family))
            .withColumn("place", F.row_number().over(family.orderBy(F.col("open").desc(), F.col("over").desc_nulls_last(), keys[-1])))
        )
        down = nodes.select(*keys, (F.col("share") + (F.col("open") & (F.col("place") <= F.col("lost"))).cast("long")).alias("budget"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in levels]
    return leaves.alias("l").join(down.alias("b"), on).select("l.*", "b.budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], levels: dict[str, Column] | None = None, budget_share: float = 0.5,
        budget_tokens: int | None = None, max_epochs: int = 4, seed: int = 17, default_weight: float = 1.0,
        id_col: str = "doc_id", tokens: Column | None = None, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with n_tokens, leaf_budget and copies (how often the mix reads the row; 0 leaves it out).

    `levels` names the tree's levels from the top, each a column expression; `weights` gives the target weights of the
    values of a level within their parent.  The budget is `budget_tokens`, or else `budget_share` of all tokens.
    """
    levels = levels or default_levels(domains)
    names = [f"level_{i}" for i in range(len(levels))]
    weights = {n: weights.get(k, {}) for n, k in zip(names, levels)}
    tokens = token_count(F.col("text")) if tokens is None else tokens
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "leaf_budget", "copies", *names)]
    rows = docs.select(*keep, *[e.cast("string").alias(n) for n, e in zip(names, levels.values())], tokens.alias("n_tokens"))
    light = materialize(rows.select(F.col(id_col).alias("id"), *names, "n_tokens"), "mix-rows")
    leaves = materialize(light.groupBy(*names).agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).withColumn("supply", F.col("tokens") * max_epochs), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    budget = min(int(total[0] * budget_share) if budget_tokens is None else budget_tokens, total[0] * max_epochs)
    plan = _shares(leaves, names, weights, default_weight, F.lit(budget))
    plan = materialize(
        plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-plan")

    sent = F.broadcast if plan.count() <= SMALL_TABLE else lambda df: df

    # the cut of each leaf: two more digits of the order key a pass, within the cell that holds the cut so far
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    placed = light.alias("r").join(sent(plan).alias("p"), same("r", "p")).select(
        "r.*", order_key(seed, F.col("p.whole"), F.col("r.id")).alias("place"))
    leaf = Window.partitionBy(*names)
    cuts, rows_left, digits = plan.select(*names, "rest", F.lit("").alias("cell"), F.lit(0).cast("long").alias("before")), total[1], 0
    inside = lambda: placed.alias("r").join(sent(cuts).alias("c"), [*same("r", "c"), F.substring("r.place", 1, digits) == F.col("c.cell")])
    steps = []
    while rows_left > CELL_ROWS and digits < 32:
        digits += 2
        cells = inside_cells(placed, sent(cuts), same, names, digits)
        run = leaf.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("until", F.col("start") + F.sum("cell_tokens").over(run)).withColumn("before", F.col("until") - F.col("cell_tokens"))
        cuts = materialize(cells.where("before <= rest AND until > rest").select(*names, "rest", "cell", "before", "cell_rows"), "mix-cuts")
        steps.append(cuts)
        rows_left = cuts.agg(F.coalesce(F.max("cell_rows"), F.lit(0))).first()[0]
    by_place = inside().groupBy(*[F.col(f"r.{k}") for k in names], "r.place").agg(
        F.sum("r.n_tokens").alias("n_tokens"), F.first("c.before").alias("before"), F.first("c.rest").alias("rest"))
    until = F.col("before") + F.sum("n_tokens").over(leaf.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first_out = materialize(by_place.withColumn("until", until).where("until > rest").groupBy(*names).agg(F.min("place").alias("first_out")), "mix-out")
    discard(light, leaves, *steps)
    plan = plan.alias("p").join(first_out.alias("f"), same("p", "f"), "left").select("p.*", "f.first_out")
    # without a place that is left out, the rest took the whole leaf: only an empty leaf or an exact fit gets here
    taken = F.when(F.col("p.first_out").isNull(), F.col("p.tokens") <= F.col("p.rest")).otherwise(
        order_key(seed, F.col("p.whole"), F.col(f"r.{id_col}")) < F.col("p.first_out"))
    return rows.alias("r").join(sent(plan).alias("p"), same("r", "p")).select(
        *[F.col(f"r.{c}") for c in keep], "r.n_tokens", F.col("p.budget").alias("leaf_budget"),
        F.least(F.col("p.whole") + taken.cast("long"), F.lit(max_epochs).cast("long")).alias("copies"))


def inside_cells(placed: DataFrame, cuts: DataFrame, same, names: list[str], digits: int) -> DataFrame:
    """Tokens and rows of every leaf's cells of `digits` digits within the cell that holds its cut so far; combined map-side."""
    rows = placed.alias("r").join(cuts.alias("c"), [*same("r", "c"), F.substring("r.place", 1, digits - 2) == F.col("c.cell")])
    return rows.groupBy(*[F.col(f"r.{k}") for k in names], F.substring("r.place", 1, digits).alias("cell")).agg(
        F.sum("r.n_tokens").alias("cell_tokens"), F.count(F.lit(1)).alias("cell_rows"), F.first("c.rest").alias("rest"), F.first("c.before").alias("start"))


def default_levels(domains: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Domain (the one whose list of sources names the row's, else "other"), language, source."""
    pairs = [x for d, sources in sorted((domains or {}).items()) for s in sources for x in (F.lit(s), F.lit(d))]
    known = F.create_map(*pairs)[F.coalesce(F.col("source"), F.lit(""))] if pairs else F.lit(None).cast("string")
    return {"domain": F.coalesce(known, F.lit("other")), "lang": F.col("lang"), "source": F.col("source")}
