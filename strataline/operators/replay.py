"""Replay of a journal prefix into state.

State is long: entity, attribute, pos (place within the attribute), value, source (element that set it), caps, vis, first
(seq at which the entity was first touched) and ord.  Order is journal order only: seq.  Everything but sequences is a
grouped aggregate that combines before the shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import contains, visible
from ..model import CLEARS, SETS, AttributeClass, EngineError, Schema, Scope
from ..storage import numbered

#: The tagged value of a journal row.
VALUE = "struct<tag:string,b:boolean,i:long,f:double,s:string,x:binary,items:array<string>>"
FIELD = {"Bool": "b", "I64": "i", "U64": "i", "Entity": "i", "F64": "f", "String": "s", "Bytes": "x", "List": "items"}


def prefix(journal: DataFrame, as_of: int | None) -> DataFrame:
    """Rows up to the position of an element, itself included; the comparison on seq reaches the scan."""
    if as_of is None:
        return journal
    found = journal.where(F.col("element") == as_of).agg(F.min("seq")).first()[0]
    if found is None:
        raise EngineError("UnknownElement", f"element {as_of}")
    return journal.where(F.col("seq") <= found)


def scoped(journal: DataFrame, as_of: int | None, scope: Scope) -> DataFrame:
    """A prefix as the scope sees it: cut first, then certified, then without its hidden rows.

    A hidden target is an unknown element.  A visible row that depends on what the scope cannot see, on nothing or on
    something later, makes the whole replay fail; what hidden rows depend on does not matter.
    """
    seen = visible(F.col("policy.capabilities"), F.col("policy.visibilities"), scope)
    rows = journal
    if as_of is not None:
        found = journal.where((F.col("element") == as_of) & seen).agg(F.min("seq")).first()[0]
        if found is None:
            raise EngineError("UnknownElement", f"element {as_of}")
        rows = journal.where(F.col("seq") <= found)
    bad = unavailable(rows, scope).agg(F.min(F.struct("seq", "place", "kind", "element")).alias("first")).first()["first"]
    if bad is not None:
        raise EngineError("UnavailableDependency", f"{bad['kind']} of element {bad['element']}")
    return rows.where(seen)


def visible_cut(journal: DataFrame, as_of: int | None, scope: Scope) -> int | None:
    """The last element that a scoped replay keeps."""
    return scoped(journal, as_of, scope).agg(F.max_by("element", "seq")).first()[0]


def unavailable(rows: DataFrame, scope: Scope) -> DataFrame:
    """(seq, element, kind, place) of dependencies of visible rows that are hidden, absent, later, more restricted or no anchor.

    Parents of an insertion are its anchor: one earlier insertion of the same sequence, none for the first one only.
    """
    none = F.array().cast("array<long>")
    inserts = F.col("op") == "InsertAfter"
    has = {f.name for f in rows.schema["provenance"].dataType.fields} if "provenance" in rows.columns and hasattr(rows.schema["provenance"].dataType, "fields") else set()
    parents = F.coalesce("provenance.parent_datom_ids", none) if "parent_datom_ids" in has else none
    frontier = F.coalesce("frontier", none) if "frontier" in rows.columns else none
    light = rows.select("seq", "element", "entity", "attribute", "policy", inserts.alias("inserts"), parents.alias("parents"), frontier.alias("frontier"))
    seen = light.where(visible(F.col("policy.capabilities"), F.col("policy.visibilities"), scope))
    part = lambda kind, place: F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"))
    edges = seen.where((F.size("parents") > 0) | (F.size("frontier") > 0)).select("*", F.explode(F.concat(
        F.transform("parents", lambda d: F.struct(d.alias("dependency"), F.when(F.col("inserts"), part("sequence-anchor", 0)).otherwise(part("provenance-parent", 0)).alias("as"))),
        F.transform("frontier", lambda d: F.struct(d.alias("dependency"), part("causal-frontier", 1).alias("as"))))).alias("edge")).select(
        "*", "edge.dependency", "edge.as.kind", "edge.as.place").drop("edge")
    known = light.select(F.col("element").alias("dependency"), F.col("seq").alias("d_seq"), F.col("entity").alias("d_entity"), F.col("attribute").alias("d_attribute"), F.col("policy").alias("d_policy"), F.col("inserts").alias("d_inserts"))
    joined = edges.join(known, "dependency", "left")
    open_to = contains(F.col("d_policy.capabilities"), F.col("policy.capabilities")) & contains(F.col("d_policy.visibilities"), F.col("policy.visibilities"))
    elsewhere = (F.col("kind") == "sequence-anchor") & ((F.col("d_entity") != F.col("entity")) | (F.col("d_attribute") != F.col("attribute")) | ~F.col("d_inserts"))
    # what is contained in a visible row's policy is visible itself
    by_edge = joined.where(F.col("d_seq").isNull() | (F.col("d_seq") >= F.col("seq")) | ~open_to | elsewhere).select("seq", "element", "kind", "place")
    anchors = seen.where("inserts AND size(parents) <> 1")
    first = seen.where("inserts").groupBy("entity", "attribute").agg(F.min("seq").alias("first"))
    alone = anchors.join(first, ["entity", "attribute"]).where("size(parents) > 1 OR seq > first").select("seq", "element", F.lit("sequence-anchor").alias("kind"), F.lit(0).alias("place"))
    return by_edge.union(alone)


def operation_errors(journal: DataFrame, schema: Schema) -> DataFrame:
    """Rows whose operation their attribute's class does not accept, or whose attribute is unknown."""
    ok = F.lit(False)
    for a in schema.attributes.values():
        ok = F.when(F.col("attribute") == a.id, F.col("op").isin(*SETS[a.cls], *CLEARS[a.cls])).otherwise(ok)
    return journal.where(~ok)


def _ids(schema: Schema, *classes: AttributeClass) -> list[int]:
    return [a.id for a in schema.attributes.values() if a.cls in classes]


def scalars(journal: DataFrame, schema: Schema) -> DataFrame:
    """The last operation decides; a clearing one empties the attribute whatever its value."""
    rows = journal.where(F.col("attribute").isin(_ids(schema, AttributeClass.SCALAR, AttributeClass.REF)))
    last = rows.groupBy("entity", "attribute").agg(F.max_by(F.struct("op", "value", "element", "policy", "seq"), "seq").alias("last"))
    return last.where(~F.col("last.op").isin(*CLEARS[AttributeClass.SCALAR])).select(
        "entity", "attribute", F.lit(0).cast("long").alias("pos"), F.col("last.value").alias("value"), F.col("last.element").alias("source"), F.col("last.policy").alias("policy"))


def sets(journal: DataFrame, schema: Schema) -> DataFrame:
    """A value is present from its first add after its last removal; that add is its source."""
    rows = journal.where(F.col("attribute").isin(_ids(schema, AttributeClass.SET, AttributeClass.REF_SET)))
    gone = F.col("op").isin(*CLEARS[AttributeClass.SET])
    # map-side: the last removal, then the first add beyond it; both passes combine before the shuffle
    key = [F.col("entity"), F.col("attribute"), F.to_json("value").alias("value_key")]
    removed = rows.where(gone).groupBy(*key).agg(F.max("seq").alias("removed"))
    adds = rows.where(~gone).select("*", F.to_json("value").alias("value_key")).alias("a").join(
        removed.alias("r"), [F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("entity", "attribute", "value_key")], "left").where(
        F.col("a.seq") > F.coalesce(F.col("r.removed"), F.lit(-1))).select("a.*")
    first = adds.groupBy("entity", "attribute", "value_key").agg(F.min_by(F.struct("value", "element", "policy", "seq"), "seq").alias("first"))
    return first.select("entity", "attribute", F.col("first.seq").alias("pos"), F.col("first.value").alias("value"), F.col("first.element").alias("source"), F.col("first.policy").alias("policy"))


def _sequence(pdf: pd.DataFrame) -> pd.DataFrame:
    """One sequence: children of an anchor by ascending element, depth first; removal drops all live entries of a value."""
    children: dict[object, list[int]] = {}
    rows, live = {}, {}
    for r in pdf.sort_values("seq").itertuples(index=False):
        if r.op == "InsertAfter":
            anchors = [int(x) for x in (r.parents if r.parents is not None else [])]
            if len(anchors) > 1:
                raise EngineError("MalformedSequenceAnchor", f"element {r.element} names {len(anchors)} anchors")
            if anchors and anchors[0] not in rows:
                raise EngineError("UnknownSequenceAnchor", f"element {r.element} follows {anchors[0]}")
            if not anchors and rows:
                raise EngineError("MissingSequenceAnchor", f"element {r.element} names no anchor")
            rows[int(r.element)] = r
            live[int(r.element)] = True
            children.setdefault(anchors[0] if anchors else None, []).append(int(r.element))
        else:
            for e, x in rows.items():
                if live[e] and x.value_key == r.value_key:
                    live[e] = False
    order, todo = [], sorted(children.get(None, []), reverse=True)
    while todo:
        e = todo.pop()
        order.append(e)
        todo += sorted(children.get(e, []), reverse=True)
    kept = [e for e in order if live[e]]
    return pd.DataFrame({"entity": [rows[e].entity for e in kept], "attribute": [rows[e].attribute for e in kept], "pos": range(len(kept)), "source": kept}).astype("int64")


def sequences(journal: DataFrame, schema: Schema) -> DataFrame:
    """Only ids and anchors go through Python, one sequence at a time; values join back by element."""
    rows = journal.where(F.col("attribute").isin(_ids(schema, AttributeClass.SEQUENCE)))
    light = rows.select("entity", "attribute", "seq", "op", "element", F.col("provenance.parent_datom_ids").alias("parents"), F.to_json("value").alias("value_key"))
    placed = light.groupBy("entity", "attribute").applyInPandas(_sequence, "entity long, attribute long, pos long, source long")
    return placed.join(rows.where("op = 'InsertAfter'").select(F.col("element").alias("source"), "value", "policy"), "source").select(
        "entity", "attribute", "pos", "value", "source", "policy")


def state(journal: DataFrame, schema: Schema) -> DataFrame:
    """State after all rows of a prefix."""
    parts = []
    for make, classes in ((scalars, (AttributeClass.SCALAR, AttributeClass.REF)), (sets, (AttributeClass.SET, AttributeClass.REF_SET)), (sequences, (AttributeClass.SEQUENCE,))):
        if _ids(schema, *classes):
            parts.append(make(journal, schema))
    if not parts:
        raise EngineError("EmptySchema", "no attributes")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bound(current: DataFrame, touched: DataFrame | None, attribute: int, type, full: bool) -> DataFrame:
    """A bound predicate's rows (c0 entity, c1 value), with META columns in full mode; entities in order of first touch."""
    rows = current.where(F.col("attribute") == attribute)
    value = F.col(f"value.{FIELD['List' if type.item else type.name]}").cast(type.spark())
    out = [F.col("entity").alias("c0"), value.alias("c1")]
    if not full:
        return rows.select(*out)
    if touched is not None:
        rows = rows.join(touched, "entity")
    none = F.array().cast("array<string>")
    # places in the documented order, without gaps: entities by first touch, then their facts
    rows, _ = numbered(rows.select(*out, "source", "policy", "entity", "pos", *(["first"] if touched is not None else [])).orderBy(*(["first"] if touched is not None else []), "entity", "pos", "source"), "bound")
    return rows.select(
        "c0", "c1", F.lit(None).cast("long").alias("_tid"), F.array("source").alias("_src"), F.array().cast("array<struct<partition:string,as_of:long>>").alias("_cuts"),
        F.coalesce("policy.capabilities", none).alias("_caps"), F.coalesce("policy.visibilities", none).alias("_vis"), F.col("_n").alias("_ord"))
