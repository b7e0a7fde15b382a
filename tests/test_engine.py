"""Evaluation: recursion, negation, aggregates, policy, views, lineage."""

import pytest

from strataline import Engine, Scope
from strataline.model import EngineError
from strataline.operators.fixpoint import Limits
from strataline.sources.journal import datom, datoms, numbered

# The documented closure program; a chain of n entities must give n (n - 1) / 2 pairs.
CLOSURE = """
schema v1 {
  attr task.depends_on: RefSet<Entity>
}
predicates {
  task_depends_on(Entity, Entity)
  reach(Entity, Entity)
  reach_count(Entity, U64)
}
rules {
  reach(x, y) <- task_depends_on(x, y)
  reach(x, z) <- reach(x, y), task_depends_on(y, z)
  reach_count(x, count(y)) <- reach(x, y)
}
query {
  %s
  goal reach(x, y)
}
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return numbered(datoms(spark, [datom(e, 1, "Entity", e + 1, "Add", e) for e in range(1, 9)])).cache()


def test_chain_has_closed_form(spark, chain):
    assert Engine(spark, chain).run(CLOSURE % "current").primary.count() == 9 * 8 // 2


def test_view_as_of(spark, chain):
    assert Engine(spark, chain).run(CLOSURE % "as_of e3").primary.count() == 4 * 3 // 2
    with pytest.raises(EngineError):
        Engine(spark, chain).run(CLOSURE % "as_of e99")


def test_rounds_and_lineage(spark, chain):
    engine = Engine(spark, chain.where("seq <= 4"))
    result = engine.evaluate(engine.parse(CLOSURE % "current"), full=True, wanted=["reach"])
    assert result.derived.rounds == [(1, 4), (2, 3), (3, 2), (4, 1), (6, 0)]
    trace = result.trace("reach(entity(1), entity(5))")
    assert trace.count() == 4
    top = trace.orderBy("tuple_id", ascending=False).first()
    assert top["sources"] == [1, 2, 3, 4] and top["iteration"] == 4
    with pytest.raises(EngineError):
        result.trace("reach(entity(5), entity(1))")


def test_limits(spark, chain):
    for limits in (Limits(iterations=2), Limits(tuples=2)):
        with pytest.raises(EngineError):
            engine = Engine(spark, chain, limits)
            engine.evaluate(engine.parse(CLOSURE % "current"), iterations=True)
    with pytest.raises(EngineError):
        Engine(spark, limits=Limits(document_bytes=10)).parse(CLOSURE)


def document(predicates, rules, facts="", goal=None):
    query = f"query {{\ngoal {goal}\n}}\n" if goal else ""
    return f"schema v1 {{\n}}\npredicates {{\n{predicates}\n}}\nfacts {{\n{facts}\n}}\nrules {{\n{rules}\n}}\n{query}"


def test_cycle_and_mutual_recursion(spark):
    facts = "e(1, 2)\ne(2, 3)\ne(3, 1)"
    assert Engine(spark).run(document("e(U64, U64)\np(U64, U64)", "p(x, y) <- e(x, y)\np(x, z) <- p(x, y), p(y, z)", facts, "p(x, y)")).primary.count() == 9
    both = Engine(spark).run(document("e(U64, U64)\no(U64, U64)\nv(U64, U64)", "o(x, y) <- e(x, y)\nv(x, z) <- o(x, y), e(y, z)\no(x, z) <- v(x, y), e(y, z)", facts, "v(1, y)")).primary
    assert rows(both) == [(1,), (2,), (3,)]


def test_facts_aggregates(spark):
    facts = "project(10, 101)\nproject(10, 102)\nhours(101, 3)\nhours(102, 5)\nattempt(1, \"a\", 1)\nattempt(1, \"b\", 4)"
    text = document("project(U64, U64)\nhours(U64, U64)\nattempt(U64, String, U64)\nstats(U64, U64, U64)\nlatest(U64, U64)\nnone(U64)",
                    'stats(p, count(t), sum(h)) <- project(p, t), hours(t, h)\nlatest(t, max(e)) <- attempt(t, w, e)\nnone(count(t)) <- hours(t, 99)', facts)
    engine = Engine(spark)
    result = engine.evaluate(engine.parse(text))
    assert rows(result.relation("stats")) == [(10, 2, 8)] and rows(result.relation("latest")) == [(1, 4)] and rows(result.relation("none")) == []


def test_distinct_bindings_not_distinct_values(spark):
    text = document("a(U64, U64)\nn(U64, U64, U64)", "n(x, count(y), sum(y)) <- a(x, y), a(x, z)", "a(1, 5)\na(1, 5)\na(1, 7)", "n(x, c, s)")
    assert rows(Engine(spark).run(text).primary) == [(1, 4, 24)]


def test_queries_are_bags_and_rules_sets(spark):
    text = document("a(U64)\nb(U64)", "b(x) <- a(x)", "a(1)\na(1)", "a(x)")
    run = Engine(spark).run(text)
    assert rows(run.primary) == [(1,), (1,)]
    engine = Engine(spark)
    assert rows(engine.evaluate(engine.parse(text)).relation("b")) == [(1,)]


def test_unconditional_rule_and_underscore(spark):
    text = document("a(U64, U64)\nb(U64)", "b(7) <-\nb(x) <- a(x, _), a(_, x)", "a(1, 2)\na(2, 1)\na(3, 4)\na(5, 5)", "b(x)")
    assert rows(Engine(spark).run(text).primary) == [(1,), (2,), (5,), (7,)]


def test_missing_source(spark):
    with pytest.raises(EngineError) as e:
        Engine(spark).run(document("a(U64)\nb(U64)", "b(x) <- a(x)", "", "b(x)"))
    assert e.value.code == "MissingSource"


# A documented program and the outcomes it must have.
POLICY = document(
    "edge(U64, U64)\ncandidate(U64)\nblocked(U64)\nscore(U64)\npath(U64, U64)\nready(U64)\nsummary(U64, U64, U64, U64)",
    "path(x, y) <- edge(x, y)\npath(x, z) <- path(x, y), edge(y, z)\nready(x) <- candidate(x), not blocked(x)\nsummary(count(s), sum(s), min(s), max(s)) <- score(s)",
    "edge(1, 2)\ncandidate(1)\nblocked(2)\nscore(2)\nscore(7)\n%s")
HIDDEN = 'edge(2, 3) @capability("restricted")\nblocked(1) @capability("restricted")\nscore(100) @capability("restricted")'


def test_policy_noninterference(spark):
    engine = Engine(spark)
    names = ("path", "ready", "summary")
    public = engine.evaluate(engine.parse(POLICY % HIDDEN), full=True)
    without = engine.evaluate(engine.parse(POLICY % ""), full=True)
    for n in names:  # hidden facts change nothing, metadata included
        assert [str(r) for r in public.relation(n).orderBy("_tid").collect()] == [str(r) for r in without.relation(n).orderBy("_tid").collect()]
    seen = engine.evaluate(engine.parse(POLICY % HIDDEN), scope=Scope(("restricted",)))
    assert rows(seen.relation("path")) == [(1, 2), (1, 3), (2, 3)] and rows(seen.relation("ready")) == [] and rows(seen.relation("summary")) == [(3, 109, 2, 100)]
    assert rows(public.relation("summary").select("c0", "c1", "c2", "c3")) == [(2, 9, 2, 7)]


def test_views_of_one_journal(spark):
    """A scalar read by name at three cuts; equal runs have one identity, other histories another."""
    rows_ = [(e, 1, "String", v, op, i) for i, (e, v, op) in enumerate([(1, "new", "Assert"), (2, "new", "Assert"), (1, "paid", "Assert"), (2, "", "Retract"), (1, "sent", "Claim")], 1)]
    journal = numbered(datoms(spark, [datom(*r) for r in rows_]))
    text = "schema v1 {\nattr order.state: ScalarLww<String>\n}\npredicates {\norder_state(Entity, String)\nbusy(Entity)\n}\nrules {\nbusy(o) <- order_state(o, s)\n}\nquery now {\ngoal order_state(o, s)\n}\nquery early {\nas_of e3\ngoal order_state(o, s)\n}\nquery who {\nas_of e2\ngoal busy(o)\n}\n"
    run = Engine(spark, journal).run(text)
    assert rows(run.queries["now"]) == [(1, "sent")] and rows(run.queries["early"]) == [(1, "paid"), (2, "new")] and rows(run.queries["who"]) == [(1,), (2,)]
    assert run.identity == Engine(spark, journal).run(text).identity != Engine(spark, journal.where("seq < 5")).run(text).identity


def test_plan_of_another_version_is_refused(spark):
    engine = Engine(spark)
    from strataline.operators.fixpoint import Evaluation
    from strataline.plans.compiler import compile_program

    plan = compile_program(engine.parse(document("a(U64)\nb(U64)", "b(x) <- a(x)", "a(1)")))
    plan.version += 1
    with pytest.raises(EngineError) as e:
        Evaluation(spark, plan, lambda p: None)
    assert e.value.code == "PlanVersion"


def test_float_and_bytes_keys_follow_their_format(spark):
    import struct

    from strataline.functions.ordering import typed_key
    from strataline.model import Type

    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, 3.141592653589793, float("inf"), float("-inf")]
    df = spark.createDataFrame([(x, bytearray(b"\x00\xff7"), [1, 2]) for x in numbers], "x double, b binary, l array<long>")
    got = df.select(typed_key(df.x, Type("F64")).alias("x"), typed_key(df.b, Type("Bytes")).alias("b"), typed_key(df.l, Type("List", Type("U64"))).alias("l")).collect()
    assert [r["x"] for r in got] == ["f64:" + struct.pack(">d", x).hex() for x in numbers]
    assert got[0]["b"] == "bytes:[0, 255, 55]" and got[0]["l"] == "list:[u64:1,u64:2,]"


def test_sweep_deletes_what_was_written(spark):
    import os

    from strataline import storage

    kept = dict(storage._WRITTEN)  # of other tests, whose results may still be read
    storage._WRITTEN.clear()
    table, n = storage.counted(spark.range(7).toDF("x"), "sweep")
    placed, m = storage.numbered(spark.range(20).repartition(5).orderBy("id"), "sweep")
    assert n == table.count() == 7 and m == 20 and [r["_n"] for r in placed.orderBy("id").collect()] == list(range(20))
    path = table._strataline_path
    assert os.path.isdir(path) and storage.sweep() == 2 and not os.path.exists(path) and storage.sweep() == 0
    storage._WRITTEN.update(kept)
