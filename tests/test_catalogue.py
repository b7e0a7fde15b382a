"""Catalogue queries against their SQL on the smallest tables, and the parts that serve applications."""

import importlib.util

import duckdb
import pytest

from strataline import catalogue, fulfilment
from strataline.executions import ExecutionStore
from strataline.model import EngineError
from strataline.session import Engine
from strataline.sources.journal import Journal, datom, datoms
from strataline.sources.replication import Replicated

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["reply_closure", "same_generation", "even_odd_path", "unreturned_orders", "two_level_negation", "constant_facts_join", "agg_multi", "agg_empty", "lww_as_of", "set_first_add_source",
          "sequence_order", "dependency_violations", "append_violations", "policy_negation", "vector_topk_as_of", "cut_delta", "page", "nearest_rank",
          "claimability", "fulfilment_views", "fulfilment_outcomes", "fulfilment_handovers", "explain_lineage", "cut_digest", "append_receipts", "append_history", "append_refusals", "scoped_replay_public", "scoped_replay_privileged",
          "scoped_cuts", "scoped_replay_refusal", "policy_closure_violations", "sequence_removals", "partition_state_public", "vector_topk_artifacts", "two_goals", "result_order", "closure_iterations", "tuple_ids", "limits",
          "materialized", "named_query", "agg_provenance", "underscore", "federated_join", "trade_reachability", "retention",
          "tuple_claims", "compile_errors", "plan_phases", "execution_identity", "replica_catch_up"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(names, want.fetchall())


ODD_IDS = {
    "large": "SELECT 3 * 10 ** 12 + i FROM range(12) r(i)", "gaps": "SELECT i * i + 7 FROM range(12) r(i)", "repeated": "SELECT i // 3 FROM range(12) r(i)", "from below 0": "SELECT i - 6 FROM range(12) r(i)",
    "null": "SELECT CASE WHEN i > 4 THEN i END FROM range(12) r(i)", "none": "SELECT i FROM range(0) r(i)",
}


@pytest.mark.parametrize("ids", ODD_IDS)
@pytest.mark.parametrize("kinds", [("error", "purchase", "signup"), ("signup", "click", "purchase"), ("purchase", "signup", None)])
def test_dependencies_of_odd_ids(spark, tmp_path, ids, kinds):
    """Ids as they come: what a purchase or a signup names is judged by the order of events."""
    c = duckdb.connect()
    kind = " ".join(f"WHEN {i} THEN {k!r}" for i, k in enumerate(kinds) if k)
    c.execute(f"COPY (SELECT CAST(id AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(n % 2 AS BIGINT) AS user_id, CASE n % 3 {kind} END AS event_type, 1.0 AS value, '{{}}' AS props FROM (SELECT id, row_number() OVER () - 1 AS n FROM ({ODD_IDS[ids]}) s(id))) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.execute(catalogue.ORACLE["dependency_violations"])
    names = [d[0] for d in want.description]
    got = catalogue.QUERIES["dependency_violations"](spark, str(tmp_path))
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(names, want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_entry_survives_without_llm(monkeypatch):
    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name, *a: None if name.startswith(("strataline.llm", "corpus_pipeline")) else real(name, *a))
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE)


def test_fulfilment_report(spark):
    lines = spark.createDataFrame([(1, 1, 7, "N"), (1, 2, 8, "R"), (2, 1, 7, "N"), (3, 1, 9, "R"), (3, 2, 7, "N")], "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string")
    found = fulfilment.report(spark, fulfilment.board(lines), 1, 1)
    rows = {k: sorted(tuple(r) for r in df.collect()) for k, df in found.items()}
    assert rows["first"] == [(1, 7, 1), (2, 7, 1), (3, 9, 1)] and rows["now"] == [(1, 8, 2), (2, 7, 1), (3, 7, 2)]
    assert rows["honoured"] == [(1, 8, 2), (2, 7, 1), (3, 7, 2)] and rows["superseded"] == [(1, 7, 1), (3, 9, 1)]
    assert rows["load"] == [(8, 1)] and rows["may_take"] == [(1, 7)]  # order 1's delivery came back
    assert sorted((r["change"], r["key"], r["after"]["s"]) for r in fulfilment.handovers(found).collect()) == [("changed", 1, 8), ("changed", 3, 7)]
    assert "## now (3)" in fulfilment.markdown(found)


def test_handles_survive_the_driver(spark, tmp_path):
    document = "schema v1 {\n}\npredicates {\ne(U64, U64)\np(U64, U64)\n}\nfacts {\ne(1, 2)\ne(2, 3)\n%s}\nrules {\np(x, y) <- e(x, y)\np(x, z) <- p(x, y), e(y, z)\n}\n"
    engine = Engine(spark)
    store = ExecutionStore(spark, str(tmp_path / "x"), retained=1)
    first = store.run(engine, document % "")
    h = store.handle(first, 3)
    later = ExecutionStore(spark, store.path, retained=1)  # nothing lives in the first store alone
    assert later.resolve(h.token).count() == 2 and later.verify(h.token, Engine(spark))
    other = Engine(spark).bind("e", spark.createDataFrame([(3, 1)], "x long, y long"))
    assert not later.verify(h.token, other)  # other rows, another derivation
    second = later.run(engine, document % "e(3, 4)\n")
    for call, code in ((lambda: later.resolve(h.token), "ExecutionExpired"), (lambda: later.handle(first, 1), "ExecutionExpired"), (lambda: later.record("f" * 32), "UnknownExecution"),
                       (lambda: later.find(f"{second}.no"), "UnknownHandle"), (lambda: later.find("../x"), "UnknownHandle")):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code == code
    assert not (tmp_path / "x" / "lineage" / first).exists()


def test_replication(spark, tmp_path):
    a, b = Journal(spark, str(tmp_path / "a")), Journal(spark, str(tmp_path / "b"))
    pair = Replicated("a", {"a": a, "b": b})
    pair.append(datoms(spark, [datom(1, 1, "String", "x", "Assert", 1)]), 1)
    assert pair.lag("b") == 1 and pair.catch_up("b") == 1 and pair.lag("b") == 0
    assert a.cut() == b.cut() and pair.promote("b") == 2
    with pytest.raises(EngineError) as e:
        pair.append(datoms(spark, [datom(1, 1, "String", "y", "Assert", 2)]), 1)
    assert e.value.code == "StaleEpoch"
