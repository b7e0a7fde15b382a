"""Replay, admission, federation, vectors, tuple space, streaming."""

import pytest
from pyspark.sql import functions as F

from strataline.model import CLEARS, OPERATIONS, SETS, AttributeClass, EngineError, Schema, Scope, Type
from strataline.operators import query as q
from strataline.operators import replay
from strataline.sources import journal as js
from strataline.sources import vectors
from strataline.sources.federation import Cut, Federation, Import
from strataline.sources.journal import Journal, datom, datoms, numbered
from strataline.sources.tuplespace import TupleSpace
from strataline.storage import Documents

STRING, ENTITY = Type("String"), Type("Entity")


def schema():
    s = Schema()
    s.attribute("task.status", AttributeClass.SCALAR, STRING)
    s.attribute("task.tag", AttributeClass.SET, STRING)
    s.attribute("task.steps", AttributeClass.SEQUENCE, STRING)
    return s


def journal(spark, rows):
    return numbered(datoms(spark, rows))


def strings(state, attribute):
    return [r[0] for r in state.where(f"attribute = {attribute}").orderBy("entity", "pos").select("value.s").collect()]


def test_scalar_set_sequence(spark):
    rows = [datom(1, 1, "String", "queued", "Assert", 1), datom(1, 1, "String", "other", "Retract", 2), datom(1, 2, "String", "ops", "Add", 3), datom(1, 2, "String", "x", "Add", 4), datom(1, 2, "String", "x", "Remove", 5),
            datom(1, 3, "String", "a", "InsertAfter", 6), datom(1, 3, "String", "c", "InsertAfter", 7, parents=[6]), datom(1, 3, "String", "b", "InsertAfter", 8, parents=[6]), datom(1, 3, "String", "a", "Remove", 9),
            datom(1, 3, "String", "c", "Retract", 10), datom(1, 2, "String", "ops", "Add", 11), datom(1, 1, "String", "done", "Claim", 12)]
    j = journal(spark, rows)
    at8, now = replay.state(replay.prefix(j, 8), schema()), replay.state(j, schema())
    assert strings(at8, 3) == ["a", "c", "b"] and strings(now, 3) == ["b"]
    assert strings(at8, 1) == [] and strings(now, 1) == ["done"]
    assert [(r["value"]["s"], r["source"]) for r in now.where("attribute = 2").collect()] == [("ops", 3)]
    last = replay.state(replay.prefix(j, 12), schema())
    assert sorted(map(str, now.collect())) == sorted(map(str, last.collect()))


def test_operation_matrix(spark):
    for cls in AttributeClass:
        s = Schema()
        s.attribute("a", cls, STRING)
        j = journal(spark, [datom(1, 1, "String", "v", op, i) for i, op in enumerate(OPERATIONS, 1)])
        refused = {r["op"] for r in replay.operation_errors(j, s).collect()}
        assert refused == set(OPERATIONS) - set(SETS[cls]) - set(CLEARS[cls])


@pytest.mark.parametrize("parents,code", [([], "MissingSequenceAnchor"), ([1, 2], "MalformedSequenceAnchor"), ([9], "Missing"), ([3], "Forward")])
def test_sequence_certification(spark, parents, code):
    j = journal(spark, [datom(1, 3, "String", "a", "InsertAfter", 1), datom(1, 3, "String", "b", "InsertAfter", 2, parents=[1]), datom(1, 3, "String", "c", "InsertAfter", 3, parents=parents)])
    assert code in {r["code"] for r in js.dependency_errors(j, schema()).collect()}


def test_policy_closure_and_scoped_replay(spark):
    hidden = {"capabilities": ["ops"], "visibilities": []}
    j = journal(spark, [datom(1, 1, "String", "open", "Assert", 1), datom(1, 1, "String", "secret", "Assert", 2, policy=hidden), datom(2, 1, "String", "x", "Assert", 3, parents=[2])])
    assert [r["code"] for r in js.dependency_errors(j, schema()).collect()] == ["PolicyNotClosed"]
    with pytest.raises(EngineError) as e:  # a visible row cites a hidden one
        replay.scoped(j, None, Scope())
    assert e.value.code == "UnavailableDependency" and "provenance-parent of element 3" in str(e.value)
    assert strings(replay.state(replay.scoped(j.where("seq < 3"), None, Scope()), schema()), 1) == ["open"]
    assert strings(replay.state(replay.scoped(j.where("seq < 3"), None, Scope(("ops",))), schema()), 1) == ["secret"]
    with pytest.raises(EngineError):
        replay.scoped(j, 2, Scope())


def test_append_receipts_and_conditions(spark, tmp_path):
    book = Journal(spark, str(tmp_path / "j"), schema())
    batch = datoms(spark, [datom(1, 1, "String", "queued", "Assert", 1), datom(1, 2, "String", "ops", "Add", 2)])
    first = book.append(batch, idempotency_key="k")
    assert book.append(batch, idempotency_key="k") == first and first["entry_count"] == 2
    with pytest.raises(EngineError) as e:
        book.append(datoms(spark, [datom(1, 1, "String", "z", "Assert", 3)]), idempotency_key="k")
    assert e.value.code == "IdempotencyConflict"
    with pytest.raises(EngineError) as e:
        book.append(batch)
    assert e.value.code == "AppendRefused"
    here = book.cut()
    book.append(datoms(spark, [datom(1, 1, "String", "done", "Assert", 3)]), expected=here)
    with pytest.raises(EngineError) as e:
        book.append(datoms(spark, [datom(1, 1, "String", "late", "Assert", 4)]), expected=here)
    assert e.value.code == "CutMismatch"
    assert [r["element"] for r in book.history().collect()] == [1, 2, 3] and book.receipts().count() == 2
    bad = datoms(spark, [datom(1, 1, "U64", 3, "Assert", 5), datom(1, 9, "String", "", "Assert", 6), datom(1, 1, "Null", None, "Assert", 7), datom(1, 1, "String", "", "Add", 8)])
    assert {r["element"]: r["code"] for r in book.dry_run(bad).collect()} == {5: "ValueType", 6: "UnknownAttribute", 7: "NullValue", 8: "InvalidOperation"}
    additive = schema()
    additive.attribute("task.more", AttributeClass.SCALAR, STRING)
    first = book.register(schema())
    assert book.activate(first) == "Exact"
    assert book.activate(book.register(additive, first, "Additive")) == "Additive"
    assert Journal(spark, book.path).schema == additive and [r["status"] for r in book.schemas()].count("Active") == 1
    narrow = Schema()
    narrow.attribute("task.status", AttributeClass.SET, STRING)
    other = Journal(spark, str(tmp_path / "other"), schema())
    other.append(datoms(spark, [datom(1, 1, "String", "queued", "Assert", 1)]))
    with pytest.raises(EngineError) as e:
        other.activate(other.register(narrow))
    assert e.value.code == "SchemaQuarantined" and [r["status"] for r in other.schemas()] == ["Quarantined"] and other.active() is None
    with pytest.raises(EngineError):
        book.register(narrow, first, "Additive")


def test_append_after_a_lost_driver(spark, tmp_path, monkeypatch):
    book = Journal(spark, str(tmp_path / "j"), schema())
    book.append(datoms(spark, [datom(1, 1, "String", "queued", "Assert", 1)]))
    with monkeypatch.context() as m:
        m.setattr(Documents, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):  # the batch is written, its receipt is not
            book.append(datoms(spark, [datom(1, 1, "String", "lost", "Assert", 2)]))
    again = Journal(spark, book.path, schema())
    assert again.scan().count() == 1
    receipt = again.append(datoms(spark, [datom(1, 1, "String", "done", "Assert", 2)]))
    assert receipt["first_seq"] == 2 and strings(replay.state(again.scan(), schema()), 1) == ["done"]
    assert again.cut() == js.cut(again.scan()).first().asDict()  # digests add up
    assert (tmp_path / "j" / "batches").is_dir() and len(list((tmp_path / "j" / "batches").glob("first=*2-*"))) == 2


def test_two_writers_are_fenced(spark, tmp_path, monkeypatch):
    a, b = Journal(spark, str(tmp_path / "j"), schema()), Journal(spark, str(tmp_path / "j"), schema())
    a.append(datoms(spark, [datom(1, 1, "String", "queued", "Assert", 1)]))
    seen = b._receipts()
    a.append(datoms(spark, [datom(1, 1, "String", "a", "Assert", 2)]))
    monkeypatch.setattr(b, "_receipts", lambda: seen)  # b has read the journal before a's second append
    with pytest.raises(EngineError) as e:
        b.append(datoms(spark, [datom(1, 1, "String", "b", "Assert", 3)]))
    assert e.value.code == "CutMismatch" and [r["element"] for r in a.history().collect()] == [1, 2]


def test_digest_covers_every_column(spark, tmp_path):
    base = datom(1, 1, "String", "x", "Assert", 1, author_principal="p")
    hidden = {"capabilities": ["b", "a"], "visibilities": []}
    other = [{**base, "policy": hidden}, {**base, "replica": 2}, {**base, "frontier": [7]}, datom(1, 1, "String", "x", "Assert", 1, author_principal="q"), datom(1, 1, "String", "y", "Assert", 1, author_principal="p")]
    digests = [js.cut(journal(spark, [r])).first()["digest"] for r in [base, *other]]
    assert len(set(digests)) == len(digests)
    same = {**base, "policy": {"capabilities": ["a", "b", "a"], "visibilities": []}}
    assert js.cut(journal(spark, [same])).first()["digest"] == digests[1]  # lists of a policy have no order
    book = Journal(spark, str(tmp_path / "j"), schema())
    book.append(datoms(spark, [base]), idempotency_key="k")
    for changed in other[:1] + other[3:]:
        with pytest.raises(EngineError) as e:
            book.append(datoms(spark, [changed]), idempotency_key="k")
        assert e.value.code == "IdempotencyConflict"
    diverged = js.prefix_divergence(journal(spark, [base]), journal(spark, [other[4]])).collect()
    assert [(r["seq"], r["leader"], r["follower"]) for r in diverged] == [(1, 1, 1)]


def test_numbering_follows_input_order(spark):
    rows = datoms(spark, [datom(i, 1, "String", "x", "Assert", 1000 - i) for i in range(300)]).repartition(7)
    order = [r["element"] for r in rows.collect()]
    got = numbered(rows, 5).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(5, 305)) and sorted(r["element"] for r in got) == sorted(order)
    ranged = numbered(rows.orderBy("element")).orderBy("seq").collect()
    assert [r["element"] for r in ranged] == sorted(order)


OPS = {"capabilities": ["ops"], "visibilities": []}


@pytest.mark.parametrize("rows,public,privileged", [
    # a row's: element, parents, frontier, policy, attribute 1 (scalar) or 3 (sequence); outcomes: visible cut, or the error's text
    ([(1, [], [], None, 1), (2, [], [], OPS, 1)], 1, 2),
    ([(1, [], [], OPS, 1), (2, [1], [], None, 1)], "provenance-parent of element 2", "provenance-parent of element 2"),
    ([(2, [1], [], None, 1)], "provenance-parent of element 2", "provenance-parent of element 2"),
    ([(1, [], [], None, 1), (2, [1], [], OPS, 1)], 1, 2),
    ([(1, [], [], None, 1), (2, [99], [], OPS, 1)], 1, "provenance-parent of element 2"),
    ([(1, [2], [3], None, 1), (2, [], [], None, 1), (3, [], [], None, 1)], "provenance-parent of element 1", "provenance-parent of element 1"),
    ([(1, [], [], OPS, 1), (2, [], [1], None, 1)], "causal-frontier of element 2", "causal-frontier of element 2"),
    ([(1, [2], [], None, 3), (2, [], [], None, 3)], "sequence-anchor of element 1", "sequence-anchor of element 1"),
    ([(1, [99], [], None, 3)], "sequence-anchor of element 1", "sequence-anchor of element 1"),
    ([(1, [], [], None, 1), (2, [1], [], None, 3)], "sequence-anchor of element 2", "sequence-anchor of element 2"),
    ([(1, [], [], None, 3), (2, [1], [], OPS, 3)], 1, 2),
    ([(1, [], [], OPS, 3), (2, [1], [], None, 3)], "sequence-anchor of element 2", "sequence-anchor of element 2"),
    ([(1, [], [], None, 3), (2, [], [], None, 3)], "sequence-anchor of element 2", "sequence-anchor of element 2"),
    ([(1, [], [], OPS, 3), (2, [], [], None, 3)], 2, "sequence-anchor of element 2"),
    ([(1, [], [], None, 3), (2, [1], [], None, 3), (3, [1, 2], [], None, 3)], "sequence-anchor of element 3", "sequence-anchor of element 3"),
])
def test_scoped_replay_certifies_dependencies(spark, rows, public, privileged):
    made = [{**datom(1, a, "String", f"v{e}", "Assert" if a == 1 else "InsertAfter", e, parents=parents, policy=policy), "frontier": frontier} for e, parents, frontier, policy, a in rows]
    j = journal(spark, made)
    for scope, want in ((Scope(), public), (Scope(("ops",)), privileged)):
        if isinstance(want, int):
            assert replay.visible_cut(j, None, scope) == want
        else:
            with pytest.raises(EngineError) as e:
                replay.visible_cut(j, None, scope)
            assert e.value.code == "UnavailableDependency" and want in str(e.value)


def test_hidden_and_absent_targets_look_the_same(spark):
    j = journal(spark, [datom(1, 1, "String", "a", "Assert", 1), datom(1, 1, "String", "b", "Assert", 2, policy=OPS), datom(1, 1, "String", "c", "Assert", 3)])
    texts = []
    for target in (2, 7):
        with pytest.raises(EngineError) as e:
            replay.scoped(j, target, Scope())
        texts.append(str(e.value).replace(str(target), "n"))
    assert texts[0] == texts[1] and replay.visible_cut(j, 2, Scope(("ops",))) == 2 and replay.visible_cut(j, 1, Scope()) == 1
    f = Federation(spark, {"p": j})
    assert f.history([Cut("p")]).count() == 2 and f.history([Cut("p")], Scope(("ops",))).count() == 3 and strings(f.state(Cut("p"), schema(), Scope(("ops",))), 1) == ["c"]
    with pytest.raises(EngineError):
        f.history([Cut("p", 2)])


def test_delta_and_page(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (4, "w")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "v")], "k long, v string")
    found = sorted((r["change"], r["key"]) for r in q.delta(a, b).collect())
    assert found == [("added", 3), ("changed", 4), ("removed", 2)]
    last = q.page(a.orderBy("k"), 2, 2).collect()
    assert len(last) == 2 and last[0]["next_offset"] is None
    with pytest.raises(EngineError):
        q.page(a, 0, 0)


def test_federation_keeps_cuts(spark):
    def part(rows):
        return journal(spark, rows)

    text = "schema v1 {{\nattr task.{0}: ScalarLww<String>\n}}\npredicates {{\ntask_{0}(Entity, String)\nout(Entity, String)\n}}\nrules {{\nout(t, v) <- task_{0}(t, v)\n}}\nquery {{\nas_of e{1}\ngoal out(t, v)\n}}\n"
    f = Federation(spark, {"readiness": part([datom(1, 1, "String", "ready", "Assert", 1)]), "authority": part([datom(1, 1, "String", "a", "Assert", 3), datom(1, 1, "String", "b", "Assert", 4)])})
    doc = "schema v1 {\n}\npredicates {\nready(Entity, String)\nowner(Entity, String)\nact(Entity, String)\n}\nrules {\nact(t, w) <- ready(t, s), owner(t, w)\n}\nquery {\ngoal act(t, w)\n}\n"
    imports = [Import(Cut("readiness", 1), text.format("status", 1), "ready"), Import(Cut("authority", 3), text.format("owner", 3), "owner")]
    row = f.run(doc, imports).primary.collect()[0]
    assert (row["t"], row["w"]) == (1, "a") and [(c["partition"], c["as_of"]) for c in row["cuts"]] == [("authority", 3), ("readiness", 1)]
    with pytest.raises(EngineError):
        f.imported(Import(Cut("authority"), text.format("owner", 3), "owner"))
    assert f.history([Cut("authority", 3), Cut("readiness")]).count() == 2


def test_vector_search(spark):
    rows = [("s", "v1", 21, "doc-1", 3, "cosine", [0.8, 0.1, 0.0], 2, None), ("s", "v2", 22, None, 3, "cosine", [0.0, 0.0, 0.0], 3, None), ("s", "v3", 23, None, 3, "cosine", [1.0, 0.0, 0.0], 4, (["ops"], []))]
    cat = spark.createDataFrame(rows, "sidecar_id string, vector_id string, entity long, source_artifact_id string, dimensions int, metric string, embedding array<float>, registered_at long, policy struct<capabilities:array<string>,visibilities:array<string>>")
    art = spark.createDataFrame([("s", "doc-1", "file", 1, None)], "sidecar_id string, artifact_id string, uri string, registered_at long, policy struct<capabilities:array<string>,visibilities:array<string>>")
    log = spark.createDataFrame([(i, i) for i in range(1, 5)], "element long, seq long")
    found = vectors.search(cat, art, [1.0, 0.0, 0.0], sidecar="s", top_k=0, journal=log, as_of=2)
    fact = vectors.as_facts(found, 1).first()
    assert fact["c1"] == 21 and abs(fact["c2"] - 0.8 / 0.65**0.5) < 1e-6 and fact["_src"] == [2, 1]
    everything = vectors.search(cat, art, [1.0, 0.0, 0.0], sidecar="s", scope=Scope(("ops",))).collect()
    assert [r["vector_id"] for r in everything] == ["v3", "v1", "v2"] and everything[2]["score"] == 0.0
    bad = vectors.register_errors(cat.withColumn("dimensions", F.lit(4)), cat, 4, "vector_id", art)
    assert {"NotAtTail", "AnchorUsed", "DuplicateId", "Dimensions"} == {r["code"] for r in bad.collect()}


def test_tuple_space(spark):
    space = TupleSpace(spark)
    a, b = space.out("job", 1), space.out("job", 2)
    claim = space.claim(["job", None], "w", now=0.0, ttl=10.0)
    assert claim.tuple_id == a and [r["tuple_id"] for r in space.read(["job", None], now=5.0).collect()] == [b]
    again = space.claim(["job", 1], "v", now=11.0)
    assert again.lease_epoch == 2
    with pytest.raises(EngineError):
        space.complete(claim)
    space.complete(again, "ok")
    assert space.read(["job", 1]).count() == 0 and space.explain(a) == ["out", "claim", "claim", "complete"]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from strataline.streaming.ingest import ingest

    book = Journal(spark, str(tmp_path / "j"), schema())
    source = str(tmp_path / "in")
    datoms(spark, [datom(1, 1, "String", "queued", "Assert", 1)]).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(js.DATOM).parquet(source)
    ingest(stream(), book, str(tmp_path / "c")).awaitTermination()
    datoms(spark, [datom(1, 1, "String", "done", "Assert", 2)]).write.mode("append").parquet(source)
    ingest(stream(), book, str(tmp_path / "c")).awaitTermination()
    assert [r["element"] for r in book.history().collect()] == [1, 2]


def test_inference(spark):
    j = journal(spark, [datom(1, 5, "Entity", 2, "Add", 1), datom(1, 6, "U64", 2, "Assert", 2), datom(1, 7, "String", "a", "InsertAfter", 3)])
    assert {(r["attribute"], r["class"]) for r in js.inferred(j).collect()} == {(5, "RefSet"), (6, "ScalarLww"), (7, "SequenceRga")}


def test_replica_lag(spark):
    j = journal(spark, [datom(1, 1, "String", "a", "Assert", i) for i in range(1, 6)])
    assert js.prefix_divergence(j, j.where("seq <= 3")).isEmpty() and js.lag(j, j.where("seq <= 3")).first()["lag"] == 2


def test_sidecar_registers_at_the_tail(spark, tmp_path):
    side = vectors.Sidecar(spark, str(tmp_path / "s"))
    art = lambda name, at: spark.createDataFrame([("s", name, 1, None, "text", 3, "d", None, at, None)], vectors.ARTIFACT)
    vec = lambda name, source, at, dims=2: spark.createDataFrame([("s", name, 1, source, None, dims, "dot", [1.0, 2.0], None, at, None)], vectors.VECTOR)
    side.register_artifacts(art("doc", 1), 1)
    side.register_vectors(vec("v", "doc", 2), 2)
    refused = [(side.register_artifacts, art("doc", 3), 3, "DuplicateId"), (side.register_artifacts, art("new", 2), 2, "AnchorUsed"), (side.register_vectors, vec("w", "doc", 3), 4, "NotAtTail"),
               (side.register_vectors, vec("w", "nowhere", 3), 3, "ArtifactOrder"), (side.register_vectors, vec("w", None, 3, 5), 3, "Dimensions")]
    for register, rows, tail, code in refused:
        with pytest.raises(EngineError) as e:
            register(rows, tail)
        assert e.value.code == "RegistrationRefused" and code in str(e.value)
    assert side.artifacts.count() == side.vectors.count() == 1
    found = vectors.search(side.vectors, side.artifacts, [1.0, 1.0], sidecar="s", metric="dot").first()
    assert found["vector_id"] == "v" and found["uri"] is None and found["score"] == 3.0  # an artifact without uri is there


def test_federated_report_merges_cuts(spark):
    text = "schema v1 {{\nattr task.{0}: ScalarLww<String>\n}}\npredicates {{\ntask_{0}(Entity, String)\nout(Entity, String)\n}}\nrules {{\nout(t, v) <- task_{0}(t, v)\n}}\nquery {{\ngoal out(t, v)\n}}\n"
    f = Federation(spark, {"a": journal(spark, [datom(1, 1, "String", "ready", "Assert", 1)]), "b": journal(spark, [datom(1, 1, "String", "me", "Assert", 3)])})
    doc = "schema v1 {\n}\npredicates {\nready(Entity, String)\nowner(Entity, String)\nact(Entity, String)\n}\nrules {\nact(t, w) <- ready(t, s), owner(t, w)\n}\nquery {\ngoal act(t, w)\n}\nexplain why {\ntuple act(entity(1), \"me\")\n}\n"
    found = f.explained(doc, [Import(Cut("a"), text.format("status"), "ready"), Import(Cut("b"), text.format("owner"), "owner")])
    assert found["summaries"]["why"]["tuples"] == 1 and [c["partition"] for c in found["summaries"]["why"]["cuts"]] == ["a", "b"] and found["primary"].count() == 1


def test_shared_folder_is_needed_on_a_cluster(spark):
    from strataline import storage

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(EngineError) as e:
        storage.shared_dir(Session)
    assert e.value.code == "SharedFolder"


def test_namespaces_are_apart(spark, tmp_path):
    from strataline.session import Engine

    spaces = js.Namespaces(spark, str(tmp_path))
    a, b = spaces.journal("a", schema()), spaces.journal("b", schema())
    rows = datoms(spark, [datom(1, 1, "String", "x", "Assert", 1)])
    a.append(rows)
    assert b.cut()["entry_count"] == 0 and spaces.journal("a").scan().count() == 1
    b.append(rows)
    text = "schema v1 {\nattr task.status: ScalarLww<String>\n}\npredicates {\ntask_status(Entity, String)\n}\nrules {\n}\nquery {\ngoal task_status(t, s)\n}\n"
    assert a.cut() == b.cut() and Engine(spark, a).run(text).identity != Engine(spark, b).run(text).identity
    for name in ("", "../a", "A", "x" * 64):
        with pytest.raises(EngineError):
            spaces.journal(name)


def test_journals_are_not_broadcast(spark, tmp_path):
    """Spark estimates tables by their files, so rows of journals that look small would go through the driver."""
    book = Journal(spark, str(tmp_path / "j"), schema())
    book.append(datoms(spark, [datom(1, 3, "String", "a", "InsertAfter", 1), datom(1, 1, "String", "x", "Assert", 2, parents=[1])]))
    rows = book.scan()
    plans = [js.append_errors(rows, rows, schema()), js.dependency_errors(rows, schema()), book._reachable(rows, rows), js.prefix_divergence(rows, rows)]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Broadcast" not in text
    assert js.dependency_errors(rows, schema()).isEmpty() and js.prefix_divergence(rows, rows).isEmpty()
    assert {r["code"] for r in plans[0].collect()} == {"DuplicateElement"} and plans[2].count() == 1
