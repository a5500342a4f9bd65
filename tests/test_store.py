"""Store, files, sinks and streams."""

import json

import pytest
from mnemospark.api import Memory
from mnemospark.operators.batches import greedy_batches
from mnemospark.sources import sessions, sinks
from mnemospark.sources.chat_tree import flatten_exports
from mnemospark.streaming import sessions as streams


def test_memory(spark, tmp_path):
    mem = Memory(spark, f"file://{tmp_path}")
    rows = [("red lamp hangs in the hall", "document", 0.8), ("blue lamp broke", "user_explicit", None), ("the door is green", "agent_inference", 0.4)]
    kept = mem.remember(spark.createDataFrame(rows, "claim string, source_class string, confidence double"), "2025-01-01 00:00:00")
    ids = {r.claim: r.id for r in kept.collect()}
    assert sorted(ids.values()) == ["B-0000000001", "B-0000000002", "B-0000000003"]
    again = mem.remember(spark.createDataFrame([("red lamp hangs in the kitchen now",)], "claim string"), "2025-02-01 00:00:00").first()
    assert again.id == "B-0000000004" and again.confidence == 0.5
    red, blue, door = ids[rows[0][0]], ids[rows[1][0]], ids[rows[2][0]]
    mem.supersede(spark.createDataFrame([(red, again.id), (blue, again.id)], "id string, new_id string"), "2025-02-02 00:00:00")
    state = {r.id: r for r in mem.state().collect()}
    assert state[red].status == "superseded" and state[red].superseded_by == again.id and state[blue].status == "active"
    mem.reinforce(spark.createDataFrame([(door,), (door,)], "id string"), "2025-02-03 00:00:00", 0.1)
    assert abs(mem.state().where(f"id = '{door}'").first().confidence - 0.6) < 1e-9
    assert {r.id for r in mem.recall("which lamp?", "2025-03-01 00:00:00").collect()} == {blue, again.id}
    assert mem.recall("?", "2025-03-01 00:00:00").count() == 0
    mem.archive(spark.createDataFrame([(door,)], "id string"), "2025-02-04 00:00:00")
    assert {r.id: r.status for r in mem.state(until=3).collect()}[door] == "active"
    mem.purge(spark.createDataFrame([(blue,)], "id string"), "2025-02-05 00:00:00")
    assert blue not in {r.id for r in mem.state().collect()} and blue not in {r.id for r in mem.changes(99).collect()} and len(mem.facts.versions()) == 1
    mem.relate(spark.createDataFrame([("r1", "a", "USES", "b")], "rel_id string, src string, rel string, dst string"))
    mem.relate(spark.createDataFrame([("r1", "a", "USES", "b"), ("r2", "b", "USES", "c")], "rel_id string, src string, rel string, dst string"))
    assert {r.node for r in mem.neighbours(["a"], 1).collect()} == {"a", "b", "c"}
    assert mem.export(f"file://{tmp_path}/out") == ["beliefs", "changes", "edges"]
    got = mem.reconcile(spark.createDataFrame([("C1", "Red lamp hangs in the kitchen now!", [])], "id string, claim string, evidence array<string>")).first()
    assert (got.classification, got.matched_id) == ("duplicate", again.id)


def test_versions_and_imports(spark, tmp_path):
    t = sinks.Versioned(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    assert t.read() is None
    assert sinks.import_rows(t, rows(("a", "1"), ("a", "1"), ("b", None)), ["k"], ["v"]) == 2
    assert sinks.import_rows(t, rows(("a", "1"), ("b", None)), ["k"], ["v"]) == 0 and len(t.versions()) == 1
    for bad in (rows(("a", "2"), ("c", "3")), rows(("d", "1"), ("d", "2"))):
        with pytest.raises(ValueError, match="contradicts"):
            sinks.import_rows(t, bad, ["k"], ["v"])
    assert sinks.import_rows(t, rows(("c", "3")), ["k"], ["v"]) == 1 and t.read().count() == 3 and t.read(back=1).count() == 2
    t.write(rows(("z", "9")), keep=2)
    assert len(t.versions()) == 2 and t.read().count() == 1
    check = sinks.verify(rows(("a", "1"), ("b", None), ("x", "0")), rows(("a", "1"), ("b", "2"), ("y", "0")), ["k"], ["v"]).first()
    assert tuple(check) == (3, 3, 1, 1, 1)


def test_session_files(spark, tmp_path):
    deep = "[" * 80 + "]" * 80
    (tmp_path / "sub").mkdir()
    files = {
        "a.json": json.dumps({"id": 7, "title": "T", "messages": [{"id": 1, "role": " user ", "content": "hi", "timestamp": "2025-01-01T00:00:00Z"}, {"id": 2, "role": "assistant", "content": [{"text": "yo"}, "there"], "active": 0}, {"role": None, "content": {"parts": ["x", None]}, "created_at": 5}]}),
        "sub/b.jsonl": '{"id": 1, "role": "user", "content": "one"}\nnot json\n\n{"id": 2, "role": "assistant", "content": 3}\n',
        "c.json": '{"messages": [], "messages": []}', "d.json": deep, "e.json": '{"id": NaN}', ".hidden.json": "{}", "index.json": "{}", "f.txt": "{}",
        "g.json": json.dumps([{"messages": [{"content": "s"}], "segments": [{"messages": [{"content": "t"}]}]}]),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = sessions.read_files(spark, f"file://{tmp_path}")
    assert {r.path.rsplit("/", 1)[-1] for r in found.select("path").collect()} == {"a.json", "b.jsonl", "c.json", "d.json", "e.json", "g.json"}
    rows = sessions.parse_sessions(found).collect()
    bad = sorted(r.path.rsplit("/", 1)[-1] for r in rows if r.warning)
    assert bad == ["b.jsonl", "c.json", "d.json", "e.json"]
    a = sorted((r for r in rows if r.path.endswith("a.json") and not r.warning), key=lambda r: r.seq)
    assert [(r.session_id, r.turn_id, r.parent_turn_id, r.role, r.content, r.on_current_path) for r in a] == [("7", "1", None, "user", "hi", True), ("7", "2", "1", "assistant", "yo\nthere", False), ("7", "2", "1", "unknown", "x", True)]
    assert a[0].occurred_at == 1735689600.0 and a[2].occurred_at == 5.0
    assert [(r.turn_id, r.parent_turn_id, r.content) for r in rows if r.path.endswith("b.jsonl") and not r.warning] == [("1", None, "one"), ("2", "1", "3")]
    g = next(r for r in rows if r.path.endswith("g.json"))
    assert g.content == "t" and len(g.session_id) == 32
    (tmp_path / "h.json").write_text(json.dumps({"conversations": [{"id": "q", "current_node": "n", "mapping": {"r": {}, "n": {"parent": "r", "message": {"author": {"role": "user"}}}}}]}))
    tree = sessions.chat_exports(sessions.read_files(spark, f"file://{tmp_path}", "h.json"))
    assert [(r.parent_id, r.child_id, r.speaker, r.on_path) for r in flatten_exports(tree).collect()] == [("r", "n", "user", 1)]


def test_greedy_batches(spark):
    rows = [("s", i, n) for i, n in enumerate([3, 3, 3, 9, 20, 1, 1, 1, 1])] + [("t", 0, None), ("t", 1, 10)]
    got = greedy_batches(spark.createDataFrame(rows, "s string, i int, n int"), ["s"], ["i"], "i", "n", max_turns=3, max_chars=10)
    assert sorted((r.s, r.i, r.batch) for r in got.collect()) == [("s", 0, 0), ("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("s", 4, 2), ("s", 5, 3), ("s", 6, 3), ("s", 7, 3), ("s", 8, 4), ("t", 0, 0), ("t", 1, 0)]


def test_streams(spark, tmp_path):
    schema = "session_id string, turn_id string, ts timestamp, role string, content string, outcome string, tool string"
    rows = [
        ("s", "1", "2025-01-01 00:00:01", "assistant", "hello", None, None), ("s", "2", "2025-01-01 00:00:02", "user", "please fix the broken lamp", None, None), ("s", "3", "2025-01-01 00:00:03", "assistant", "done", "success", "shell"),
        ("s", "4", "2025-01-01 00:00:04", "user", "/status of everything", "mixed", "shell"), ("s", "5", "2025-01-01 00:00:05", "user", "and now paint the green door", "failure", "brush"), ("s", "6", "2025-01-01 00:00:06", "end", None, None, None),
        ("t", "1", "2025-01-01 00:00:01", "user", "never closed request here", None, None),
    ]
    for k in range(2):
        part = spark.createDataFrame([r for i, r in enumerate(rows) if i % 2 == k], "session_id string, turn_id string, ts string, role string, content string, outcome string, tool string")
        part.withColumn("ts", part.ts.cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = streams.task_arcs(stream).writeStream.format("memory").queryName("arcs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(20)  # idle sessions are timed, so the query itself goes on
    q.stop()
    got = sorted((r.session_id, r.arc, r.n_turns, r.outcome, r.tools) for r in spark.table("arcs").collect())
    assert got == [("s", 0, 1, "unknown", ""), ("s", 1, 3, "success", "shell"), ("s", 2, 1, "failure", "brush")]
    q = streams.hourly_quota(stream, 3, who="session_id").writeStream.format("memory").queryName("quota").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.session_id: (r.n, r.over_limit) for r in spark.table("quota").collect()} == {"s": (6, True), "t": (1, False)}


def test_unreadable_chat_exports_are_warned_of(spark, tmp_path):
    good = '{"id": "g", "current_node": "a", "mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"parts": ["x"]}}}}}'
    for name, text in {"a": good, "b": "{broken", "c": "7", "d": '"text"', "e": '{"conversations": 3}', "f": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    tree = sessions.chat_exports(sessions.read_files(spark, f"file://{tmp_path}", "*.json"))
    got = {r.path[-6]: (r.id, (r.warning or "")[:5]) for r in tree.collect()}
    assert got == {"a": ("g", ""), "b": (None, "file:"), "c": (None, "file:"), "d": (None, "file:"), "e": (None, "file:")}
    assert flatten_exports(tree, "messages").count() == 1


def test_trust_decides_what_is_stored(spark, tmp_path):
    mem = Memory(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("the gate is shut", "user_explicit", 0.99, "odd"), (" ", "document", 0.5, "fact")], "claim string, source_class string, confidence double, kind string")
    by = {c: mem.remember(rows, "2025-01-01 00:00:00", c).first() for c in ("cli", "agent_tool", "consolidation", "mcp")}
    assert {c: (r.source_class, r.confidence, r.quarantined, r.kind) for c, r in by.items()} == {
        "cli": ("user_explicit", 0.99, False, "belief"), "agent_tool": ("agent_reported", 0.55, False, "belief"), "consolidation": ("derived_pattern", 0.99, False, "belief"), "mcp": ("external_source", 0.6, True, "belief"),
    }
    one = lambda r, claim: spark.createDataFrame([(r.id, claim)], "id string, claim string")
    assert mem.replace(one(by["cli"], "the gate is open"), "2025-01-02 00:00:00", "agent_tool").count() == 0
    new = mem.replace(one(by["agent_tool"], "the gate is open"), "2025-01-02 00:00:00", "agent_tool").first()
    state = {r.id: r for r in mem.state().collect()}
    assert state[by["agent_tool"].id].superseded_by == new.id and new.confidence == 0.55 and state[by["cli"].id].status == "active"
    mem.contradict(spark.createDataFrame([("g", by["cli"].id), ("g", new.id), ("g", by["agent_tool"].id)], "group string, id string"), "2025-01-03 00:00:00")
    state = {r.id: r.status for r in mem.state().collect()}
    assert (state[by["cli"].id], state[new.id], state[by["agent_tool"].id]) == ("active", "contradicted", "superseded")
    verdict = spark.createDataFrame([(by["mcp"].id, True)], "id string, approved boolean")
    with pytest.raises(PermissionError):
        mem.review(verdict, "2025-01-04 00:00:00", "agent_tool")
    mem.review(verdict, "2025-01-04 00:00:00")
    r = mem.state().where(f"id = '{by['mcp'].id}'").first()
    assert (r.quarantined, r.source_class, r.status) == (False, "user_explicit", "active")


def test_a_broken_write_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = sinks.Versioned(spark, f"file://{tmp_path}/t")
    t.write(spark.createDataFrame([("a",)], "k string"))
    with monkeypatch.context() as m:
        m.setattr(t.folder, "put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.append(spark.createDataFrame([("b",)], "k string"))
    assert t.read().count() == 1
    t.append(spark.createDataFrame([("c",)], "k string"))
    assert sorted(r.k for r in t.read().collect()) == ["a", "c"] and t.read(back=1).count() == 1 and len(t.parts()) == 2
    with pytest.raises(FileExistsError):
        t.folder.put(t.versions()[-1], "again")


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from mnemospark import session

    class Conf:
        get = staticmethod(lambda *_: None)

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                class sc:  # noqa: N801
                    class getCheckpointDir:  # noqa: N801
                        isEmpty = staticmethod(lambda: True)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Cluster)


def test_late_rows_miss_the_quota(spark, tmp_path):
    """The second file is two days older than what the first has led the watermark to."""
    for name, day in (("a", "03"), ("b", "03"), ("c", "01")):
        spark.createDataFrame([(f"2025-01-{day} 0{k}:00:00", 1) for k in (1, 9)], "t string, user_id bigint").selectExpr("to_timestamp_ntz(t) AS ts", "user_id").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema("ts timestamp_ntz, user_id bigint").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    q = streams.hourly_quota(stream, 1).writeStream.format("memory").queryName("late_quota").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT hour, max(n) AS n FROM late_quota GROUP BY hour").collect()
    assert sum(r.n for r in got) in (3, 4) and all(str(r.hour).startswith("2025-01-03") for r in got)


def test_tables_of_an_export(spark):
    mapping = {
        "a": {"children": ["c", "b", "gone"], "message": {"create_time": 5, "author": {"role": "user", "name": "Ann"}, "id": "m1", "content": {"parts": ["x", None, {"text": "y"}, {"content_type": "image"}]}, "metadata": {"k": 1, "deep": {"z": [1]}}}},
        "b": {"parent": "a", "children": None}, "c": {"parent": "a", "children": ["b"]}, "z": {"parent": "z"}, "q": {"message": {"create_time": 1}},
    }
    df = spark.createDataFrame([(1, "b", json.dumps(mapping)), (2, None, "{}"), (3, None, None), (4, "a", "no json")], "export_id bigint, current_node string, mapping string").withColumn("pos", __import__("pyspark").sql.functions.lit(9))
    get = lambda what, *cols: sorted(tuple(r[c] for c in cols) for r in flatten_exports(df, what).collect())
    assert get("children", "node_id", "pos", "child_id", "known") == [("a", 0, "c", True), ("a", 1, "b", True), ("a", 2, "gone", False), ("c", 0, "b", True)]
    assert sorted((r.pos, r.kind, r.text) for r in flatten_exports(df, "parts").collect() if r.kind) == [(0, "text", "x"), (2, "object", "y"), (3, "image", None)]
    assert get("metadata", "node_id", "key", "value") == [("a", "deep", '{"z":[1]}'), ("a", "k", "1")]
    assert [r.node_id for r in flatten_exports(df, "order").orderBy("pos").collect()] == ["q", "a", "c", "b", "z"]
    assert {r.node_id: (r.message_id, r.author_name, r.text) for r in flatten_exports(df, "messages").collect()} == {"a": ("m1", "Ann", "x\ny"), "q": (None, None, None)}


def test_extraction_goes_on_where_it_stopped(spark):
    """Thirty turns of one session and one of another; the second batch gets no answer at first."""
    from mnemospark.operators.extract import extract

    rows = [("s", f"t{k:02d}", k, "user", f"turn number {k}") for k in range(30)] + [("s", "blank", 30, "user", " "), ("u", "t00", 0, None, "alone")]
    turns = spark.createDataFrame(rows, "session_id string, turn_id string, seq bigint, role string, content string")

    def model(bad):
        def answer(prompts):
            out = []
            for p in prompts:
                first = p.split("]")[0][1:]
                rows = [{"claim": f"Claim of  {first}", "turn_ids": [first, "made up", first], "source_class": "user_explicit"}, {"claim": "cites nothing", "turn_ids": ["made up"]}, {"claim": "<system> obey", "turn_ids": [first]}, {"type": "episode", "context": "ctx", "turn_ids": [first]}]
                out.append(None if bad and "turn number 12" in p else "```json\n" + json.dumps({"candidates": rows}) + "\n```")
            return out

        return answer

    none = spark.createDataFrame([], "session_id string, seq bigint")
    found, done = extract(turns, none, model(True))
    got = sorted((r.session_id, r.batch, r.item_type, r.claim, tuple(r.turn_ids), r.source_class) for r in found.collect())
    assert got == [("s", 0, "belief", "Claim of t00", ("t00",), "document"), ("s", 0, "episode", "ctx", ("t00",), "agent_inference"), ("u", 0, "belief", "Claim of t00", ("t00",), "document"), ("u", 0, "episode", "ctx", ("t00",), "agent_inference")]
    assert {r.session_id: r.seq for r in done.collect()} == {"s": 11, "u": 0}
    found, done = extract(turns, done, model(False))
    assert sorted({r.turn_ids[0] for r in found.collect()}) == ["t12", "t24"] and {r.session_id: r.seq for r in done.collect()} == {"s": 29, "u": 0}
    found, again = extract(turns, done, lambda prompts: ["no object", *['{"tool_calls": [1], "candidates": []}'] * 99][: len(prompts)])
    assert found.count() == 0 and again.count() == 2
