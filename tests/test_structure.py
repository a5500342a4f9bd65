"""Nested exports and turn trees against brute force."""

import json
import random

from mnemospark.operators import forest as trees
from mnemospark.operators.components import components
from mnemospark.operators.forest import forest, tree_paths
from mnemospark.operators.running import running_total
from mnemospark.session import Scratch
from mnemospark.sources.chat_tree import flatten_exports
from pyspark.sql import functions as F


def brute_links(rows):
    out = []
    for export_id, current, mapping in rows:
        try:
            nodes = json.loads(mapping)
        except (TypeError, ValueError):
            continue
        up = {}
        for k, n in nodes.items():
            p = n.get("parent")
            if p in nodes:
                up[k] = p
            else:
                claims = [q for q, x in nodes.items() if q != k and k in (x.get("children") or [])]
                up[k] = claims[0] if claims else None
        seen, c = set(), current
        while c in nodes and c not in seen:
            seen.add(c)
            c = up[c]
        for k, p in up.items():
            if p is not None:
                role = ((nodes[k].get("message") or {}).get("author") or {}).get("role") or ""
                out.append((export_id, p, k, role, int(k in seen)))
    return sorted(out)


def test_links_of_odd_exports(spark):
    m = lambda role: {"author": {"role": role}}
    rows = [
        (1, "c", json.dumps({"a": {"children": ["b", "b", "zz"]}, "b": {"parent": "a", "message": m("user")}, "c": {"parent": "gone", "message": m("assistant")}, "d": {"children": ["c"], "parent": "b"}})),
        (2, None, json.dumps({"a": {"parent": "b"}, "b": {"parent": "a", "children": None}})),
        (3, "b", json.dumps({"a": {"parent": "b"}, "b": {"parent": "a"}, "s": {"parent": "s"}})),
        (4, "x", "{}"), (5, "x", None), (6, "x", "not json"), (7, "n", json.dumps({"n": {}})),
        (8, "k", json.dumps({"x": {"children": ["k"]}, "y": {"children": ["k"]}, "k": {"message": None}})),
    ]
    df = spark.createDataFrame(rows, "export_id bigint, current_node string, mapping string").withColumn("entries", F.lit(1)).repartition(3)
    assert sorted(map(tuple, flatten_exports(df).collect())) == brute_links(rows)
    assert flatten_exports(df.where("false")).count() == 0
    assert {r.node_id for r in flatten_exports(df, "nodes").collect()} == {"a", "b", "c", "d", "s", "n", "x", "y", "k"}
    assert [(r.export_id, r.node_id, r.role) for r in flatten_exports(df, "messages").orderBy("node_id").collect()] == [(1, "b", "user"), (1, "c", "assistant")]


def test_message_texts_keep_all_parts(spark):
    contents = {
        "a": {"parts": [None, "", "Was the broom in?"]}, "b": {"parts": ["x", None, "y"]}, "c": {"parts": [None], "text": "t"},
        "d": {"parts": []}, "e": {"text": "u"}, "f": {"content_type": "code"}, "g": {"parts": ["one", "two"], "text": "v"},
    }
    mapping = json.dumps({k: {"message": {"author": {"role": "user"}, "content": v}} for k, v in contents.items()} | {"h": {"message": None}})
    df = spark.createDataFrame([(1, "a", mapping), (2, None, "{}"), (3, None, mapping)], "export_id bigint, current_node string, mapping string").coalesce(1)
    got = {(r.export_id, r.node_id): r.text for r in flatten_exports(df, "messages").collect()}
    want = {"a": "\nWas the broom in?", "b": "x\ny", "c": "t", "d": "", "e": "u", "f": None, "g": "one\ntwo"}
    assert got == {(i, k): v for i in (1, 3) for k, v in want.items()}


def test_hidden_content_has_no_text(spark):
    types = {"a": "thoughts", "b": " tether_quote ", "c": "text", "d": None}
    mapping = json.dumps({k: {"message": {"content": {"content_type": t, "parts": ["x"]}}} for k, t in types.items()})
    df = spark.createDataFrame([(1, "a", mapping)], "export_id bigint, current_node string, mapping string")
    assert {r.node_id: r.text for r in flatten_exports(df, "messages").collect()} == {"a": "", "b": "", "c": "x", "d": "x"}


def brute_forest(rows):
    up = {}
    for g, i, p, _ in rows:
        if g is not None and i is not None:
            p = p if p and p.strip() else None
            up[g, i] = max(filter(None, (up.get((g, i)), p)), default=None)
    out, below = {}, dict.fromkeys(up, 0)
    for k in up:
        chain, c = [], k
        while c in up and c not in chain:
            chain.append(c)
            c = (c[0], up[c])
        if c in chain:
            out[k] = ("", -1)
        else:
            out[k] = (chain[-1][1], len(chain) - 1)
            for a in chain[1:]:
                below[a] += 1
    return {k: (*v, below[k] if v[0] else -1) for k, v in out.items()}


def check_forest(spark, rows, per_task):
    df = spark.createDataFrame(rows, "s string, t string, p string, h double").withColumn("root", F.lit("clash")).withColumn("g", F.lit(0))
    got = {(r.s, r.t): (r.root, r.depth, r.n_below) for r in forest(df, "s", "t", "p", hint="h", rows_per_task=per_task).collect()}
    assert got == brute_forest(rows)


def test_forest_shapes(spark):
    pick = random.Random(5)
    rows = [("chain", f"c{i}", f"c{i - 1}" if i else None, float(i)) for i in range(150)]
    rows += [("hub", f"h{i}", "h0" if i else "", None) for i in range(150)]
    rows += [("loop", "a", "b", 1.0), ("loop", "b", "c", 2.0), ("loop", "c", "a", 3.0), ("loop", "d", "c", 4.0), ("loop", "e", "d", 99.0), ("loop", "self", "self", 0.0)]
    rows += [("mixed", f"m{i}", f"m{pick.randrange(60)}" if pick.random() < 0.9 else "gone", pick.random()) for i in range(60)]
    rows += [("mixed", "m3", None, 0.1), (None, "x", None, 0.0), ("n", None, "x", 0.0), ("n", "1", " ", float("nan"))]
    for per_task in (10_000, 40):
        check_forest(spark, rows, per_task)


def test_forest_of_scattered_chain(spark):
    """The hint says nothing about the chain, so fragments hardly contract at first."""
    pick = random.Random(6)
    rows = [("g", f"n{i:03d}", f"n{i - 1:03d}" if i else None, pick.random()) for i in range(240)]
    check_forest(spark, rows, 30)


def test_forest_of_more_trees_than_a_task_holds(spark, monkeypatch):
    rows = [("many", f"r{i}", None, float(i)) for i in range(120)] + [("many", f"k{i}", f"r{i}", 200.0 - i) for i in range(30)] + [("many", f"x{i}", f"k{i % 30}", 300.0 + i) for i in range(40)]
    for name, run in (("_solve", lambda: check_forest(spark, rows, 40)), ("_solve_paths", lambda: check_paths(spark, rows, 40))):
        solve, calls = getattr(trees, name), []

        def counted(*a, solve=solve, calls=calls):
            calls.append(a[1])
            assert len(calls) <= 8, calls
            return solve(*a)

        monkeypatch.setattr(trees, name, counted)
        run()


def check_paths(spark, rows, per_task):
    up = {(g, i): p for g, i, p, _ in rows}

    def path(k):
        return [*(path((k[0], up[k])) if up[k] else []), k[1]]

    df = spark.createDataFrame(rows, "s string, t string, p string, h double")
    assert {(r.s, r.t): r.path for r in tree_paths(df, "s", "t", "p", hint="h", rows_per_task=per_task).collect()} == {k: path(k) for k in up}


def test_forest_empty_and_inherited(spark):
    df = spark.createDataFrame([("s", "a", None, 5.0), ("s", "b", "a", None), ("s", "c", "b", None), ("s", "r", None, None)], "s string, t string, p string, h double")
    assert forest(df.where("false"), "s", "t", "p").count() == 0
    for per_task in (100, 1):
        got = {r.t: r.fill for r in forest(df, "s", "t", "p", hint="h", inherit="h", rows_per_task=per_task).collect()}
        assert got == {"a": 5.0, "b": 5.0, "c": 5.0, "r": None}


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q"), ("y", "w"), ("x", "y")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark)).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(71)} | {"x": "w", "y": "w", "w": "w"}
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark)).count() == 0


def test_running_total_over_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i, i % 7 if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows + [(None, 1, 4), (None, 2, 5)], "g string, o int, v int")
    got = {(r.g, r.o): r.t for r in running_total(df, ["g"], ["o"], {"t": F.col("v").cast("long")}, rows_per_task=60).collect()}
    want, sums = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]) + [(None, 1, 4), (None, 2, 5)]:
        sums[g] = sums.get(g, 0) + (v or 0)
        want[g, o] = sums[g]
    assert got == want
    assert running_total(df.where("false"), ["g"], ["o"], {"t": F.col("v")}).count() == 0


def test_tree_paths(spark):
    pick = random.Random(9)
    rows = [("chain", f"c{i}", f"c{i - 1}" if i else None, float(i)) for i in range(60)]
    rows += [("mixed", f"m{i}", f"m{pick.randrange(50)}" if pick.random() < 0.9 else "gone", pick.random()) for i in range(50)]
    rows += [("one", "a", None, 0.0), ("loop", "a", "b", 1.0), ("loop", "b", "a", 2.0), ("loop", "c", "b", 3.0)]
    up = {(g, i): p for g, i, p, _ in rows}

    def brute(k):
        out = []
        while k in up:
            if k in out:
                return None
            out.append(k)
            k = (k[0], up[k])
        return [i for _, i in out[::-1]]

    df = spark.createDataFrame(rows, "s string, t string, p string, h double")
    for per_task in (10_000, 25):
        assert {(r.s, r.t): r.path for r in tree_paths(df, "s", "t", "p", hint="h", rows_per_task=per_task).collect()} == {k: brute(k) for k in up}
    assert tree_paths(df.where("false"), "s", "t", "p").count() == 0
