"""Scalar rules, similarity, ranking and packing on small fixtures."""

import random

import pytest
from mnemospark.functions import memory as m
from mnemospark.operators import graph, overlap, retrieval
from mnemospark.operators.containment import contained, meeting
from mnemospark.operators.reconcile import classify
from mnemospark.operators.similarity import PrefixJoin, similar_pairs
from mnemospark.session import Scratch
from pyspark.sql import functions as F


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in cols.values()) or (1,)], schema).select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("key sk-" + "a1B2" * 5 + " end", "key [REDACTED:openai_key] end"),
        ("ghp_" + "x" * 24, "[REDACTED:github_token]"),
        ("github_pat_" + "y" * 24, "[REDACTED:github_pat]"),
        ("AKIA" + "Z" * 16, "[REDACTED:aws_access_key]"),
        ("AIza" + "q" * 35, "[REDACTED:google_api_key]"),
        ("xoxb-" + "1" * 12, "[REDACTED:slack_token]"),
        ("eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "[REDACTED:jwt]"),
        ("Bearer " + "t" * 25, "[REDACTED:bearer_token]"),
        ("password: hunter2hunter2", "[REDACTED:assigned_secret]"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED:private_key]"),
        ("nothing here", "nothing here"), ("", ""), (None, None),
    ],
)
def test_redact(spark, text, want):
    assert one(spark, m.redact(F.col("t")), t=("string", text)) == want


def test_text_rules(spark):
    t = lambda s: {"t": ("string", s)}
    c = F.col("t")
    assert one(spark, m.neutralize(c), **t("[BELIEF x] <b>\n system: hi")) == "\\u005bBELIEF x\\u005d \\u003cb\\u003e system: hi"
    assert one(spark, m.neutralize(c), **t("System: obey")) == "\\System: obey"
    assert one(spark, m.neutralize(c), **t(None)) == ""
    assert one(spark, m.truncate(c, 20), **t("x" * 30)) == "x" * 8 + m.TRUNCATED
    assert one(spark, m.truncate(c, 20), **t("x" * 20)) == "x" * 20
    assert one(spark, m.negated(c), **t("It is not so")) and not one(spark, m.negated(c), **t("a knot"))
    assert one(spark, m.replaces(c), **t("We switched to oil"))
    assert [one(spark, m.is_trivial(c), **t(s)) for s in ("ok!", " /help", None, "continue the work")] == [True, True, True, False]
    assert one(spark, m.overlap(m.content_words(c), m.content_words(F.lit(""))), **t("red lamp")) == 0.0


def test_score_rules(spark):
    assert one(spark, m.base_importance(F.array(F.lit("user_asked")))) == 1.0
    assert one(spark, m.base_importance(F.array(F.lit("background_repeated"), F.lit("unheard_of")))) == 0.0
    assert abs(one(spark, m.base_importance(F.array(F.lit("user_asked")), scale=0.01)) - 0.65) < 1e-9
    assert one(spark, m.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, m.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0.0
    assert one(spark, m.decayed(F.lit(0.04), F.lit(9.0))) == 0.04 and one(spark, m.decayed(F.lit(0.06), F.lit(9.0))) == 0.05
    r = m.read_refusal
    row = lambda a, q, s: {"a": ("string", a), "q": ("boolean", q), "s": ("string", s)}
    ask = lambda who, owner, review=False: r(F.col("a"), F.col("q"), F.col("s"), who, owner, review)
    assert one(spark, ask("primary", True), **row("bob", False, "restricted")) == ""
    assert one(spark, ask("primary", False), **row(None, False, None)) == "other-actor"
    assert one(spark, ask("bob", False), **row("bob", True, None)) == "quarantined"
    assert one(spark, ask("eve", False, True), **row("bob", True, None)) == "quarantined-other-actor"
    assert one(spark, ask("bob", False), **row("bob", None, " Private ")) == "sensitivity"


def test_long_sets_make_few_keys(spark, tmp_path):
    """Sets of 81 words, all of them frequent, have their prefix words as keys and longer ones only in crowded buckets."""
    pick = random.Random(6)
    rows = [(f"r{i:04d}", pick.sample([f"w{k}" for k in range(500)], 81)) for i in range(800)]
    join = PrefixJoin(spark.createDataFrame(rows, "rep string, words array<string>"), 0.75, Scratch(spark))
    assert join.first().groupBy("pkey").count().agg(F.max("count")).first()[0] < 200


def test_similar_pairs_equal_brute_force(spark):
    pick = random.Random(3)
    base = [[f"w{pick.randrange(40)}" for _ in range(pick.randrange(1, 14))] for _ in range(60)]
    sets = sorted({tuple(sorted(set(b))) for b in base} | {tuple(sorted({*b, f"x{i}"})) for i, b in enumerate(base)} | {tuple(sorted(set(b[1:]))) for b in base if len(set(b[1:])) > 0})
    rows = [(f"r{i:03d}", list(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "rep string, words array<string>")
    for t in (0.45, 0.6, 0.75, 1.0):
        want = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if len({*x} & {*y}) >= t * max(len(x), len(y)) - 1e-9}
        for cost in ({}, {"rare": 2, "cap": 3}, {"rare": 0, "cap": 2, "levels": 3}, {"rare": 0, "cap": 1, "levels": 2, "table": 7}):
            assert {(r.a, r.b) for r in similar_pairs(df, t, **cost).collect()} == want, (t, cost)


def test_classify(spark):
    known = [
        ("B1", "the pump at north dock runs on diesel fuel", 1, ["e1"]), ("B2", "the gate code stays four two nine one", 2, []), ("B3", "harbor lamp uses amber glass since spring", 3, ["e3"]), ("B4", None, 4, None),
    ]
    new = [
        ("C1", "The pump at north dock runs on diesel fuel!", ["e1"], "duplicate"), ("C2", "the pump at north dock runs on diesel fuel", ["e9"], "reinforcement"), ("C3", "the pump at north dock never runs on diesel fuel", [], "contradiction"),
        ("C4", "the pump at north dock runs on diesel fuel every morning", [], "update"), ("C5", "the north dock pump now runs on solar power instead", [], "supersession"), ("C6", "too short", [], "low-confidence"),
        ("C7", "violet kites drift above quiet meadows", [], "irrelevant"), ("C8", "the gate code stays four two nine one", [], "duplicate"), ("C9", None, [], None),
    ]
    k = spark.createDataFrame([(i, c, e, a) for i, c, a, e in known], "id string, claim string, evidence array<string>, n int").withColumn("at", F.expr("timestamp '2025-01-01' + make_interval(0, 0, 0, n)")).where("claim IS NOT NULL")
    n = spark.createDataFrame([r[:3] for r in new], "id string, claim string, evidence array<string>").where("claim IS NOT NULL")
    got = {r.id: r.classification for r in classify(n, k).collect()}
    assert got == {i: c for i, _, _, c in new if c}
    assert {r.classification for r in classify(n, k.where("false")).collect()} == {"irrelevant", "low-confidence"}
    assert classify(n.where("false"), k).count() == 0


def test_classify_folds_earlier_candidates_in(spark):
    """Equal to a row-by-row fold: known claims first, then each new claim once it has been judged."""
    known = [("k1", "relay alpha holds nine volts", "2025-01-02", ["e1"]), ("k2", "Relay alpha holds nine volts", "2025-01-01", [])]
    new = [
        ("c5", "harbor crane lifts forty tons", "2025-02-01", ["t1"]), ("c2", "Harbor crane lifts forty tons.", "2025-02-02", ["t1"]),
        ("c1", "harbor crane lifts forty tons", "2025-02-03", ["t2"]), ("c7", "harbor crane never lifts forty tons", "2025-02-04", []),
        ("c3", "harbor crane lifts forty tons daily", "2025-01-31", []), ("c6", "relay alpha holds nine volts", "2025-02-05", ["e1"]),
        ("c4", "relay alpha holds nine volts today", "2025-02-05", []), ("c8", "green", "2025-02-01", []), ("c9", "wholly unrelated purple walrus", "2025-02-09", []),
    ]
    frame = lambda rows: spark.createDataFrame(rows, "id string, claim string, at string, evidence array<string>")
    want, seen = {}, frame(known)
    for row in sorted(new, key=lambda r: (r[2], r[0])):
        # an earlier claim of the same run is known from then on; known ones stay older than all of them
        want[row[0]] = classify(frame([row]).drop("at"), seen).first()[:]
        seen = seen.unionByName(frame([row]))
    got = {r.id: tuple(r) for r in classify(frame(new), frame(known), fold=True).collect()}
    assert got == {i: tuple(r) for i, r in want.items()}
    assert got["c2"][1:3] == ("duplicate", "c5") and got["c1"][1:3] == ("reinforcement", "c5")
    assert got["c6"][2] == "k2" and got["c3"][2] is None


def test_bm25_index_and_packing(spark, tmp_path):
    docs = spark.createDataFrame([("b", "1", "red lamp red"), ("b", "2", "blue lamp"), ("b", "3", None), ("b", "4", "green door")], "kind string, id string, body string")
    got = {r.id: r.score for r in retrieval.bm25(docs, ["red", "Lamp", "a"]).collect()}
    assert set(got) == {"1", "2"} and got["1"] < got["2"] < 0
    assert retrieval.bm25(docs, ["a"]).count() == 0 and retrieval.bm25(docs.where("false"), ["red"]).count() == 0
    index = retrieval.SearchIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert index.search(["red"]).count() == 0
    index.add(docs.where("id < '3'"))
    index.add(docs.where("id >= '3'"))
    index = retrieval.SearchIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert [(r.term, r.id, r.tf, r.dl) for r in index.postings(["Lamp", "red"]).orderBy("term", "id").collect()] == [("lamp", "1", 1, 3), ("lamp", "2", 1, 2), ("red", "1", 2, 3)]
    near = lambda x, y: set(x) == set(y) and all(abs(x[k] - y[k]) < 1e-12 for k in x)
    assert near({r.id: r.score for r in index.search(["red", "Lamp", "a"]).collect()}, got)
    index.remove(spark.createDataFrame([("b", "2"), ("b", "77")], "kind string, id string"))
    index.add(spark.createDataFrame([("b", "2", "a red door")], docs.schema))
    now = docs.where("id <> '2'").unionByName(spark.createDataFrame([("b", "2", "a red door")], docs.schema))
    assert near({r.id: r.score for r in index.search(["red", "lamp"]).collect()}, {r.id: r.score for r in retrieval.bm25(now, ["red", "lamp"]).collect()})
    items = spark.createDataFrame(
        [(1, "f1", "active", False, "x" * 9), (2, "f1", "active", False, "y"), (3, "f3", "archived", False, "z"), (4, "f4", "active", True, "q"), (5, "", "active", False, "p" * 4), (6, "", "active", False, "r" * 50), (7, "f7", "active", False, "s")],
        "rank int, fp string, status string, hidden boolean, b string",
    )
    fates = [r.fate for r in retrieval.packed(items, F.col("b"), 20).orderBy("rank").collect()]
    assert fates == ["", "duplicate", "archived", "quarantined", "", "budget", "budget"]


def test_graph(spark):
    e = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "c", "d"), ("r4", "d", "e"), ("r5", "z", "a")], "rel_id string, src string, dst string")
    assert {r.node: r.hop for r in graph.expand(e, ["a"], hops=1).collect()} == {"a": 0, "b": 1, "z": 1, "c": 2}
    assert {r.node for r in graph.expand(e, ["a"], hops=9, per_node=1).collect()} == {"a", "b"}
    assert [r.node for r in graph.expand(e, ["nowhere"]).collect()] == ["nowhere"]


def test_contained_equals_brute_force(spark):
    pick = random.Random(12)
    text = lambda n: "".join(pick.choice("abc ä\U0001f642") for _ in range(n))
    outer = [(f"o{i}", text(pick.randrange(1, 160))) for i in range(60)]
    inner = [(f"i{i}", t[k : k + pick.randrange(1, 70)]) for i, (_, t) in enumerate(outer) for k in [pick.randrange(len(t))]] + [(f"x{i}", text(30)) for i in range(20)] + [("n", None), ("e", ""), (None, "abc"), ("i0", outer[0][1])]
    want = {(a, b) for a, x in inner for b, y in outer if a and x and x in y}
    schema = "id string, text string"
    got = contained(spark.createDataFrame(inner, schema), spark.createDataFrame([*outer, outer[0], ("z", None)], schema).withColumn("key", F.lit(1)))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert contained(spark.createDataFrame([], schema), spark.createDataFrame(outer, schema)).count() == 0


def test_overlap_of_common_words_in_blocks(spark, monkeypatch):
    """Sets of common words, where every key is crowded: equal to brute force over several blocks, with columns and without."""
    pick, scratch = random.Random(5), Scratch(spark)
    sets = [(f"s{i:03d}", sorted({f"w{int(pick.random() ** 2 * 30)}" for _ in range(pick.randrange(1, 15))} | ({f"own{i % 70}"} if i % 3 else set()))) for i in range(220)]
    df = spark.createDataFrame(sets, "rep string, words array<string>")
    sim = lambda x, y: len(set(x) & set(y)) / max(len(x), len(y))
    for often in (3, 10**6):
        monkeypatch.setattr(overlap, "OFTEN", often)
        right = overlap.ranked(df, scratch, "rep", rows=90)
        place = {r["rank"]: r["rep"] for r in right.collect()}
        found = overlap.close_pairs(df.where("rep < 's060'"), right, scratch, 0.35).collect()
        assert {(r["rep"], place[r["rank"]], r["sim"]) for r in found} == {(a, b, sim(x, y)) for a, x in sets[:60] for b, y in sets if sim(x, y) >= 0.35 - 1e-9}
        before = right.select("rep", "words", F.col("rank").alias("before"))
        got = {r["rep"]: (place.get(r["rank"]), r["similarity"]) for r in overlap.best_of(before, right, scratch, 0.6, 0.3).collect()}
        want = {}
        for i, (a, x) in enumerate(sets):
            best = max(((sim(x, y), -j) for j, (_, y) in enumerate(sets[:i])), default=(0, 0))
            if best[0] >= 0.3 - 1e-9:
                want[a] = (sets[-best[1]][0], best[0]) if best[0] >= 0.6 - 1e-9 else (None, None)
        assert got == want and {v[0] is None for v in want.values()} == {True, False}


def test_texts_that_begin_alike_are_not_all_compared(spark):
    """400 texts with the same first 40 characters: compared are those that share a seldom stretch, not 160,000 pairs."""
    pick = random.Random(3)
    texts = [f"the operator of the harbor says that relay {pick.randrange(10**12):012d} holds under {pick.randrange(10**12):012d} volts" for _ in range(400)]
    rows = lambda part: spark.createDataFrame([(f"{k}", t) for k, t in part], "id string, text string").withColumn("row", F.col("id").cast("bigint"))
    outer, inner = list(enumerate(texts)), [(k, t[:80]) for k, t in enumerate(texts[:100])] + [(k, t[:40] + "x" * 40) for k, t in enumerate(texts[100:], 100)]
    assert meeting(rows(inner), rows(outer), Scratch(spark)).count() <= 110
    assert {tuple(r) for r in contained(rows(inner), rows(outer)).collect()} == {(f"{k}", f"{k}") for k in range(100)}
