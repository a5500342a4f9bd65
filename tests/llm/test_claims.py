"""Copies, near duplicates, history and survivors against brute force."""

import random
import re

import numpy as np
import pytest
from mnemospark.llm import canonical, history, near, queries, survivor
from mnemospark.session import Scratch, table
from pyspark.sql import functions as F

COPIES = [
    ("Pump A1 holds 2.50 litres.", "t pump a1 holds 2.5 litres"),
    ("pump a1​ HOLDS\n2.5 (litres)", "t pump a1 holds 2.5 litres"),
    ("ｐump a1 holds 2.5 litres", "t pump a1 holds 2.5 litres"),
    ("pump a1 holds 25 litres", "t pump a1 holds 25 litres"),
    ("holds pump a1 2.5 litres", "t holds pump a1 2.5 litres"),
    ("owner=red pump; limit=7 bar", "f limit=7 bar\u001fowner=red pump"),
    ('{"Limit":"7 BAR", "owner": "Red  pump"}', "f limit=7 bar\u001fowner=red pump"),
    ("limit: 7 bar | owner: red pump", "f limit=7 bar\u001fowner=red pump"),
    ("Owner = Red pump\nLimit = 7 bar", "f limit=7 bar\u001fowner=red pump"),
    ("limit: 7 bar, owner: red pump.", "f limit=7 bar\u001fowner=red pump"),
    ("owner=pump red; limit=7 bar", "f limit=7 bar\u001fowner=pump red"),
    ("{broken: json", "t broken json"), ("note: one thing", "t note one thing"),
    (None, None), ("", None), (" ​\t", None), ("?!", None),
]


@pytest.mark.parametrize(("text", "want"), COPIES)
def test_canonical(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(canonical.canonical(F.col("c")).alias("r")).first().r == want


def test_count_copies(spark):
    rows = [(f"r{i:02d}", t) for i, (t, _) in enumerate(COPIES)] + [("r00", COPIES[0][0]), (None, "pump a1 holds 2.5 litres"), ("r99", "x " * 50_000), ("r98", "X\n" * 50_000)]
    df = spark.createDataFrame(rows, "id string, claim string").withColumn("key", F.lit(1)).withColumn("canon", F.lit("clash"))
    got = {r.first_id: r.copies for r in canonical.count_copies(df).collect()}
    assert got == {"r00": 3, "r03": 1, "r04": 1, "r05": 5, "r10": 1, "r11": 1, "r12": 1, "r98": 2}
    assert canonical.count_copies(df.where("false")).count() == 0 and canonical.collisions(df).count() == 0


def words(t):
    return set(re.findall(r"[^\W_]+", t.lower()))


def brute_groups(rows, threshold=0.75):
    texts = {i: t for i, t in rows if i is not None and t is not None and words(t)}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            x, y = words(texts[a]), words(texts[b])
            if a < b and len(x & y) >= threshold * max(len(x), len(y)) - 1e-9:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in texts}


def corpus(seed=1):
    pick = random.Random(seed)
    stock = [f"stock{i}" for i in range(12)]
    out = []
    for g in range(14):
        base = [pick.choice(stock) for _ in range(pick.randrange(0, 6))] + [f"n{g}x{k}" for k in range(pick.randrange(1, 8))]
        for _ in range(pick.randrange(1, 6)):
            t = list(base)
            for _ in range(pick.randrange(0, 3)):
                t.insert(pick.randrange(len(t) + 1), pick.choice(stock + [f"new{pick.randrange(99)}"]))
            if len(t) > 3 and pick.random() < 0.4:
                t.pop(pick.randrange(len(t)))
            out.append(" ".join(t))
    chain = [f"c{i}" for i in range(30)]
    out += [" ".join(chain[i : i + 12]) for i in range(0, 18, 2)]  # linked one after the other only
    out += ["hot one two three four five six"] * 20 + [f"hot one two three four five six v{i}" for i in range(25)]
    pick.shuffle(out)
    rows = [(f"d{i:03d}", t) for i, t in enumerate(out)]
    return rows + [rows[3], ("d900", None), ("d901", " "), (None, out[0]), ("d902", "solo")]


def test_near_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, claim string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(3))
    want = brute_groups(rows)
    for cost in ({}, {"rare": 2, "cap": 3}, {"rare": 1, "cap": 2, "levels": 2}, {"rare": 3, "cap": 4, "levels": 3, "table": 5}):
        got = {r.id: r.group_id for r in near.near_groups(df, **cost).collect()}
        assert got == want
    pairs = {(r.id_a, r.id_b) for r in near.group_pairs(near.near_groups(df)).collect()}
    assert pairs == {(a, b) for a in want for b in want if a < b and want[a] == want[b]}


def test_near_groups_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", "!")], "id string, claim string")
    assert near.near_groups(df).count() == 0


def test_history_equals_brute_force(spark):
    rows = corpus(2)
    index = history.HistoryIndex.create(spark, partitions=3, crowd=5)
    assert index.labels().count() == 0
    df = spark.createDataFrame([(*r, f"{i % 40:02d}" if i % 9 == 0 else None) for i, r in enumerate(rows)], "id string, text string, digest string")
    # arrivals by id, a repeated row coming again with the last one; the index is opened anew for each
    early = {}
    for low, high in (("", "d060"), ("d060", "d100"), ("d100", "z")):
        index = history.HistoryIndex.open(spark, index.root)
        early |= {r.id: r.first_id for r in index.accept(df.where((F.col("id") >= low) & (F.col("id") < high) | F.col("id").isNull() | (F.col("id") == "d003") & (F.lit(high) == "z"))).collect()}
    index.accept(df.where("false"))
    got = {r.id: r.first_id for r in index.labels().collect()}
    assert set(early) <= set(got) and all(got[k] <= v for k, v in early.items())
    index.drop()
    by_text = brute_groups(rows)
    digests = {}
    for i, (d, _) in enumerate(rows):
        if i % 9 == 0 and d:
            digests.setdefault(f"{i % 40:02d}", []).append(d)
    root = dict(by_text)
    for i in [d for v in digests.values() for d in v]:
        root.setdefault(i, i)
    for same in digests.values():
        for b in same[1:]:
            ra, rb = sorted((root[same[0]], root[b]))
            root = {k: ra if v == rb else v for k, v in root.items()}
    sizes = {}
    for v in root.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert got == {k: v for k, v in root.items() if sizes[v] > 1 and k != v}


def test_history_finds_many_near_copies(spark):
    """One claim of 28 words, in 3,000 records with three words replaced by ones of their own."""
    base, pick, rows = [f"w{i}" for i in range(28)], random.Random(5), []
    for i in range(3000):
        t = list(base)
        for j in pick.sample(range(28), 3):
            t[j] = f"own{i}x{j}"
        rows.append((f"r{i:04d}", " ".join(t), None))
    rows += [(f"s{i:04d}", " ".join([*base[:10], *(f"other{i}x{j}" for j in range(18))]), None) for i in range(400)]  # alone, though they share words
    df = spark.createDataFrame(rows, "id string, text string, digest string")
    index = history.HistoryIndex.create(spark, partitions=4)
    first = index.accept(df.where("id < 'r1500'")).count()
    second = index.accept(df.where("id >= 'r1500'")).count()
    got = {(r.id, r.first_id) for r in index.labels().collect()}
    index.drop()
    assert (first, second) == (1499, 1500) and got == {(r[0], "r0000") for r in rows[1:3000]}


def claims_of_few_words(seed, count):
    """Claims of 1 to 40 words, most of them out of 30, half of them altered copies of others."""
    pick, out = random.Random(seed), []
    for i in range(count):
        if out and pick.random() < 0.5:
            t = list(pick.choice(out))
            for _ in range(pick.randrange(0, max(1, len(t) // 4) + 1)):
                t[pick.randrange(len(t))] = pick.choice([f"c{pick.randrange(30)}", f"own{i}x{pick.randrange(9)}"])
        else:
            t = [f"c{pick.randrange(30)}" for _ in range(pick.randrange(0, 25))] + [f"own{i}x{k}" for k in range(pick.randrange(1, 16))]
        out.append(t)
    return [(f"d{i:04d}", " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("long", [64, 12])
def test_history_of_word_keys_equals_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(history, "FOUNDING", 100)
    monkeypatch.setattr(history, "LONG", long)
    rows = claims_of_few_words(long, 400)
    df = spark.createDataFrame([(*r, None) for r in rows], "id string, text string, digest string")
    index = history.HistoryIndex.create(spark, partitions=3)
    index.accept(df.where("false"))
    for low, high in (("d0000", "d0150"), ("d0150", "d0300"), ("d0300", "d9")):
        index = history.HistoryIndex.open(spark, index.root)
        index.accept(df.where((F.col("id") >= low) & (F.col("id") < high)))
    assert index.meta["words"] and index.frequent[1].size > 5
    got = {r.id: r.first_id for r in index.labels().collect()}
    index.drop()
    assert got == {k: v for k, v in brute_groups(rows).items() if k != v}


def test_history_keeps_few_keys_and_tries_few_pairs(spark, monkeypatch):
    """1,500 claims of 30 words, 24 of them out of 60: far fewer keys than a set's 40 bands, and hardly a pair that is no link."""
    pick, tried = random.Random(6), []
    rows = [(f"r{i:04d}", " ".join(pick.sample([f"c{k}" for k in range(60)], 24) + [f"own{i}x{k}" for k in range(6)]), None) for i in range(1500)]
    rows[1400:] = [(f"r{i:04d}", rows[i - 1400][1].replace(f"own{i - 1400}x1", "late"), None) for i in range(1400, 1500)]
    df = spark.createDataFrame(rows, "id string, text string, digest string")
    index = history.HistoryIndex.create(spark)
    verified = history.HistoryIndex._verified
    monkeypatch.setattr(history.HistoryIndex, "_verified", lambda *a: (r := verified(*a), tried.append(r[1]))[0])
    index.accept(df.where("id < 'r1400'"))
    assert {(r.id, r.first_id) for r in index.accept(df.where("id >= 'r1400'")).collect()} == {(f"r{i:04d}", f"r{i - 1400:04d}") for i in range(1400, 1500)}
    assert index.table("keys").where("key IS NOT NULL").count() < 15 * 1500 and sum(tried) < 1000
    index.drop()


def test_similar_sets_share_a_word_key():
    pick, some = random.Random(3), np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 2000)
    for threshold in (0.75, 0.5):
        for common in (0, 5, 40):
            sets = []
            for _ in range(80):
                base = set(pick.sample(list(some[:40]), pick.randrange(0, 40))) | set(pick.sample(list(some), pick.randrange(1, 20)))
                sets += [base, (base - set(pick.sample(sorted(base), len(base) // 5))) | set(pick.sample(list(some[:60]), len(base) // 6))]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            own, key = history.word_keys(np.concatenate([sorted(s) for s in sets]), offsets, np.array(some[:common]), threshold)
            keys = [set(key[own == i]) for i in range(len(sets))]
            assert len(key) == sum(map(len, keys))
            assert all(keys[i] & keys[j] for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= threshold * max(len(sets[i]), len(sets[j])) - 1e-9)


def test_history_in_another_session_and_after_a_crash(spark, tmp_path, monkeypatch):
    """What one index accepted another one finds; a batch that broke off leaves no trace; a merge of groups is followed."""
    words_ = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    df = lambda *rows: spark.createDataFrame(rows, "id string, text string, digest string")
    root = f"file://{tmp_path}/index"
    index = history.HistoryIndex.create(spark, root)
    assert index.accept(df(("a1", words_(0, 12), None), ("a2", words_(4, 16), None), ("a3", words_(90, 99), None))).count() == 0
    with monkeypatch.context() as m:
        m.setattr(history.HistoryIndex, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.accept(df(("b1", words_(90, 99), None)))
    index = history.HistoryIndex.open(spark.newSession(), root)
    assert [tuple(r) for r in index.accept(df(("c1", words_(2, 14), None), ("c2", words_(90, 100), None))).orderBy("id").collect()] == [("c1", "a1"), ("c2", "a3")]
    assert sorted(map(tuple, index.labels().collect())) == [("a2", "a1"), ("c1", "a1"), ("c2", "a3")]  # c1 joined two groups
    with pytest.raises(FileExistsError):
        history.HistoryIndex.create(spark, root)


def test_band_keys_follow_similarity():
    pick = np.random.default_rng(4)
    base = pick.integers(0, 1 << 62, 40)
    sets = [base, base[:30], np.concatenate([base[:20], pick.integers(0, 1 << 62, 20)]), pick.integers(0, 1 << 62, 40)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    keys = history.band_keys(np.concatenate(sets), offsets, 400, 1)
    same = [(keys[0] == keys[i]).mean() for i in range(4)]
    assert same[0] == 1 and abs(same[1] - 0.75) < 0.08 and abs(same[2] - 1 / 3) < 0.08 and same[3] < 0.02


def test_survivor_rules(spark):
    b = [
        ("b3", "red pump", 0.9, "Tool Result", ["E1", " e2 "], "2025-01-02"), ("b1", "Red  pump!", float("nan"), "tool-result", ["e1", None, ""], "2025-01-03"), ("b2", "RED PUMP", 0.9, "unlisted", None, None),
        ("b4", "red-pump", 0.9, "TOOL_RESULT ", ["e3", "e3"], "2025-01-09"), ("b4", "red-pump", 0.9, "TOOL_RESULT ", ["e3", "e3"], "2025-01-09"),
        ("b5", "lone", 0.5, None, [], None), ("b6", None, 0.5, None, [], None), ("b7", "no value", 2.0, None, None, None), ("b8", "No Value", None, "", [], None), (None, "red pump", 1.0, "tool_result", ["zz"], None),
    ]
    df = spark.createDataFrame(b, "belief_id string, claim string, confidence double, source_class string, evidence_ids array<string>, u string").withColumn("updated_at", F.col("u").cast("timestamp_ntz")).withColumn("rank", F.lit(9))
    trust = spark.createDataFrame([("tool_result", 3), ("document", 2), (None, 1)], "source_class string, trust_rank int")
    got = {r.group_id: r for r in survivor.best_records(df, trust, 0.0).collect()}
    assert set(got) == {"b1", "b7"}
    r = got["b1"]
    assert (r.survivor_id, r.confidence_from, r.n_evidence, r.members, r.evidence) == ("b3", "b2", 3, 4, ["e1", "e2", "e3"])
    assert (got["b7"].survivor_id, got["b7"].confidence_from, got["b7"].n_evidence, got["b7"].truth) == ("b7", "", 0, None)
    assert survivor.best_records(df.where("false"), trust.where("false")).count() == 0


@pytest.mark.parametrize("max_patterns", [100_000, 0])
def test_source_model_finds_the_liar(spark, max_patterns):
    """Three sources that mostly agree and one that invents values; on the driver and as aggregations."""
    pick = random.Random(8)
    said = {}
    for fact in range(600):
        true = fact % 2 == 0
        names = [f"s{s}" for s in range(3) if pick.random() < (0.85 if true else 0.05)] + (["liar"] if pick.random() < 0.5 else [])
        if names:
            said[tuple(sorted(names))] = said.get(tuple(sorted(names)), 0) + 1
    all_ = ["liar", "s0", "s1", "s2"]
    table = spark.createDataFrame([(list(m), all_, n) for m, n in said.items()], "said array<string>, present array<string>, n long")
    quality, truth = survivor.fit_sources(table, max_patterns=max_patterns, rounds=25 if max_patterns else 6)
    sens, spec = zip(*[quality[c] for c in all_])
    assert min(sens[1:]) > sens[0] and min(spec[1:]) > 0.75 > spec[0]
    truth = {tuple(r.said): r.truth for r in truth.collect()}
    assert truth["s0", "s1", "s2"] > 0.9 and truth["liar",] < 0.5


def test_planted_false_evidence(spark):
    """Fourteen sources, two of which invent evidence: what is kept against what is true."""
    pick, rows, good, false = random.Random(3), [], set(), set()
    for g in range(300):
        for k, s in enumerate(pick.sample(range(14), pick.randrange(3, 7))):
            ev = [f"e{g}x{v}" for v in range(4) if pick.random() < 0.8] if s < 12 else [f"e{g}x{v}" for v in range(4) if pick.random() < 0.3] + [f"lie{g}s{s}x{v}" for v in range(3) if pick.random() < 0.7]
            good.update(e for e in ev if e[0] == "e")
            false.update(e for e in ev if e[0] == "l")
            rows.append((f"b{g:03d}{k}", f"claim number {g}", 0.5, f"source {s}", ev))
    df = spark.createDataFrame(rows, "belief_id string, claim string, confidence double, source_class string, evidence_ids array<string>").withColumn("updated_at", F.lit(None).cast("timestamp"))
    trust = spark.createDataFrame([(f"source {s}", s) for s in range(14)], "source_class string, trust_rank int")
    best = survivor.best_records(df, trust, 0.5).collect()
    kept = {e for r in best for e in r.evidence}
    assert len(kept & good) / len(kept) > 0.97 and len(kept & good) / len(good) > 0.95 and sum(r.rejected for r in best) >= 0.9 * len(false)
    quality = {r.source_class: r for r in survivor.source_quality(df, trust).collect()}
    assert max(quality[f"source{s}"].specificity for s in (12, 13)) < min(quality[f"source{s}"].specificity for s in range(12))


def test_scratch_is_shared(spark):
    assert Scratch(spark).root.startswith(spark.conf.get("spark.checkpoint.dir", None) or "file:")


def test_nothing_is_fitted_where_every_value_counts(spark, monkeypatch):
    """p2_found keeps all values whatever the sources are like, so it must not pay for judging them."""
    want = sorted(map(tuple, queries.p2_found(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(survivor, "fit_sources", None)
    assert sorted(map(tuple, queries.p2_found(spark, "/root/testdata/sf0.001").collect())) == want
    best = survivor.best_records(table(spark, "/root/testdata/sf0.001", "beliefs"), table(spark, "/root/testdata/sf0.001", "source_trust"), None)
    assert {(r.rejected, r.truth, len(r.evidence) == r.n_evidence) for r in best.collect()} == {(0, None, True)}
