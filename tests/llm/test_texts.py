"""Conversations, tokens, leaks and reading levels on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from mnemospark.llm import conversations, leaks, reading, tokens
from mnemospark.operators import forest
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "session_id string, turn_id string, parent_turn_id string, role string, content string, occurred_at double, on_current_path boolean"


def talk(spark, rows, per_task=50_000):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s")).withColumn("pos", F.lit(7)).withColumn("flag", F.lit("clash")).repartition(3)
    return sorted(map(tuple, conversations.conversations(df, per_task).collect()))


def test_conversations(spark):
    ok = [("ok", "1", None, " Human:", "hi", 100.0, True), ("ok", "2", "1", "AI", "yes", None, True), ("ok", "2", "1", "AI", "yes", None, True), ("ok", "3", "2", "tool", "", 130_000.0 * 1e7, True), ("ok", "4", "2", "user", "more", 140.0, True), ("ok", "5", "4", "bot", "sure", 140.0, True), ("ok", "x", "1", "???", "aside", 120.0, False)]
    bad = {
        "dangling": [("1", None, "user", "a", 1.0, True), ("2", "9", "assistant", "b", 2.0, True)],
        "loop": [("1", "2", "user", "a", 1.0, True), ("2", "1", "assistant", "b", 2.0, True)],
        "loop_aside": [("1", None, "user", "a", 1.0, True), ("2", "1", "assistant", "b", 2.0, True), ("3", "3", "user", "c", 3.0, False)],
        "differs": [("1", None, "user", "a", 1.0, True), ("2", "1", "assistant", "b", 2.0, True), ("2", "1", "assistant", None, 2.0, True)],
        "role": [("1", None, "user", "a", 1.0, True), ("2", "1", "assistant", "b", 2.0, True), ("3", "2", "", " ", 3.0, True)],
        "no_user": [("1", None, "system", "a", 1.0, True), ("2", "1", "assistant", "b", 2.0, True)],
        "assistant_first": [("1", None, "assistant", "a", 1.0, True), ("2", "1", "user", "b", 2.0, True), ("3", "2", "assistant", "c", 3.0, True)],
        "unanswered": [("1", None, "user", "a", 1.0, True), ("2", "1", "user", "b", 2.0, True), ("3", "2", "assistant", "c", 3.0, True)],
        "open_end": [("1", None, "user", "a", 1.0, True), ("2", "1", "assistant", "b", 2.0, True), ("3", "2", "user", "c", 3.0, True)],
        "blank_answer": [("1", None, "user", "a", 1.0, True), ("2", "1", "assistant", "​　", 2.0, True)],
        "empty": [("1", None, "user", None, 1.0, True)], "off": [("1", None, "user", "a", 1.0, None)],
    }
    rows = ok + [(s, *r) for s, v in bad.items() for r in v] + [(None, "1", None, "user", "a", 1.0, True), ("ok2", None, None, "user", "a", 1.0, True)]
    want = [("ok", 1, "1"), ("ok", 2, "2"), ("ok", 3, "4"), ("ok", 4, "5")]
    assert talk(spark, rows) == want and talk(spark, rows, 3) == want
    assert talk(spark, []) == []


def test_conversation_of_more_trees_than_a_task_holds(spark, monkeypatch):
    rows = [("hot", f"{i:03d}", None, "user" if i % 2 == 0 else "assistant", f"word{i}", 100_000.0 * i, True) for i in range(80)]
    solve, calls = forest._solve, []

    def counted(*a):
        calls.append(a[1])
        assert len(calls) <= 12, calls
        return solve(*a)

    monkeypatch.setattr(forest, "_solve", counted)
    assert talk(spark, rows, 25) == [("hot", i + 1, f"{i:03d}") for i in range(80)]


def test_long_conversation_over_many_tasks(spark):
    n = 240
    rows = [("long", f"{i:04d}", f"{i - 1:04d}" if i else None, "user" if i % 2 == 0 else "model", f"t{i}", None if i % 3 else 1000.0 + i, True) for i in range(n)]
    want = [("long", i + 1, f"{i:04d}") for i in range(n)]
    assert talk(spark, rows + [("s2", "1", None, "user", "a", 1.0, True)], 40) == want
    rows[100] = (*rows[100][:4], " ", *rows[100][5:])  # two replies in a row are sound
    got = talk(spark, rows, 40)
    assert len(got) == n - 1 and got[100] == ("long", 101, "0101")
    rows[101] = (*rows[101][:3], "user", *rows[101][4:])
    rows[103] = (*rows[103][:3], "user", *rows[103][4:])
    assert talk(spark, rows, 40) == []


def test_lost_link_is_guessed(spark):
    rows = [("s", "1", None, "user", "where is the copper valve", 100.0, True), ("s", "2", "1", "assistant", "in the cellar", 110.0, True), ("s", "9", None, "user", "and the copper lamp", 300.0, True), ("s", "8", "9", "assistant", "on the shelf", 300.0, True)]
    assert talk(spark, rows) == [("s", 1, "1"), ("s", 2, "2"), ("s", 3, "9"), ("s", 4, "8")]


def test_latest_of_each_speaker_is_found_however_far_back():
    """A user turn 1,500 rows back, behind assistant turns, is the likelier parent of an assistant's than any of them."""
    n = 1_500
    rows = [("s", 0, 0, "a", 1000.0, 0, "a", 1000.0, ["quiet"], False, False)]
    rows += [("s", 0, 0, f"b{k:05d}", 1000.0 + k / n, 1, "b00001", 1000.0 + 1 / n, ["plain"], False, False) for k in range(1, n + 1)]
    rows += [("s", 0, 0, "z", 1001.5, 1, "z", 1001.5, ["other"], True, True)]
    names = ["session_id", "block", "cut", "turn_id", "time", "code", "root", "root_time", "w", "asked", "own"]
    batches = conversations._best_links(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)]))
    assert [r for b in batches for r in zip(*[c.to_pylist()[:] for c in b.columns[1:3]])] == [("z", "a")]


def interleaved(seed, channels=4, length=30):
    """Turns of a session in which channels with words of their own take turns at random, and their true parents."""
    pick, rows, true, last, at = random.Random(seed), [], {}, {}, 1000.0
    for n in range(channels * length):
        c, at = pick.randrange(channels), at + pick.randrange(5, 90)
        said = [f"c{seed}x{c}w{pick.randrange(14)}" for _ in range(6)] + [f"all{pick.randrange(12)}" for _ in range(5)]
        if c in last and pick.random() < 0.1:
            said.append(last[c])
        rows.append((f"s{seed}", f"t{n:04d}", None, "user" if n % 2 else "assistant", " ".join(said), at, True))
        true[f"t{n:04d}"], last[c] = (c, last.get(c)), f"t{n:04d}"
    return rows, true


@pytest.mark.parametrize("slice_rows", [50_000, 40])
def test_threads_of_interleaved_channels(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(conversations.likely_parents, "__defaults__", (86_400.0, slice_rows))
    sets = [interleaved(k) for k in range(5)]
    df = spark.createDataFrame([r for rows, _ in sets for r in rows], SCHEMA)
    got = {(r.session_id, r.turn_id): r for r in conversations.threads(df, least=0.7).collect()}
    pairs = linked = 0
    for k, (_, true) in enumerate(sets):
        for t, (c, parent) in true.items():
            g = got[f"s{k}", t].parent
            pairs += parent is not None
            linked += parent is not None and g is not None and true[g][0] == c
    assert len(got) == 600 and linked / pairs > 0.9  # links that stay within their channel


def test_threads_keep_what_is_declared(spark):
    rows = [("s", "1", None, "user", "where is the copper valve", 100.0, True), ("s", "2", "1", "assistant", "in the cellar", 110.0, True), ("s", "3", "gone", "user", "and the copper lamp of the cellar", 300.0, True), ("s", "4", None, "user", "entirely new", 900_000.0, True), ("s", "5", "5", "user", "x", 1.0, True), ("s", "6", "2", "tool", "aside", 120.0, False), ("s", "7", None, "user", "no time", None, True)]
    got = {r.turn_id: (r.parent, r.thread, r.depth, r.guessed) for r in conversations.threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"1": (None, "1", 0, False), "2": ("1", "1", 1, False), "3": ("2", "1", 2, True), "4": (None, "4", 0, False), "5": ("5", "", -1, False), "7": (None, "7", 0, False)}
    assert conversations.threads(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_ranks(VOCABULARY))


def test_tokens_equal_public_library(encoder):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    pick = random.Random(2)
    alphabet = "abcdehinorst  's'll.,0123ÄéßçñŁж漢字🙂\n\t ​_-"
    texts = ["", " ", "<|endoftext|> is plain", "a" * 5000, "ab" * 4000, "\r\n\r\n  x", "é ﬁ", "don't WE'LL 12345"]
    texts += ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 200))) for _ in range(800)]
    texts += ["".join(pick.choice("aehinorst") for _ in range(pick.randrange(1, 300))) for _ in range(500)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert b"".join(encoder.text[i] for i in ids).decode() == t


def test_encode_texts(spark, encoder):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_texts(df, VOCABULARY).collect()), key=str)
    assert got == sorted([(1, encoder.encode("hello world"))] * 2 + [(2, []), (3, []), (None, encoder.encode("x"))], key=str)
    assert tokens.encode_texts(df.where("false"), VOCABULARY).count() == 0


def items():
    pick = random.Random(9)
    stock = "answer in one short sentence"
    return [(i, " ".join([f"w{pick.randrange(400)}" for _ in range(30)]) + " " + stock) for i in range(40)]


def test_leaks(spark):
    its = items()
    w = {i: t.split() for i, t in its}
    fill = lambda n, s: " ".join(f"z{s}{k}" for k in range(n))
    docs = [
        (1, f"{fill(90, 'a')} {its[3][1].upper()}. {fill(50, 'b')}"), (2, " ".join(w[4][:19])), (3, " ".join(w[5][:14])), (4, f"{' '.join(w[6][:11])}\n\n{fill(80, 'c')}\n{' '.join(w[6][12:24])}"),
        (5, " ".join(w[7][12:24] + ["zz"] + w[7][:11])), (6, "answer in one short sentence"), (7, None), (8, ""), (9, " ".join(x for k, x in enumerate(w[8]) if k % 6)), (10, " ".join(sorted(w[9]))), (1, "again " + its[3][1]),
        (11, f"{fill(5000, 'd')} {its[0][1]} {fill(5000, 'e')} {its[1][1]}"), (None, its[2][1]),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame([*its, (99, None), (98, " "), its[3]], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    got = sorted(map(tuple, leaks.find_leaks(d, i).select("doc_id", "item_id").collect()))
    assert got == [(1, 3), (2, 4), (4, 6), (9, 8), (11, 0), (11, 1)]
    assert leaks.find_leaks(d.where("false"), i).count() == 0 and leaks.find_leaks(d, i.where("false")).count() == 0


@pytest.mark.parametrize("length", [3, 5, 9, 50, 110, 330, 400, 2000])
def test_leaks_of_any_length(spark, length):
    """Full copies and halves (whole, or as two quarters apart) of short and long items, among other text; a tenth is no leak."""
    pick = random.Random(length)
    word = lambda: f"w{int(pick.paretovariate(0.9)) % 50 if pick.random() < 0.3 else 100 + pick.randrange(3000)}"
    its = [(i, [word() for _ in range(length)]) for i in range(30)]
    half, fill = -(-length // 2), lambda n: [f"z{pick.randrange(9999)}" for _ in range(n)]
    docs, want = [], set()
    for i, w in its:
        lo = pick.randrange(length - half + 1)
        parts = [fill(40) + w + fill(70), fill(30) + w[lo : lo + half] + fill(50)]
        if length >= 50:
            q = -(-half // 2)
            parts.append(fill(20) + w[:q] + fill(90) + w[-q:] + fill(20))
        for k, p in enumerate(parts):
            docs.append((10 * i + k, " ".join(p)))
            want.add((10 * i + k, i))
        docs.append((10 * i + 9, " ".join(fill(50) + w[: length // 10] + fill(50))))
    d, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in its], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, it, words_per_index=7 * length).collect()}  # several parts
    assert want <= got
    assert length < 50 or got == want


def test_leaked_answers(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven eight. The lamp is in the Green   shed"), (2, "one two three four five six seven eight")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, "One two three, four five six seven eight?", ["green shed", "cellar", None])], "item_id bigint, text string, expect array<string>")
    assert sorted(map(tuple, leaks.find_leaks(d, i).collect())) == [(1, 7, 8, 8, 1, 2), (2, 7, 8, 8, 0, 2)]


def test_search_equals_full_scoring():
    index = leaks.ItemIndex([(i, leaks.split(t)) for i, t in items()] + [(99, [f"w{k % 400}" for k in range(300)])])
    pick = random.Random(4)
    n = len(index.need)
    full, often = np.zeros((len(index.term), n)), np.zeros((len(index.term), n))
    for t in range(len(index.term)):
        posts = slice(index.start[t], index.start[t + 1])
        full[t, index.item[posts]], often[t, index.item[posts]] = index.impact[posts], index.often[posts]
    for _ in range(60):
        passages = [np.concatenate([index.words[pick.randrange(40)][: pick.randrange(30)], np.array([pick.randrange(len(index.term)) for _ in range(20)], np.int64)]) for _ in range(5)]
        got, want = [], []
        pairs = [np.unique(p, return_counts=True) for p in passages]
        p, w = index.search(np.repeat(np.arange(5), [len(t) for t, _ in pairs]), np.concatenate([t for t, _ in pairs]), np.concatenate([c for _, c in pairs]), 5)
        got = sorted(zip(p.tolist(), w.tolist()))
        for k, (t, c) in enumerate(pairs):
            want += [(k, int(x)) for x in np.flatnonzero((full[t].sum(0) >= index.need) & (np.minimum(often[t], c[:, None]).sum(0) >= index.run))]
        assert got == want


def test_reading_levels(spark):
    pick = random.Random(7)
    bank = {0: "the cat sat on a mat and he ran to me so we had a nap".split(), 1: "people often follow simple project reports because several written notes explain which records changed".split(), 2: "institutional interdependence necessitates comprehensive reconceptualization notwithstanding methodological considerations circumscribing accountability".split()}
    text = lambda g, n: " ".join(pick.choice(bank[g]) for _ in range(n))
    docs = [(i, text(i % 3, 120)) for i in range(90)]
    labels = [(i, (" Easy", "middle ", "HARD")[i % 3 if i % 17 else 2]) for i in range(60)] + [(1, None), (2, "??"), (999, "easy")]
    extra = [(100, None), (101, "too short"), (102, "x = {1};\n" * 30), (103, text(0, 70) + "\n\n" + text(2, 50)), (104, "7 " * 60)]
    d = spark.createDataFrame(docs + extra, "doc_id bigint, text string").withColumn("reading_level", F.lit("clash")).withColumn("grade", F.lit(1.0))
    lab = spark.createDataFrame(labels, "doc_id bigint, reading_level string").withColumn("text", F.lit("clash"))
    got = dict(map(tuple, reading.reading_levels(d, lab).collect()))
    held_out = [i for i in range(60, 90)]
    assert sum(got[i] == ("easy", "middle", "hard")[i % 3] for i in held_out) == len(held_out)
    assert 100 not in got and 101 not in got and got[103] == "easy" and got[102] in reading.LEVELS and got[104] in reading.LEVELS
    assert {r.reading_level for r in reading.reading_levels(d, lab.where("false")).collect()} == {None}
    assert reading.reading_levels(d.where("false"), lab).count() == 0


def test_isotonic():
    s, f = reading.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 0.0, 1.0, 1.0]))
    assert s.tolist() == [1, 2, 3, 4] and f.tolist() == [0, 1, 1.5, 1.5]
    assert reading.cut_points(np.array([0.0, 1.0, 10.0, 11.0, 20.0]), np.array([0, 0, 1, 1, 2])).tolist() == [5.5, 15.25]
