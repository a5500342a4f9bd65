"""Evaluation texts leaking into training text.

The test items, cut into windows where they are long, form a BM25 inverted index. Windows are numbered, and
every posting list carries its maximum for each range of BLOCK windows (block-max). Every passage of every
document is a query. A passage is dropped if the list maxima of its words can't reach any window's threshold; then
only the ranges whose block maxima can reach the threshold of a window there are opened, and their
postings scored. Each item retrieved is verified on the whole document by aligning words in order.

A window's threshold is no tuned number. Who holds `share` of an item in one or two runs holds a run of c words, c
being half of that share (LEAST_RUN at least, RUN at most), and c words that follow each other closely enough
score no less than the c cheapest words of some stretch of the window. So whatever is to be found is
retrieved, for items of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_WORD = regex.compile(r"[\p{L}\p{N}]+")
K1, B, BLOCK = 1.2, 0.75, 16
#: Length and step in words of passages and item windows, words of a run that decide a threshold at most, words indexed together at most.
PASSAGE, STEP, RUN, WORDS_PER_INDEX = 64, 32, 14, 500_000
#: Alignment: widest gap in words inside a run, cost of a skipped word, least words and density of a run.
GAP, SKIP, LEAST_RUN, DENSITY = 3, 0.3, 6, 0.6


def split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def least_run(words: int, share: float) -> int:
    """Least words of a run that counts: LEAST_RUN, but no more than the share of a short item."""
    return max(1, min(LEAST_RUN, int(np.ceil(share * words - 1e-9))))


def stretch(c: int) -> int:
    """Words within which some c successive words of a run lie, on both sides: runs are DENSITY dense on the longer side."""
    return int(np.floor(c * (2 / DENSITY - 1) + 1e-9))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _places(words: np.ndarray) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words.tolist()):
        out.setdefault(w, []).append(i)
    return out


def _cheapest(words: np.ndarray, impact: dict[int, float], c: int) -> float:
    """No more than the score of any c words of a stretch of the window, counting each distinct word once."""
    best, span = np.inf, max(c, stretch(c))
    for lo in range(0, max(1, len(words) - span + 1)):
        left, score = c, 0.0
        often = Counter(words[lo : lo + span].tolist())
        for price, k in sorted((impact[w] / k, k) for w, k in often.items()):
            take = min(k, left)
            score, left = score + price * take, left - take
            if not left:
                break
        best = min(best, score)
    return float(best)


class ItemIndex:
    """Inverted index of the windows of test items, with maxima by block of windows."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float = 0.5):
        self.ids, self.share = [i for i, _ in items], share
        self.term: dict[str, int] = {}
        self.words = [np.array([self.term.setdefault(w, len(self.term)) for w in ws], np.int64) for _, ws in items]
        self.owner, parts = [], []
        for k, w in enumerate(self.words):
            starts = [0] if len(w) <= PASSAGE else [*range(0, len(w) - PASSAGE, STEP), len(w) - PASSAGE]
            self.owner += [k] * len(starts)
            parts += [w[s : s + PASSAGE] for s in starts]
        self.owner, n = np.array(self.owner, np.int64), len(parts)
        mean = np.mean([len(p) for p in parts]) if parts else 1.0
        counts = [Counter(p.tolist()) for p in parts]
        df = Counter(t for c in counts for t in c)
        lists: list[list[tuple[int, float, list[int]]]] = [[] for _ in self.term]
        self.need, self.run = np.zeros(n), np.zeros(n, np.int64)
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(parts[k]) / mean)
            impact = {t: float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)) for t, tf in c.items()}
            where = _places(parts[k])
            for t, v in impact.items():
                lists[t].append((k, v, where[t]))
            whole = len(self.words[self.owner[k]])
            run = max(least_run(whole, share), min(RUN, int(np.ceil(np.ceil(share * whole - 1e-9) / 2))))
            self.run[k] = min(run, len(parts[k]))
            self.need[k] = max(_cheapest(parts[k], impact, int(self.run[k])) - 1e-9, 1e-9)
        size = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.item = np.array([k for x in lists for k, _, _ in x], np.int64)
        self.impact = np.array([v for x in lists for _, v, _ in x])
        self.often = np.array([len(w) for x in lists for _, _, w in x], np.int64)
        self.place_at = np.cumsum(self.often) - self.often
        self.place = np.array([i for x in lists for _, _, w in x for i in w], np.int64)
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if n else np.zeros(0)
        # a block is the part of a list that lies in one range of windows
        row = np.repeat(np.arange(len(lists)), size)
        self.key = row * max(n, 1) + self.item
        self.ranges = -(-n // BLOCK)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)]) if n else np.zeros(0, bool)
        self.block_at = np.flatnonzero(new)
        self.block_end = np.append(self.block_at[1:], len(self.item))
        self.block_range = self.item[self.block_at] // BLOCK
        self.block_most = np.maximum.reduceat(self.impact, self.block_at) if n else np.zeros(0)
        self.block_start = np.searchsorted(row[self.block_at], np.arange(len(lists) + 1)) if n else np.zeros(1, np.int64)
        self.range_need = np.minimum.reduceat(self.need, np.arange(0, n, BLOCK)) if n else np.zeros(0)
        self.least_need = self.need.min() if n else np.inf
        self.places = [_places(w) for w in self.words]
        self.bag = [_distinct(w) for w in self.words]

    def search(self, passage: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, window) of all windows whose score over a passage's terms reaches their need, for n passages at once.

        passage and term are the distinct pairs of both, passages in order, `times` says how often. A window must also share
        as many words with the passage as a run has.
        """
        reach = np.bincount(passage, self.most[term], n)
        keep = reach[passage] >= self.least_need
        passage, term, times = passage[keep], term[keep], times[keep]
        none = np.empty(0, np.int64)
        if not len(term):
            return none, none
        sizes = self.block_start[term + 1] - self.block_start[term]
        block = np.repeat(self.block_start[term], sizes) + _within(sizes)
        pair = np.repeat(np.arange(len(term)), sizes)
        at = passage[pair] * self.ranges + self.block_range[block]
        open_ = np.bincount(at, self.block_most[block], n * self.ranges).reshape(n, self.ranges) >= self.range_need[None, :]
        live = open_.reshape(-1)[at]
        block, pair = block[live], pair[live]
        sizes = self.block_end[block] - self.block_at[block]
        post, pair = np.repeat(self.block_at[block], sizes) + _within(sizes), np.repeat(pair, sizes)
        width = BLOCK * self.ranges
        spot = passage[pair] * width + self.item[post]
        score = np.bincount(spot, self.impact[post], n * width)
        shared = np.bincount(spot, np.minimum(times[pair], self.often[post]), n * width)
        good = np.flatnonzero((score > 0).reshape(n, width)[:, : len(self.need)] & (score.reshape(n, width)[:, : len(self.need)] >= self.need) & (shared.reshape(n, width)[:, : len(self.need)] >= self.run))
        return good // len(self.need), good % len(self.need)

    def aligned(self, passage: np.ndarray, window: np.ndarray, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the words of a run lie about one diagonal of passage and window: a run's shift changes by its gaps only."""
        sizes = last[passage] - first[passage]
        pair = np.repeat(np.arange(len(passage)), sizes)
        j = np.repeat(first[passage], sizes) + _within(sizes)
        there = flat[j] >= 0
        pair, j = pair[there], j[there]
        want = flat[j] * max(1, len(self.need)) + window[pair]
        post = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[post] == want
        pair, j, post = pair[hit], j[hit], post[hit]
        sizes = self.often[post]
        pair, j, post_, i = np.repeat(pair, sizes), np.repeat(j, sizes), np.repeat(post, sizes), self.place[np.repeat(self.place_at[post], sizes) + _within(sizes)]
        drift = stretch(RUN) - RUN + 1
        shift = j - first[passage[pair]] - i + PASSAGE
        bands = 2 * PASSAGE // drift + 2
        out = np.zeros(len(passage), bool)
        for half in (0, 1):  # bands of twice the drift, every `drift` places: a run lies in one, with its words and their score
            spot = pair * bands + (shift + half * drift) // (2 * drift)
            count = np.bincount(spot, minlength=len(passage) * bands)
            some = np.flatnonzero((count >= self.run[window[np.arange(len(count)) // bands]])[spot])
            near = _distinct(spot[some])[0]
            way = np.searchsorted(near, spot[some])
            if not len(near):
                continue
            own = window[near // bands]
            places = _distinct(way * PASSAGE + (j - first[passage[pair]])[some])[0] // PASSAGE
            terms = _distinct(way * len(self.key) + post_[some])[0]
            enough = (np.bincount(places, minlength=len(near)) >= self.run[own]) & (np.bincount(terms // len(self.key), self.impact[terms % len(self.key)], len(near)) >= self.need[own])
            out[near[enough] // bands] = True
        return out

    def retrieve(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(document, item) retrieved by any passage; documents are given as term numbers (-1: no such term)."""
        out: set[tuple[int, int]] = set()
        owner, first, last = [], [], []
        base = 0
        for k, d in enumerate(docs):
            starts = np.arange(0, max(1, len(d) - PASSAGE + STEP), STEP)
            owner.append(np.full(len(starts), k))
            first.append(base + starts)
            last.append(base + np.minimum(starts + PASSAGE, len(d)))
            base += len(d)
        if not base or not len(self.need):
            return []
        flat, owner, first, last = np.concatenate(docs), np.concatenate(owner), np.concatenate(first), np.concatenate(last)
        reach = np.concatenate([[0.0], np.cumsum(np.where(flat >= 0, self.most[flat], 0.0))])
        likely = np.flatnonzero(reach[last] - reach[first] >= self.least_need)
        step = max(1, min(2_000, 4_000_000 // (BLOCK * max(1, self.ranges))))
        for lo in range(0, len(likely), step):
            some = likely[lo : lo + step]
            sizes = last[some] - first[some]
            words = flat[np.repeat(first[some], sizes) + _within(sizes)]
            at = np.repeat(np.arange(len(some)), sizes)[words >= 0]
            pair, times = _distinct(at * len(self.term) + words[words >= 0])
            p, w = self.search(pair // len(self.term), pair % len(self.term), times, len(some))
            if len(p):
                p = some[p]
                for cut in range(0, len(p), 5_000):  # bounds the memory that word pairs take
                    q, v = p[cut : cut + 5_000], w[cut : cut + 5_000]
                    good = self.aligned(q, v, flat, first, last)
                    out.update(zip(owner[q[good]].tolist(), self.owner[v[good]].tolist()))
        return sorted(out)


def held_words(places: dict[int, list[int]], doc: list[int], least: int = LEAST_RUN) -> int:
    """Most words of an item (word -> its places) that the document holds in order, in one or two runs.

    A run is a chain of equal words whose gaps are at most GAP words on either side; each word
    skipped costs SKIP, a run has `least` words at least and DENSITY of the words it spans.
    Only equal words are visited, so the cost follows the matches.
    """
    recent: list[tuple[int, list[tuple[int, float, int, int, int]]]] = []
    runs: list[tuple[int, int, int, int, int]] = []
    for j, word in enumerate(doc):
        at = places.get(word)
        if at is None:
            continue
        while recent and recent[0][0] < j - GAP:
            recent.pop(0)
        new = []
        for i in at:
            best, count, si, sj = 0.0, 0, i, j
            for pj, ends in recent:
                for pi, score, c, fi, fj in ends:
                    if 0 < i - pi <= GAP:
                        cand = score - SKIP * (i - pi + j - pj - 2)
                        if cand > best:
                            best, count, si, sj = cand, c, fi, fj
            new.append((i, best + 1, count + 1, si, sj))
            count += 1
            if count >= least and count >= DENSITY * (max(i - si, j - sj) + 1):
                runs.append((j, i, count, si, sj))
        recent.append((j, new))
    # two runs in order: best earlier run by where it ends, swept along the document
    most, ended, k = 0, {}, 0
    for j, i, count, si, sj in sorted(runs, key=lambda r: r[4]):
        while k < len(runs) and runs[k][0] < sj:
            ended[runs[k][1]] = max(ended.get(runs[k][1], 0), runs[k][2])
            k += 1
        most = max(most, count + max((c for e, c in ended.items() if e < si), default=0))
    return most


def phrase_held(phrase: list[str], doc: list[str], at: dict[str, list[int]]) -> bool:
    """Whether the document holds the words of an answer one after the other."""
    return bool(phrase) and any(doc[i : i + len(phrase)] == phrase for i in at.get(phrase[0], ()))


def _indexes(items: DataFrame, share: float, words_per_index: int) -> list[tuple[ItemIndex, list[list[list[str]]]]]:
    """Indexes of at most `words_per_index` words each (one item at least), with the answers of their items."""
    has_answers = "expect" in items.columns
    chosen = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text", F.col("expect") if has_answers else F.lit(None).cast("array<string>").alias("expect"))
    out, some, answers, size = [], [], [], 0
    for r in chosen.distinct().orderBy("item_id", "text", "expect").toLocalIterator():
        words = split(r["text"])
        if not words:
            continue
        if some and size + len(words) > words_per_index:
            out.append((ItemIndex(some, share), answers))
            some, answers, size = [], [], 0
        some.append((r["item_id"], words))
        answers.append([split(e) for e in r["expect"] or [] if e])
        size += len(words)
    return out + [(ItemIndex(some, share), answers)] if some else out


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.5, words_per_index: int = WORDS_PER_INDEX) -> DataFrame:
    """(doc_id, item_id, held, words, answers_held, answers): documents that hold at least `share` of an item's words.

    held of the item's `words` words are held in order, see held_words(); items of any length are found, those of under
    2 * LEAST_RUN words by runs of half their words. answers_held of the item's `answers` expected answers
    (column `expect`, if there is one) stand in the document too. Case, punctuation and line breaks don't matter. Null
    and wordless texts and items and null ids give nothing; each pair comes once however often a
    document or item is repeated, with the most that was found. The corpus is read once for any number of items: they are indexed in
    parts of at most words_per_index words, each broadcast, and a task takes a batch of documents through
    one part after the other. A document of any length is searched whole.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    shared = [spark.sparkContext.broadcast(part) for part in _indexes(items, share, words_per_index)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, found = batch.column(0), [], [[], [], [], [], []]
            texts = [split(t) for t in batch.column(1).to_pylist()]
            for part in shared:
                index, answers = part.value
                number = index.term.get
                numbered = [np.array([number(w, -1) for w in t], np.int64) for t in texts]
                last, doc, at = -1, [], {}
                for row, item in index.retrieve(numbered):
                    if row != last:
                        last, doc, at = row, numbered[row].tolist(), {}
                        have = np.bincount(numbered[row][numbered[row] >= 0], minlength=len(index.term))
                    whole = len(index.words[item])
                    if np.minimum(have[index.bag[item][0]], index.bag[item][1]).sum() < share * whole:
                        continue
                    held = held_words(index.places[item], doc, least_run(whole, share))
                    if held < share * whole:
                        continue
                    if answers[item] and not at:
                        for k, w in enumerate(texts[row]):
                            at.setdefault(w, []).append(k)
                    rows.append(row)
                    for column, value in zip(found, (index.ids[item], held, whole, sum(phrase_held(a, texts[row], at) for a in answers[item]), len(answers[item]))):
                        column.append(value)
                if len(shared) > 4:  # parts are read again for the next batch, so a task holds one at a time
                    part.__dict__.pop("_value", None)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(found[0], item_type), *[pa.array(c, pa.int32()) for c in found[1:]]], ["doc_id", "item_id", "held", "words", "answers_held", "answers"])

    hits = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, held int, words int, answers_held int, answers int")
    best = F.max(F.struct("held", "words", "answers_held", "answers")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
