"""Reading level of documents by a pairwise ranker with isotonic calibration.

Texts are cut to their prose: inline objects, code and tags are cut out of lines, and lines that are log, code, table or heading
are left out. Prose is read in overlapping stretches of CHUNK words, because sentence marks are not to be trusted. A
stretch is described by its words (length, beats, how common they are in the whole corpus) and by its syntax (clause marks,
sentence ends, how common words frame the others, how words of weight stand together), for any language
written in letters. A linear ranker is learned from pairs of labelled documents of different grade, each described by the median
of its stretches. Isotonic regression turns scores of stretches into levels, and a document has the level of most of its stretches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("easy", "middle", "hard")
#: Words of a stretch, least words of a document, labelled documents, evenly spread stretches of each and pairs used for the fit (pairs are drawn with a fixed
#: seed, and all are used where there are fewer), words of the corpus whose frequency is told apart.
CHUNK, LEAST_WORDS, MAX_LABELLED, MAX_STRETCHES, MAX_PAIRS, MAX_VOCABULARY = 15, 40, 5_000, 20, 40_000, 50_000
#: Words as common as the first COMMON of the corpus frame the others.
COMMON, KEPT_WORDS = 300, 500_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_LETTERS = regex.compile(r"\p{L}+")
_SPELLED = regex.compile(r"(\p{L}+)([^\p{L}]*)")
_VOWELS = regex.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ]+")
_NO_PROSE = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d|[{}\[\]|#>]|```)|[{}=|<>]|\t|\w\(")
_MARKED = re.compile(r"[{}=<>`(]")
_INLINE = re.compile(r"`[^`]*`|\{[^{}]*\}|<[^<>]*>|\S+=\S+|\w+\([^()]*\)")


def at_least(n: int, pattern, text: str) -> bool:
    """Whether a pattern occurs n times; no more of the text is read than that takes."""
    return sum(1 for _ in islice(pattern.finditer(text), n)) == n


def prose(text: str) -> str:
    """The prose of a text, or the whole text if it holds none: lines of four words or more without signs of code, log or table."""
    out = []
    for line in text.split("\n"):
        if _NO_PROSE.search(line):
            if not _MARKED.search(line):
                continue
            cut = _INLINE.sub(" ", line)
            while cut != line and "{" in cut:  # nested objects go from the inside out
                line, cut = cut, _INLINE.sub(" ", cut)
            if _NO_PROSE.search(cut):
                continue
            line = cut
        if at_least(4, _LETTERS, line):
            out.append(line)
    return "\n".join(out) or text


class Reader:
    """Features of stretches; `counts` are how often words occur in the whole corpus, common ones only."""

    NAMES = ("length", "7 letters", "10 letters", "3 letters", "beats", "4 beats", "spread", "heavy pairs", "1 beat", "clauses", "ends", "rarity", "unlisted", "framed")

    def __init__(self, counts: dict[str, int]):
        self.total = max(1, sum(counts.values()))
        self.counts = counts
        self.frame = set(sorted(counts, key=lambda w: (-counts[w], w))[:COMMON])
        self.known: dict[str, int] = {}
        self.rows, self.tails, self.tail_rows = np.zeros((1024, 12)), {}, np.zeros((1024, 2))

    def _word(self, w: str) -> int:
        """The row of a word, in either case."""
        k, low = len(self.known), w.lower()
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        n, beats, often = min(len(low), 14), len(_VOWELS.findall(low)), self.counts.get(low, 0)
        self.rows[k] = (n, n * n, n >= 5, n >= 7, n >= 10, n <= 3, beats, beats >= 4, beats <= 1, np.log(self.total / (often + 1)), not often, low in self.frame)
        self.known[w] = k
        return k

    def _tail(self, t: str) -> int:
        """The row of what stands between two words: a clause mark, a sentence end."""
        k = len(self.tails)
        if k == len(self.tail_rows):
            self.tail_rows = np.concatenate([self.tail_rows, np.zeros_like(self.tail_rows)])
        self.tail_rows[k] = any(c in t for c in ",;:("), any(c in t for c in ".!?")
        self.tails[t] = k
        return k

    def stretches(self, text: str) -> np.ndarray:
        """One row of features for each stretch of prose."""
        text = prose(text)
        pairs = _SPELLED.findall(text) or [(w, "") for w in _WORD.findall(text)]
        if not pairs:
            return np.zeros((1, len(self.NAMES)))
        if len(self.known) + len(self.tails) > KEPT_WORDS:
            self.known, self.tails = {}, {}
        known, tails = self.known.get, self.tails.get
        at = [known(w, -1) for w, _ in pairs]
        after = [tails(t, -1) for _, t in pairs]
        for k, (w, t) in enumerate(pairs):
            if at[k] < 0:
                at[k] = self.known[w] if w in self.known else self._word(w)
            if after[k] < 0:
                after[k] = self.tails[t] if t in self.tails else self._tail(t)
        x, marks = self.rows[at], self.tail_rows[after]
        start = np.arange(0, max(1, len(x) - CHUNK + 1), CHUNK // 3)
        end = np.minimum(start + CHUNK, len(x))
        heavy, frame = x[:, 2], x[:, 11]
        stacked = heavy * np.append(heavy[1:], 0.0)
        framed = frame * np.append(1 - frame[1:], 0.0)
        upto = np.concatenate([np.zeros((1, 16)), np.cumsum(np.column_stack([x, stacked, framed, marks]), axis=0)])
        mean = (upto[end] - upto[start]) / (end - start)[:, None]
        spread = np.sqrt(np.maximum(mean[:, 1] - mean[:, 0] ** 2, 0))
        return np.column_stack([mean[:, 0], mean[:, 3], mean[:, 4], mean[:, 5], mean[:, 6], mean[:, 7], spread, mean[:, 12], mean[:, 8], mean[:, 14], mean[:, 15], mean[:, 9], mean[:, 10], mean[:, 13]])


def corpus_words(docs: DataFrame, most: int = MAX_VOCABULARY) -> dict[str, int]:
    """How often the most frequent words occur in all texts; counted where the texts lie, and only `most` words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                here.update(_LETTERS.findall(t.lower()))
            if len(here) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(here)), pa.array(list(here.values()), pa.int64())], ["word", "n"])
                here = Counter()
        if here:
            yield pa.RecordBatch.from_arrays([pa.array(list(here)), pa.array(list(here.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").where("text IS NOT NULL").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return {r["word"]: r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()}


def fit_ranker(x: np.ndarray, grade: np.ndarray, spread: np.ndarray | None = None, rounds: int = 300, ridge: float = 0.05) -> np.ndarray:
    """Weights whose score is higher for the harder document of a pair (logistic loss on differences).

    Features are measured by their spread over stretches, if it is given, so that what changes within a text weighs little.
    """
    scale = (x.std(0) if spread is None else np.maximum(spread, x.std(0))) + 1e-9
    z = x / scale
    pick = np.random.default_rng(7)
    a, b = pick.integers(0, len(z), (2, MAX_PAIRS))
    keep = grade[a] > grade[b]
    diff = z[a[keep]] - z[b[keep]]
    w = np.zeros(x.shape[1])
    step = 4.0 / (np.square(diff).sum(1).mean() + 1e-9) if len(diff) else 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        w = w + step * ((diff * p[:, None]).mean(0) - ridge * w) if len(diff) else w
    return w / scale


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step function of least squares (pool adjacent violators): (sorted scores, fitted grades)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for y in grade[order].astype(float):
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, n2 = blocks.pop()
            y1, n1 = blocks.pop()
            blocks.append([(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2])
    return score[order], np.repeat([y for y, _ in blocks], [n for _, n in blocks])


def cut_points(score: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Scores at which the calibrated grade passes 0.5 and 1.5, straight between the centres of the fitted steps.

    Centres, not edges: a few wrong labels at an edge then move a cut only a little.
    """
    s, fitted = isotonic(score, grade)
    steps, at = np.unique(fitted, return_inverse=True)
    centre = np.bincount(at, s) / np.bincount(at)
    out = []
    for want in (0.5, 1.5):
        k = int(np.searchsorted(steps, want))
        if k == 0 or k == len(steps):
            out.append(-np.inf if k == 0 else np.inf)
        else:
            out.append(centre[k - 1] + (want - steps[k - 1]) / (steps[k] - steps[k - 1]) * (centre[k] - centre[k - 1]))
    return np.array(out)


def level_of(scores: np.ndarray, cuts: np.ndarray) -> str:
    """The level of most stretches, which are of about one length; of equals the one nearest the median."""
    votes = np.bincount(np.searchsorted(cuts, scores, side="right"), minlength=3)
    middle = int(np.searchsorted(cuts, np.median(scores), side="right"))
    return LEVELS[min(np.flatnonzero(votes == votes.max()), key=lambda k: abs(k - middle))]


def _grades(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, grade): the median of a document's readable labels, of at most max_labelled documents by hash."""
    plain = F.lower(F.regexp_replace("reading_level", r"[^\p{L}]+", ""))
    grade = F.when(plain == "easy", 0).when(plain == "middle", 1).when(plain == "hard", 2)
    each = labels.where("doc_id IS NOT NULL").select("doc_id", grade.alias("g")).where("g IS NOT NULL").groupBy("doc_id").agg(F.percentile("g", F.lit(0.5)).alias("grade"))
    return each.where("grade = floor(grade)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit(docs: DataFrame, labels: DataFrame, counts: dict[str, int], max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, cut points), or None without labelled documents of two grades."""
    chosen = _grades(labels, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(Reader(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, some = [], []
            for t in b.column("text").to_pylist():
                f = shared.value.stretches(t)
                x.append(np.median(f, axis=0).tolist())
                some.append(f[np.unique(np.linspace(0, len(f) - 1, MAX_STRETCHES).astype(int))].reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(x, pa.list_(pa.float64())), pa.array(some, pa.list_(pa.float64()))], ["grade", "x", "some"])

    joined = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("grade", "text")  # at most max_labelled rows
    got = joined.mapInArrow(run, "grade double, x array<double>, some array<double>").toPandas()
    if got["grade"].nunique() < 2:
        return None
    got = got.sort_values(["grade", "x"], key=lambda c: c if c.name == "grade" else c.map(tuple))
    return model(np.array(got["x"].tolist()), got["grade"].to_numpy(), [np.array(f).reshape(-1, len(Reader.NAMES)) for f in got["some"]])


def model(x: np.ndarray, grade: np.ndarray, some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cut points): ranked by documents' medians, calibrated on stretches, which is what the cuts are used on."""
    every = np.concatenate(some)
    w = fit_ranker(x, grade, every.std(0))
    return w, cut_points(every @ w, np.repeat(grade, [len(f) for f in some]))


def reading_levels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, reading_level) of every document of at least LEAST_WORDS words.

    Null and shorter texts give no row; repeated documents give one each; a null doc_id is kept.
    Labels that can't be read, or that split evenly between raters, take no part; at most
    max_labelled labelled documents are used for the fit. Without labels of two grades the level is null.
    Whole texts are read: once to count words, once to judge; only word counts are shuffled.
    """
    counts = corpus_words(docs)
    fitted = fit(docs, labels, counts, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(Reader(counts))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, levels = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                if at_least(LEAST_WORDS, _WORD, t):
                    rows.append(k)
                    levels.append(level_of(shared.value.stretches(t) @ fitted[0], fitted[1]) if fitted else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(levels, pa.string())], ["doc_id", "reading_level"])

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, f"doc_id {kind}, reading_level string")
