"""Set-similarity joins on distinct words: grouped prefixes, with longer keys only where buckets are crowded.

Two sets are similar if they share at least `threshold` of the larger one's words. A set of n words
needs t = ceil(threshold n) shared words, so two similar sets share at least k words among the
first n - t + k of each, in one global order that puts seldom words first.

* Sets with the same prefix and size are one group. Groups are keyed, and pairs of groups are filtered
  by size and by the words that all or none of their members can hold; only then are members compared.
* Level 1 keys a group by each word of its prefix. A word whose bucket holds more than `cap` groups is
  left out there; pairs of it with another frequent word are keys of level 2, crowded pairs make
  triples, and so on. A similar pair that meets in no bucket of a level has only crowded keys in common
  there, and so meets on the next level: nothing is lost, and no key is made that isn't needed.
* The order, and so the result, is the same for all rows; `rare`, `cap`, `levels` and `table` change the cost only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import Scratch

SETS = "rep string, side int, n int, common int, hashes array<bigint>, head array<bigint>, pkey binary, b0 bigint, b1 bigint"
KEYED = "key bigint, pkey binary, side int, n int, a0 bigint, a1 bigint, o0 bigint, o1 bigint, at array<int>"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def least_shared(n: np.ndarray, threshold: float) -> np.ndarray:
    """Words that a set of n words must share with any partner."""
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def bitmaps(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits in two halves on which the words of each set are spread; no set is empty."""
    bit = np.uint64(1) << (hashes.view(np.uint64) & np.uint64(63))
    upper = (hashes >> 6) & 1 == 1
    none = np.uint64(0)
    return tuple(np.bitwise_or.reduceat(np.where(upper == half, bit, none), starts).view(np.int64) for half in (False, True))


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _join_words(words: list[np.ndarray], level: int) -> np.ndarray:
    key = np.full(len(words[0]), np.uint64(level))
    for w in words:
        key = mixed(key * np.uint64(31) ^ w.view(np.uint64))
    return key.view(np.int64)


class PrefixJoin:
    """The join over classes(rep, words[, side]): words are distinct strings, no class is empty.

    With `side` (1 left, 2 right, 3 both) only pairs of a left and a right set are formed.
    """

    def __init__(self, classes: DataFrame, threshold: float, scratch: Scratch, rare: int = 32, cap: int = 128, levels: int = 4, table: int = 200_000):
        self.threshold, self.scratch, self.rare, self.cap, self.levels = threshold, scratch, rare, cap, levels
        self.context = classes.sparkSession.sparkContext
        side = F.col("side").cast("int") if "side" in classes.columns else F.lit(3)
        hashed = classes.select("rep", side.alias("side"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
        # how often words occur counts over all classes; the table of frequent ones is bounded, words beyond it stand with the seldom ones
        freq = hashed.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > rare)
        top = freq.orderBy(F.desc("df"), "h").limit(table).toArrow()
        order = np.argsort(top["h"].to_numpy())
        self.order = self.context.broadcast((top["h"].to_numpy()[order], top["df"].to_numpy()[order]))
        self.sets = scratch.save(hashed.mapInArrow(self._rank(), SETS))
        both = [F.expr(f"bit_and(b{i})").alias(f"a{i}") for i in (0, 1)] + [F.expr(f"bit_or(b{i})").alias(f"o{i}") for i in (0, 1)]
        same = [F.first(c).alias(c) for c in ("n", "common", "head")]
        self.groups = scratch.save(self.sets.groupBy("pkey").agg(F.expr("bit_or(side)").alias("side"), F.count("*").alias("held"), *same, *both))
        one = F.least("n", F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)
        counted = self.groups.select(F.explode(F.slice("head", 1, one)).alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > cap)
        crowded = counted.orderBy(F.desc("c"), "h").limit(table).toArrow()
        self.crowded = self.context.broadcast(np.sort(crowded["h"].to_numpy()))

    def _rank(self):
        shared, threshold, levels = self.order, self.threshold, self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, often = shared.value
            for b in batches:
                if b.num_rows == 0:
                    continue
                flat, offsets = _arrays(b.column("hashes"))
                n = np.diff(offsets)
                row = np.repeat(np.arange(len(n)), n)
                df = np.zeros(len(flat), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    df = np.where(known[at] == flat, often[at], 0)
                flat = flat[np.lexsort((flat, df, row))]
                common = np.bincount(row[df > 0], minlength=len(n))
                size = np.minimum(n, n - least_shared(n, threshold) + levels)
                place = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
                head = flat[place < np.repeat(size, n)]
                ends = np.cumsum(size)
                name = [hashlib.blake2b(head[e - s : e].tobytes() + int(m).to_bytes(8, "little"), digest_size=16).digest() for e, s, m in zip(ends.tolist(), size.tolist(), n.tolist())]
                b0, b1 = bitmaps(flat, offsets[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep"), b.column("side"), pa.array(n, pa.int32()), pa.array(common, pa.int32()), _lists(flat, n, pa.int64()), _lists(head, size, pa.int64()), pa.array(name, pa.binary()), pa.array(b0), pa.array(b1)],
                    names=["rep", "side", "n", "common", "hashes", "head", "pkey", "b0", "b1"],
                )

        return run

    def _keyed(self, make) -> object:
        """An Arrow step that turns groups into key rows; `make` gives (row, key, positions) triples of arrays."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows == 0:
                    continue
                head, offsets = _arrays(b.column("head"))
                for row, key, at in make(b, head, offsets[:-1], b.column("n").to_numpy().astype(np.int64), b.column("common").to_numpy().astype(np.int64)):
                    for lo in range(0, len(row), 100_000):
                        part = slice(lo, lo + 100_000)
                        take = pa.array(row[part])
                        sizes = np.full(len(row[part]), at.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(key[part]), *[b.column(c).take(take) for c in ("pkey", "side", "n", "a0", "a1", "o0", "o1")], _lists(at[part].reshape(-1).astype(np.int32), sizes, pa.int32())], names=["key", "pkey", "side", "n", "a0", "a1", "o0", "o1", "at"])

        return run

    def first(self) -> DataFrame:
        """Key rows of levels 1 and 2."""
        shared, threshold = self.crowded, self.threshold

        def make(b, head, start, n, common):
            crowded = shared.value
            need = least_shared(n, threshold)
            one, two = np.minimum(n, n - need + 1), np.minimum(n, n - need + 2)
            row = np.repeat(np.arange(len(n)), one)
            place = np.arange(len(row)) - np.repeat(np.cumsum(one) - one, one)
            word = head[start[row] + place]
            hot = np.isin(word, crowded) & (place >= (n - common)[row])
            lone = hot & (need[row] <= 1)
            yield row[~hot], _join_words([word[~hot]], 1), place[~hot][:, None]
            yield row[lone], _join_words([word[lone]], -1 & 0xFF), place[lone][:, None]
            # pairs of frequent words, one of them crowded and in the first prefix
            from_ = np.minimum(n - common, two)
            many = two - from_
            for c in np.unique(many[many > 1]):
                rows = np.flatnonzero(many == c)
                block = max(1, 2_000_000 // (int(c) * int(c)))
                i, j = np.triu_indices(int(c), 1)
                for lo in range(0, len(rows), block):
                    some = rows[lo : lo + block]
                    at = from_[some][:, None] + np.arange(c)[None, :]
                    w = head[start[some][:, None] + at]
                    open_ = np.isin(w, crowded) & (at < one[some][:, None])
                    r, k = np.nonzero(open_[:, i] | open_[:, j])
                    yield some[r], _join_words([w[r, i[k]], w[r, j[k]]], 2), np.stack([at[r, i[k]], at[r, j[k]]], 1)

        return self.groups.mapInArrow(self._keyed(make), KEYED)

    def longer(self, hot: DataFrame, level: int) -> DataFrame:
        """Key rows of level + 1 for the crowded key rows of a level."""
        threshold = self.threshold

        def make(b, head, start, n, common):
            flat, offsets = _arrays(b.column("at"))
            at = flat.reshape(len(n), -1).astype(np.int64) if len(n) else flat.reshape(0, 1)
            upto = np.minimum(n, n - least_shared(n, threshold) + level + 1)
            from_ = np.minimum(n - common, upto)
            many = upto - from_
            for c in np.unique(many[many > level]):
                rows = np.flatnonzero(many == c)
                block = max(1, 2_000_000 // int(c))
                for lo in range(0, len(rows), block):
                    some = rows[lo : lo + block]
                    new = from_[some][:, None] + np.arange(c)[None, :]
                    r, k = np.nonzero(~(new[:, :, None] == at[some][:, None, :]).any(2))
                    full = np.sort(np.concatenate([at[some[r]], new[r, k][:, None]], 1), axis=1)
                    words = [head[start[some[r]] + full[:, x]] for x in range(full.shape[1])]
                    yield some[r], _join_words(words, level + 1), full

        rows = hot.where(F.size("at") == level).select("pkey", "at").join(self.groups, "pkey")
        return rows.mapInArrow(self._keyed(make), KEYED).dropDuplicates(["pkey", "key"])

    def split(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """(cold, hot, is there any hot): key rows of buckets with 2 to `cap` groups, and of larger ones."""
        size = self.scratch.save(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        large = size.where(F.col("size") > self.cap)
        return keyed.join(size.where(F.col("size") <= self.cap).select("key"), "key"), keyed.join(large, "key"), large.limit(1).count() > 0

    def stays(self, level: int) -> Column:
        """Crowded key rows to be compared as they are: a partner of no larger size may share just `level` words, or the word is seldom by order."""
        return (F.ceil(F.col("n") * F.lit(self.threshold) - F.lit(1e-9)) <= level) | (F.size("at") < level)

    def may_link(self, a: str = "x", b: str = "y") -> Column:
        """False only where no member of one group can reach the threshold with a member of the other."""
        c = lambda side, name: F.col(f"{side}.{name}")
        most, least = F.greatest(c(a, "n"), c(b, "n")), F.least(c(a, "n"), c(b, "n"))
        apart = F.lit(0)
        for i in (0, 1):
            for p, q in ((a, b), (b, a)):
                apart = apart + F.bit_count(c(p, f"a{i}").bitwiseAND(F.bitwise_not(c(q, f"o{i}"))))
        need = most * F.lit(self.threshold) - F.lit(1e-9)
        sides = lambda p, q: (c(p, "side").bitwiseAND(F.lit(1)) > 0) & (c(q, "side").bitwiseAND(F.lit(2)) > 0)
        return (sides(a, b) | sides(b, a)) & (least >= need) & (apart <= c(a, "n") + c(b, "n") - F.lit(2.0) * need)

    def group_pairs(self, rows: DataFrame) -> DataFrame:
        """(pa, pb): pairs of different groups that share a bucket and may hold a link."""
        x, y = rows.alias("x"), rows.alias("y")
        return x.join(y, F.expr("x.key = y.key AND x.pkey < y.pkey") & self.may_link()).select(F.col("x.pkey").alias("pa"), F.col("y.pkey").alias("pb")).distinct()

    def salted(self, x: DataFrame, y: DataFrame, on: Column, slice_: int = 4096) -> DataFrame:
        """x joined with y on key where buckets (of `size` rows) may be huge: y is cut into slices, x goes to each."""
        slices = F.ceil(F.col("size") / F.lit(slice_)).cast("int")
        left = x.withColumn("cut", F.explode(F.sequence(F.lit(0), slices - 1))).alias("x")
        right = y.withColumn("cut", F.pmod(F.xxhash64("rep"), slices).cast("int")).alias("y")
        return left.join(right, F.expr("x.key = y.key AND x.cut = y.cut") & on)

    def members(self, rows: DataFrame) -> DataFrame:
        """Key rows of groups as rows of their members, with the members' own bitmaps as bounds."""
        own = self.sets.select("pkey", "rep", "side", "n", F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("b0").alias("o0"), F.col("b1").alias("o1"))
        return rows.select("key", "pkey", "size", *[c for c in rows.columns if c == "at"]).join(own, "pkey")

    def crowds(self) -> DataFrame:
        """Members of groups of two or more, as a bucket of their own (size is the group's)."""
        return self.members(self.groups.where("held > 1").select(F.xxhash64("pkey").alias("key"), "pkey", F.col("held").alias("size")))

    def expanded(self, pairs: DataFrame) -> DataFrame:
        """(a, b, sim), a < b: linked members of the group pairs."""
        side = lambda x: self.sets.select(F.col("pkey").alias(f"p{x}"), F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"), F.col("b0").alias(f"b0{x}"), F.col("b1").alias(f"b1{x}"))
        return self._exact(pairs.join(side("a"), "pa").join(side("b"), "pb"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, sim), a < b: the linked ones of the set pairs (a, b)."""
        side = lambda x: self.sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"), F.col("b0").alias(f"b0{x}"), F.col("b1").alias(f"b1{x}"))
        return self._exact(pairs.join(side("a"), "a").join(side("b"), "b"))

    def _exact(self, both: DataFrame) -> DataFrame:
        apart = F.bit_count(F.col("b0a").bitwiseXOR(F.col("b0b"))) + F.bit_count(F.col("b1a").bitwiseXOR(F.col("b1b")))
        larger, shared = F.greatest("na", "nb"), F.size(F.array_intersect("ha", "hb"))
        need = larger * F.lit(self.threshold) - F.lit(1e-9)
        near = both.where((apart <= F.col("na") + F.col("nb") - F.lit(2.0) * need) & (shared >= need))
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (shared / larger).alias("sim"))


def similar_pairs(sets: DataFrame, threshold: float, **cost) -> DataFrame:
    """(a, b, sim) with a < b: all pairs of sets(rep, words[, side]) that reach the threshold; words are distinct strings."""
    scratch = Scratch(sets.sparkSession)
    join = PrefixJoin(sets, threshold, scratch, **cost)
    pairs = lambda rows: join.salted(rows, rows, F.expr("x.rep < y.rep") & join.may_link()).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    found = join.verified(pairs(join.crowds()).distinct())
    keyed = scratch.save(join.first())
    for level in range(2, join.levels + 1):
        cold, hot, any_ = join.split(keyed)
        found = found.unionByName(join.expanded(join.group_pairs(cold)))
        if not any_:
            break
        if level == join.levels:
            return found.unionByName(join.verified(pairs(join.members(hot)).distinct())).distinct()
        found = found.unionByName(join.verified(pairs(join.members(hot.where(join.stays(level)))).distinct()))
        keyed = scratch.save(join.longer(hot, level))
    return found.distinct()
