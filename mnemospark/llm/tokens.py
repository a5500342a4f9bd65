"""Encoding with a public byte-level BPE vocabulary, exact and in linear time.

Texts are cut into pieces by the vocabulary's public pattern. A piece's bytes are read as Latin-1
so that an Aho-Corasick automaton over all tokens gives the longest token at each position. The
encoder takes the longest token, checks that it may stand beside the one before (that the
merges would not have joined across the seam), and goes back to shorter tokens where it may not.
Seams are remembered, dead positions are marked, so no position is tried twice. Encoded pieces
are remembered too, within a bound on memory that changes nothing in the result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES, KEPT_SEAMS, KEPT_CHARS = 200_000, 500_000, 64


class Encoder:
    """Ids are ranks: a lower id was merged earlier."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pieces_of = regex.compile(pattern).findall
        self.text = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.text[rank] = token
        self.length = [len(t) for t in self.text]
        self.longest = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.ranks = ranks
        self.shorter = [self._prefix(t) for t in self.text]
        self.left, self.right, self.joined = list(range(len(self.text))), list(range(len(self.text))), {}
        for rank in range(len(self.text)):
            if self.length[rank] > 1:
                self._split(rank)
        self.seams: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def _prefix(self, token: bytes) -> int:
        """The longest proper prefix that is a token, or -1."""
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return -1

    def _split(self, rank: int) -> None:
        """Find the two tokens whose merge made this one; tokens come in order of rank."""
        token = self.text[rank]
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank and (a, b) not in self.joined and self._may_meet(a, b):
                self.left[rank], self.right[rank] = a, b
                self.joined[a, b] = rank
                return

    def _may_meet(self, a: int, b: int) -> bool:
        """False if some merge across the seam would come before those inside a or b."""
        limit = 1 << 60
        while True:
            met = self.joined.get((a, b))
            if met is not None and met < limit:
                return False
            for own in (True, False) if a > b else (False, True):  # the later merge is undone first
                if own:
                    limit, a = a, self.right[a]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.left[b]
                    if b + 1 != limit:
                        break
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        fits = self.seams.get(key)
        if fits is None:
            if len(self.seams) >= KEPT_SEAMS:
                self.seams.clear()
            fits = self.seams[key] = self._may_meet(a, b)
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        size, length = len(raw), self.length
        best = [0] * size
        for end, rank in self.longest.iter(raw.decode("latin-1")):
            best[end + 1 - length[rank]] = rank  # later ends are longer
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, best[0]
        while at < size:
            end = at + length[token]
            if not dead[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = end
                if at < size:
                    token = best[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.pieces_of(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= KEPT_CHARS:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

class Kept:
    """A vocabulary whose automaton is built once for each Python worker, not for each task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.made = ranks, None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "made": None}

    def encoder(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(self.ranks)
        return self.made


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids): the ids of each text without special tokens, whose strings are ordinary text.

    Empty and null texts give an empty list; repeated rows are encoded each; a text of any length is
    encoded whole. `vocabulary` is the path of a rank file on the driver (under 2 MB); its
    content is broadcast. One scan, no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Kept(read_ranks(vocabulary)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start in range(0, len(texts), 2000):
                lists = [encoder.encode(t) if t else [] for t in texts[start : start + 2000]]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(lists)), ids], [id_col, "ids"])

    return docs.select(id_col, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
