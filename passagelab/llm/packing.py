"""Hierarchical multi-length packing of token ids into training windows.

A document is routed to the context size that holds it: of the tiers 2048, 1024, 512 and 256 the shortest that is long enough; of
a longer one whole windows of 2048 go first, and its rest is routed. Every tier packs windows of its own length: the tier's longest waiting piece opens one,
and its gap is filled by the waiting pieces that fit best, of its own tier and of shorter ones, and at last by a cut piece. A tier
gives windows whenever more than `most_waiting` of its pieces wait, so long windows find short pieces for their gaps, and short tiers still pack windows of their own.

Each task packs the documents of its own partition, so nothing is shuffled and memory is bounded by the waiting pieces. What is left
of a partition when its documents end is cut at the tiers' lengths, from long to short, so that less than the shortest is padded.

Sequences of one tier are dealt to step groups of `step_tokens` tokens each, so steps of all tiers are equal work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import map_batches, slices
from passagelab.llm.tokens import default_path, encoder

WINDOW, SHORTEST, END_ID = 2048, 256, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, padded_length int, step_group long"
Piece = tuple  # (doc_id, start, ids, doc_tokens)


def tiers(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """Context sizes from long to short: powers of two."""
    if window & (window - 1) or shortest & (shortest - 1) or not 0 < shortest <= window:
        raise ValueError("tiers are powers of two")
    return [window >> k for k in range((window // shortest).bit_length())]


class Packer:
    """Packs pieces into sequences; each of these is a list of pieces.

    waiting: of each tier (length, minus its turn, piece) in ascending order. A tier holds more than `most_waiting` pieces only while
    they and those of shorter tiers are together less than its window.
    """

    def __init__(self, window: int = WINDOW, shortest: int = SHORTEST, most_waiting: int = 256):
        self.window, self.sizes, self.most = window, tiers(window, shortest), most_waiting
        self.waiting: dict[int, list[tuple[int, int, Piece]]] = {size: [] for size in self.sizes}
        self.tokens = dict.fromkeys(self.sizes, 0)
        self.turn = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, at = len(ids), 0
        while n - at > self.window:
            yield [(doc_id, at, ids[at : at + self.window], n)]
            at += self.window
        self._wait((doc_id, at, ids[at:], n))
        for size in self.sizes:
            while len(self.waiting[size]) > self.most and self._enough(size):
                yield self._fill(size)

    def _enough(self, size: int) -> bool:
        return sum(n for s, n in self.tokens.items() if s <= size) >= size

    def _wait(self, piece: Piece) -> None:
        size = next(s for s in reversed(self.sizes) if len(piece[2]) <= s)
        self.turn += 1
        insort(self.waiting[size], (len(piece[2]), -self.turn, piece))
        self.tokens[size] += len(piece[2])

    def _take(self, size: int, k: int) -> Piece:
        n, _, piece = self.waiting[size].pop(k)
        self.tokens[size] -= n
        return piece

    def _fill(self, window: int) -> list[Piece]:
        """A full window of a tier: its longest waiting piece opens it, best fits of its and of shorter tiers fill it, a cut piece closes it."""
        own, gap, out = [s for s in self.sizes if s <= window], window, []
        while gap:
            for size in own:  # from long to short
                k = bisect_right(self.waiting[size], (gap, 1))
                if k:
                    piece = self._take(size, k - 1)
                    break
            else:
                size = next(s for s in reversed(own) if self.waiting[s])
                whole = self._take(size, 0)
                piece = (whole[0], whole[1], whole[2][:gap], whole[3])
                self._wait((whole[0], whole[1] + gap, whole[2][gap:], whole[3]))
            out.append(piece)
            gap -= len(piece[2])
        return out

    def finish(self) -> Iterator[list[Piece]]:
        for size in self.sizes:
            while self.waiting[size] and self._enough(size):
                yield self._fill(size)
        left = [p for size in self.sizes for _, _, p in self.waiting[size]]
        for size in self.sizes:
            while sum(len(p[2]) for p in left) >= size:
                taken, left = self._cut(left, size)
                yield taken
        if left:
            yield left

    @staticmethod
    def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
        out, rest = [], []
        for doc_id, start, ids, n in pieces:
            k = min(size, len(ids))
            if k:
                out.append((doc_id, start, ids[:k], n))
            if k < len(ids):
                rest.append((doc_id, start + k, ids[k:], n))
            size -= k
        return out, rest


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shortest: int = SHORTEST,
    end_id: int = END_ID,
    step_tokens: int = 16 * WINDOW,
) -> DataFrame:
    """One row for each piece: where it begins in its document and in its sequence, and its checksum.

    padded_length: the sequence's length if a power of two, else `window`. tier: the shortest tier
    that holds the sequence. step_group: sequences with one number have one tier and
    step_tokens / tier members (the last of a partition fewer), so each step has equal work.
    Null and empty texts are the end id alone. Rows that repeat an id are packed each by itself; null ids
    stay null. An empty table gives no rows; other columns are ignored.
    """
    path = tokenizer_path or default_path()
    sizes = tiers(window, shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, Packer(window, shortest)
        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        count, filled, rows = 0, {}, []

        def put(sequence: list[Piece]) -> None:
            nonlocal count
            length, offset = sum(len(p[2]) for p in sequence), 0
            tier = next((s for s in reversed(sizes) if length <= s), window)
            group, room = filled.get(tier, (None, 0))
            if not room:
                group, room = base + len(rows_groups), max(1, step_tokens // tier)
                rows_groups.append(tier)
            filled[tier] = (group, room - 1)
            padded = length if length & (length - 1) == 0 else window
            for doc_id, start, ids, n in sequence:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, base + count, offset, tier, padded, group))
                offset += len(ids)
            count += 1

        rows_groups: list[int] = []
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, texts in slices(batch, "text"):
                for k, encoded in enumerate(encode([t or "" for t in texts])):
                    for sequence in packer.add(ids[first + k], np.frombuffer(encoded + end, "<u4")):
                        put(sequence)
                if len(rows) > 10_000:
                    yield _batch(rows)
                    rows.clear()
        for sequence in packer.finish():
            put(sequence)
        if rows:
            yield _batch(rows)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(chosen, run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
