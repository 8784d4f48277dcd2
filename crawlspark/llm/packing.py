"""Packing token streams into sequences by dynamic programming over cuts, in the documents' order.

A sequence is a window of at most 2048 ids of the concatenated stream. Windows may end at document
boundaries, at sentence boundaries for a small penalty, or inside a sentence for a large one. The
cheapest chain of windows, padding plus penalties, follows from f(j) = min over cuts i at most 2048
back of f(i) + pos(i), plus terms of j alone, so a monotone queue gives each minimum in amortised
constant time. A sequence whose length is a power of two needs no padding.

Every task packs the rows of its own split in their order and streams: it holds a few hundred
windows, writes those that are settled, and carries the rest. No row crosses a shuffle, and no
order is needed between splits.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.tokens import sentence_marks, token_ids

LENGTH = 2048
SENTENCE_PENALTY = 8
HARD_PENALTY = 256
#: Windows that a task holds before it writes those that are settled.
HELD = 256
#: Places for cuts inside a sentence longer than a sequence.
_STEP = 64

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    """A run of one document's ids in a sequence."""

    doc_id: int | None
    start: int
    length: int
    ids_crc32: int
    doc_tokens: int
    offset: int


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, length: int, vocabulary: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and their penalties. ``ends``: document ends in the stream."""
    closing, opening = sentence_marks(vocabulary)
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[1:-1][closing[ids[:-1]] & opening[ids[1:]]] = SENTENCE_PENALTY
    penalty[ends] = 0
    penalty[[0, -1]] = 0
    places = np.flatnonzero(penalty >= 0)
    for k in np.flatnonzero(np.diff(places) > length):
        inner = np.arange(places[k] + _STEP, places[k + 1], _STEP)
        penalty[inner] = HARD_PENALTY
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Positions of the cheapest chain of cuts from the first place to the last, both included.

    Neighbouring places are at most ``length`` apart.
    """
    position, penalty = places.tolist(), penalties.tolist()
    powers = [p for p in (length >> 1, length >> 2, length >> 3) if p and p & (p - 1) == 0]
    exact = length & (length - 1) == 0
    index = {p: k for k, p in enumerate(position)}
    cost, back = [0], [0]
    queue: deque[tuple[int, int]] = deque([(position[0], 0)])  # (f + pos, index), rising
    for j in range(1, len(position)):
        here = position[j]
        while here - position[queue[0][1]] > length:
            queue.popleft()
        least, i = queue[0]
        best = least + length - here
        for power in powers if exact else ():
            k = index.get(here - power)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalty[j]
        cost.append(best)
        back.append(i)
        value = best + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(position) - 1
    while j:
        cuts.append(position[j])
        j = back[j]
    cuts.append(position[0])
    return cuts[::-1]


def _tail(low: int, high: int, length: int) -> list[int]:
    """Ends of the last windows of a split: powers of two if their cuts cost less than the padding."""
    n = high - low
    if length & (length - 1) or (bin(n).count("1") - 1) * HARD_PENALTY // 4 >= length - n:
        return [high]
    out = []
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            low += 1 << bit
            out.append(low)
    return out


def windows(docs: Iterator[tuple[int | None, str | None]], length: int = LENGTH, vocabulary: str | None = None) -> Iterator[tuple[list[Piece], np.ndarray]]:
    """The sequences of a stream of documents, in order: their pieces and their ids."""
    held: list[tuple[int | None, int, np.ndarray]] = []  # document, ids of it already written, the rest
    waiting = 0

    def pack(last: bool) -> Iterator[tuple[list[Piece], np.ndarray]]:
        nonlocal held, waiting
        ids = np.concatenate([part for _, _, part in held])
        ends = np.cumsum([len(part) for _, _, part in held])
        cuts = best_cuts(*candidate_cuts(ids, ends, length, vocabulary), length)
        if last:
            cuts[-1:] = _tail(cuts[-2], cuts[-1], length)
        else:
            cuts.pop()  # the last window may still grow
        k, begin = 0, 0  # document at the start of the window, its first position in the stream
        for low, high in zip(cuts, cuts[1:], strict=False):
            pieces, at = [], low
            while at < high:
                doc, written, part = held[k]
                stop = min(high, begin + len(part))
                pieces.append(Piece(doc, written + at - begin, stop - at, zlib.crc32(part[at - begin : stop - begin].tobytes()), written + len(part), at - low))
                at = stop
                if at == begin + len(part):
                    begin += len(part)
                    k += 1
            yield pieces, ids[low:high]
        rest = cuts[-1]
        held = held[k:]
        if held and rest > begin:
            doc, written, part = held[0]
            held[0] = (doc, written + rest - begin, part[rest - begin :])
        waiting = len(ids) - rest

    for doc, text in docs:
        ids = token_ids(text, vocabulary)
        held.append((doc, 0, ids))
        waiting += len(ids)
        if waiting >= HELD * length:
            yield from pack(False)
    if held:
        yield from pack(True)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """(doc_id, text) of Arrow batches."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), map(pa.StringScalar.as_py, batch.column(1)), strict=True)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    Defined results: a null or empty text is the closing id alone; a text without sentence ends is
    cut inside; a null doc_id and rows that repeat a doc_id are packed as they come; an empty table
    gives no rows. Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        for n, (pieces, ids) in enumerate(windows(rows(batches), length, vocabulary)):
            for p in pieces:
                part = (ids[p.offset : p.offset + p.length].astype(np.int32),) if with_ids else ()
                out.append((*p[:5], base + n, p.offset, *part))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = _PIECES + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
