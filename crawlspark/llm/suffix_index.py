"""Repeated passages: a logarithmic family of sparse suffix arrays over the bytes of all texts.

Texts are read in chunks, the batches of the index. A chunk's suffix array is sparse: of every ``length``
bytes the place with the least hash of ``GRAM`` bytes is an anchor, so equal strings have the same one, and
neighbouring strings mostly share it. An entry is an anchor with the run of strings that share it: hash of its
gram, hash of all bytes of the run, place. Entries are dealt to buckets by the gram's hash; a bucket
takes the batches one after another. A new batch's sorted entries are merge-scanned against every level there is:
of entries with the same run the earliest stays, the others are whole repeats; entries that share a gram but not the
run are marked. Then the batch becomes a level, and levels of like size merge, so there is one
for each power of two.

Only at marked entries, the borders of repeated passages, can single strings repeat: their strings, hashed
one by one, are dealt out once more and the earliest of each stays. Runs and strings are told
apart by 128 bits of two polynomials. Repeats go back to their chunk, which is read again with them.

A chunk sends each run and each string once, its own repeats are settled inside it, so a passage copied
any number of times adds one entry a chunk. Texts pass no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.packed import Polynomial, batch, dealt, mixed, pack, read_by_key, unpack, write_by_key
from crawlspark.llm.scratch import Scratch

LENGTH = 100
#: Bytes whose least hash makes the anchor.
GRAM = 40
#: Text of a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Entries that a bucket is meant for.
BUCKET = 1 << 18
_SLICE = 1 << 19
_PLACE_BITS = np.uint64(21)
_SPAN = 4 * LENGTH
_random = np.random.default_rng(11)
_SYMBOLS = _random.integers(1 << 62, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNKS = "chunk long, bytes long, doc_ids binary, ties binary, sizes binary, data binary"
#: kind 0 is repeats, kind 1 entries, those of a chunk to one bucket
_ENTRIES = "bucket long, chunk long, kind int, entries binary"
_FOUND = "chunk long, kind int, marks binary"
_ENTRY_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_LAST = np.int64((1 << 63) - 1)
_HASHES: dict[int, tuple[Polynomial, Polynomial]] = {}


def _hashes(length: int) -> tuple[Polynomial, Polynomial]:
    if length not in _HASHES:
        _HASHES[length] = tuple(Polynomial(b, _SLICE + 4 * length) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
    return _HASHES[length]


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, bytes, doc_ids, ties, sizes, data): whole texts packed in the order they are read; nothing is shuffled.

    ``docs`` has doc_id, tie and data (binary).
    """
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            ids, ties, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            return batch(_CHUNKS, kinds, [((part << 32) | k, size, pack(values, known.astype(np.uint8)), pack(ties.to_numpy(zero_copy_only=False)), pack(sizes), pack(data))])

        for b in batches:
            sizes = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(sizes):
                room = np.cumsum(sizes[at:]) + size <= CHUNK_BYTES
                n = max(1 if not size else 0, int(room.sum()))
                if n:
                    held.append([c.slice(at, n) for c in b.columns])
                    size += int(sizes[at : at + n].sum())
                    at += n
                if at < len(sizes):
                    yield row()
                    k, held, size = k + 1, [], 0
        if held:
            yield row()

    return docs.select("doc_id", "tie", "data").mapInArrow(run, _CHUNKS)


class _Chunk:
    """A chunk's texts: bytes, sizes, and the order of its documents."""

    def __init__(self, number: int, doc_ids: bytes, ties: bytes, sizes: bytes, data: bytes):
        self.number = number
        self.ids, known = unpack(doc_ids)
        self.known = known.astype(bool)
        self.order_ids = np.where(self.known, self.ids, _LAST)
        (self.ties,), (self.sizes,), (self.data,) = unpack(ties), unpack(sizes), unpack(data)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort((np.arange(len(self.ids)), self.ties, self.order_ids))] = np.arange(len(self.ids))

    def slices(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first byte, strings that start in the slice, bytes) over the chunk."""
        for at in range(0, len(self.data) - length + 1, _SLICE):
            count = min(_SLICE, len(self.data) - length + 1 - at)
            yield at, count, self.data[at : at + count + length - 1]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, "right")


def _least(keys: np.ndarray, width: int, count: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of blocks meet."""
    rows = np.full(-(-len(keys) // width) * width, np.uint64((1 << 64) - 1))
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _runs(chunk: _Chunk, length: int) -> list[np.ndarray]:
    """(gram hash, run hash, first place, further strings) of the chunk's runs of strings with one anchor."""
    one, two = _hashes(length)
    gram = min(GRAM, length)
    out = []
    for at, count, data in chunk.slices(length):
        sums = one.prefixes(_SYMBOLS[0][data])
        grams = one.runs(sums, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))
        keys = mixed(grams)
        places = np.arange(len(keys), dtype=np.uint64)
        keys = (keys >> _PLACE_BITS << _PLACE_BITS) | places
        anchor = (_least(keys, length - gram + 1, count) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        start = np.arange(at, at + count)
        doc = chunk.document(start)
        inside = start + length <= chunk.ends[doc]
        new = np.ones(count, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(inside & new)  # strings of a document that fit are neighbours
        end = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        if not len(first):
            continue
        two_sums = two.prefixes(_SYMBOLS[1][data])
        found = mixed(two.runs(two_sums, first, end + length) + ((anchor[first] - first) * (2 * length) + end - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        # keys are least hashes, so mostly small: buckets need another one
        out.append((mixed(grams[anchor[first]] + np.uint64(1)), found, first + at, end - first))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2


def _settle_inside(chunk: _Chunk, keys: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with equal keys the earliest, and the others."""
    order = np.lexsort((place, chunk.rank[chunk.document(place)], *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order[new], order[~new]


def _send(chunk: _Chunk, keys: list[np.ndarray], place: np.ndarray, further: np.ndarray, buckets: int) -> Iterator[tuple]:
    """The chunk's earliest entries by bucket, and its own repeats, which only pass through a bucket."""
    kept, repeated = _settle_inside(chunk, keys, place)
    if len(repeated):
        repeated = repeated[np.argsort(place[repeated])]
        yield chunk.number % buckets, chunk.number, 0, pack(place[repeated].astype(np.uint32), further[repeated].astype(np.uint16))
    to = dealt(keys[0][kept], buckets).astype(np.int64)
    doc = chunk.document(place)
    for b in np.unique(to):
        mine = kept[to == b]
        yield int(b), chunk.number, 1, pack(*(k[mine] for k in keys), chunk.order_ids[doc[mine]], chunk.ties[doc[mine]], place[mine].astype(np.uint32), further[mine].astype(np.uint16))


def _entries_of(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chunk = _Chunk(*row)
                gram, whole, place, further = _runs(chunk, length)
                yield batch(_ENTRIES, _ENTRY_TYPES, list(_send(chunk, [gram, whole], place, further, buckets)))

    return run


#: Columns of an entry: keys, order (doc, tie, chunk, place), strings after the first, marked.
_FIELDS = ("gram", "whole", "doc", "tie", "chunk", "place", "further", "edge")


class Family:
    """The levels of one bucket: sorted runs of entries, at most one for each power of two."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []
        self.repeats: list[tuple[np.ndarray, ...]] = []

    def add(self, chunk: int, gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray, further: np.ndarray) -> None:
        """Scan a batch against itself and every level, then let it sink to the level of its size."""
        new = dict(zip(_FIELDS, (gram, whole, doc, tie, np.full(len(gram), chunk), place, further, np.zeros(len(gram), bool)), strict=True))
        new = _rows(new, np.argsort(gram, kind="stable"))
        new = self._scan([new])[0]
        for k, level in enumerate(self.levels):
            self.levels[k], new = self._scan([level, new])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]["gram"]) < 2 * len(self.levels[-1]["gram"]):
            both = _joined(self.levels[-2:])
            self.levels[-2:] = [_rows(both, np.argsort(both["gram"], kind="stable"))]

    def _scan(self, runs: list[dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
        """Merge-scan runs that are sorted by gram; of equal entries the earliest stays, marks pass to it."""
        if len(runs) == 2:
            small, large = sorted(runs, key=lambda r: len(r["gram"]))
            grams = small["gram"][_held(large["gram"], small["gram"])]
            met = [np.flatnonzero(_held(grams, r["gram"])) for r in runs]
        else:
            met = [np.arange(len(runs[0]["gram"]))]
        picked = _joined([_rows(r, m) for r, m in zip(runs, met, strict=True)])
        n = len(picked["gram"])
        if not n:
            return runs
        order = np.lexsort([picked[f] for f in ("place", "chunk", "tie", "doc", "whole", "gram")])
        sorted_ = _rows(picked, order)
        new_gram = np.append(True, sorted_["gram"][1:] != sorted_["gram"][:-1])
        new_run = new_gram | np.append(True, sorted_["whole"][1:] != sorted_["whole"][:-1])
        runs_of_gram = np.add.reduceat(new_run, np.flatnonzero(new_gram))
        at = np.flatnonzero(new_run)
        edge = np.logical_or.reduceat(sorted_["edge"], at) | (runs_of_gram > 1)[(np.cumsum(new_gram) - 1)[at]]
        picked["edge"][order[at]] = edge
        gone = np.ones(n, bool)
        gone[order[at]] = False
        self.repeats.append(tuple(picked[f][gone] for f in ("chunk", "place", "further")))
        out, lo = [], 0
        for r, m in zip(runs, met, strict=True):
            mine = slice(lo, lo + len(m))
            lo += len(m)
            edges, stay = r["edge"].copy(), np.ones(len(r["gram"]), bool)
            edges[m], stay[m] = picked["edge"][mine], ~gone[mine]
            out.append(_rows(r | {"edge": edges}, np.flatnonzero(stay)))
        return out


def _held(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` lie in the sorted ``values``."""
    if not len(values):
        return np.zeros(len(wanted), bool)
    return values[np.minimum(np.searchsorted(values, wanted), len(values) - 1)] == wanted


def _rows(run: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {f: run[f][at] for f in _FIELDS}


def _joined(runs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {f: np.concatenate([r[f] for r in runs]) for f in _FIELDS}


def _by_chunk(kind: int, chunk: np.ndarray, place: np.ndarray, further: np.ndarray) -> Iterator[tuple]:
    if not len(chunk):
        return
    order = np.lexsort((place, chunk))
    chunk, place, further = chunk[order], place[order], further[order]
    starts = np.flatnonzero(np.diff(chunk, prepend=chunk[:1] - 1))
    for lo, hi in zip(starts, [*starts[1:], len(chunk)], strict=True):
        yield int(chunk[lo]), kind, pack(place[lo:hi].astype(np.uint32), further[lo:hi].astype(np.uint16))


def _indexed(rows: pa.Table) -> pa.Table:
    """One bucket: its batches go through the family; repeats (kind 0) and marked entries (kind 1) by chunk."""
    family, out = Family(), []
    for number, kind, at in sorted(zip(rows.column("chunk").to_pylist(), rows.column("kind").to_pylist(), range(len(rows)), strict=True)):
        entries = rows.column("entries")[at].as_py()
        if kind:
            family.add(number, *unpack(entries))
        else:
            out.append((number, 0, entries))
    for repeats in family.repeats:
        out += _by_chunk(0, *repeats)
    for level in family.levels:
        out += _by_chunk(1, *(level[f][level["edge"]] for f in ("chunk", "place", "further")))
    return pa.Table.from_batches([batch(_FOUND, [pa.int64(), pa.int32(), pa.binary()], out)])


def _strings_of(buckets: int, length: int, path: str):
    """The single strings of each chunk's marked entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                marks = [unpack(m) for m in read_by_key(path, "chunk", row[0], "marks")]
                if not marks:
                    continue
                chunk = _Chunk(*row)
                place, further = (np.concatenate(x).astype(np.int64) for x in zip(*marks, strict=True))
                starts = np.unique(np.repeat(place, further + 1) + _upto(further + 1))
                yield batch(_ENTRIES, _ENTRY_TYPES, list(_send(chunk, _string_hashes(chunk, starts, length), starts, np.zeros(len(starts), np.int64), buckets)))

    return run


def _upto(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count n, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _string_hashes(chunk: _Chunk, starts: np.ndarray, length: int) -> list[np.ndarray]:
    out = [[], []]
    for at, count, data in chunk.slices(length):
        mine = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + count)] - at
        for k, hashing in enumerate(_hashes(length)):
            out[k].append(mixed(hashing.runs(hashing.prefixes(_SYMBOLS[k][data]), mine, mine + length)))
    return [np.concatenate(x) for x in out]


def _earliest(rows: pa.Table) -> pa.Table:
    """One bucket of strings: all but the earliest of equal ones, by chunk."""
    parts, out = [], []
    for _, number, kind, entries in zip(*(rows.column(c) for c in ("bucket", "chunk", "kind", "entries")), strict=True):
        if kind.as_py():
            one, two, doc, tie, place, further = unpack(entries.as_py())
            parts.append((one, two, doc, tie, np.full(len(one), number.as_py()), place, further))
        else:
            out.append((number.as_py(), 0, entries.as_py()))
    if not parts:
        return pa.Table.from_batches([batch(_FOUND, [pa.int64(), pa.int32(), pa.binary()], out)])
    one, two, doc, tie, number, place, further = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, number, tie, doc, two, one))
    again = np.zeros(len(order), bool)
    again[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    gone = order[again]
    out += _by_chunk(0, number[gone], place[gone], further[gone])
    return pa.Table.from_batches([batch(_FOUND, [pa.int64(), pa.int32(), pa.binary()], out)])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>, kept binary"


def _cut_out(path: str, length: int, texts: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string(), spans_type, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chunk = _Chunk(*row)
                steps = np.zeros(len(chunk.data) + 1, np.int32)
                for marks in read_by_key(path, "chunk", row[0], "marks"):
                    place, further = (x.astype(np.int64) for x in unpack(marks))
                    np.add.at(steps, place, 1)
                    np.add.at(steps, place + further + length, -1)
                gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
                out, size = [], 0
                for doc, (lo, hi) in enumerate(zip(chunk.starts, chunk.ends, strict=True)):
                    cover, data = gone[lo:hi], chunk.data[lo:hi]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                    kept = data[~cover].tobytes() if len(turns) else data.tobytes()
                    spans = [{"start": int(s), "length": int(e - s)} for s, e in turns.reshape(-1, 2)]
                    doc_id = int(chunk.ids[doc]) if chunk.known[doc] else None
                    out.append((doc_id, int(hi - lo), int(hi - lo) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if texts else None))
                    size += len(kept) if texts else 0
                    if len(out) >= 10_000 or size > 8 << 20:
                        yield batch(_RESULT.replace("start:long,length:long", ""), kinds, out)
                        out, size = [], 0
                if out:
                    yield batch(_RESULT.replace("start:long,length:long", ""), kinds, out)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every document.

    A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document of
    smaller doc_id, or earlier in its own; strings are those of the input and never cross documents.
    ``spans`` are the maximal runs removed, ``kept`` the other bytes (null unless ``texts``). Defined
    results: null and empty texts have no bytes; null doc_ids come last; rows that share a doc_id are
    documents in the order of their texts' hashes, so all but one of equal rows go; texts shorter
    than ``length`` stay; an empty table gives no rows. Only doc_id and text are read.
    """
    if not 2 <= length <= 1 << 12:
        raise ValueError("length must be from 2 to 4096")
    scratch = Scratch(docs.sparkSession, "suffixes")
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Only rows that share their doc_id need another order, and 8 bytes an entry for it.
    shared = docs.groupBy(doc_id.alias("doc_id")).count().where("count > 1").limit(1).count() > 0
    tie = F.xxhash64(text) if shared else F.lit(0).cast("long")
    cut = scratch.table("chunks", chunks(docs.select(doc_id.alias("doc_id"), tie.alias("tie"), text.cast("binary").alias("data"))))
    read = cut.select("chunk", "doc_ids", "ties", "sizes", "data")
    total = cut.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-2 * total // ((length - min(GRAM, length) + 1) * BUCKET)))
    entries = read.mapInArrow(_entries_of(buckets, length), _ENTRIES).repartition(buckets, "bucket")
    found = scratch.table("found", entries.groupBy("bucket").applyInArrow(_indexed, _FOUND))
    write_by_key(found.where("kind = 1").select("chunk", "marks"), "chunk", scratch.path("edges"))
    strings = read.mapInArrow(_strings_of(buckets, length, scratch.path("edges")), _ENTRIES).repartition(buckets, "bucket")
    again = strings.groupBy("bucket").applyInArrow(_earliest, _FOUND)
    write_by_key(found.where("kind = 0").union(again).select("chunk", "marks"), "chunk", scratch.path("marks"))
    scratch.drop("found", "edges")
    return read.mapInArrow(_cut_out(scratch.path("marks"), length, texts), _RESULT)
