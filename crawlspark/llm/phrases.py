"""Phrase collocations: Rabin-Karp fingerprints of all n-grams, texts of the frequent ones only.

Texts are cut into blocks of word numbers once. Prefix polynomials over the hashes of a block's
words give the fingerprint of every n-gram, language and length mixed in. A fingerprint falls into
one of eight times as many cells as there are n-grams; a block sends each cell it has once, with
its count, packed by ranges of cells. A range adds the counts of all blocks: what lies in a cell below
the threshold can't be frequent, so only the other cells go back to the blocks they came from (the
pointers). There all occurrences in such cells are grouped by fingerprint, compared word by word with
the first of their group, and only those texts are materialised, packed by ranges again and counted
by text. So collisions cost work and never change a count.

Ranges are as many as the words ask for, each of the same size; a hot phrase adds one cell a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.packed import Polynomial, batch, dealt, mixed, pack, read_by_key, unpack, write_by_key
from crawlspark.llm.scratch import Scratch
from crawlspark.operators.keyed import top_k_per_key

MOST_WORDS = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Text of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Cells of a range, as a power of two, and n-grams it is meant for.
RANGE_BITS = 25
RANGE_GRAMS = 1 << 22
#: Phrases a task adds up before it sends them.
_HELD = 150_000
#: Words hashed at once.
_SLICE = 1 << 19
_WORDS = Polynomial(0x9E3779B97F4A7C15, _SLICE + MOST_WORDS)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_BLOCKS = "block long, words long, langs array<string>, lang_words array<long>, vocabulary binary, tokens binary"
_CELLS = "bucket long, block long, cells binary"
_COUNTED = "lang string, words int, phrase string, n long"
_SENT = "bucket long, langs array<string>, counts binary, texts binary"


def _cut(texts: pa.Array, langs: list[str]) -> tuple | None:
    """Word numbers of the texts, each with the piece it stands in and its language's number."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = texts.buffers()[2]
    data = bytes(flat)[offsets[0] : offsets[-1]].translate(_LOWER) if flat else b""
    lowered = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])
    split = pc.split_pattern(pc.replace_substring(lowered, b"\n", b" \n "), pattern=b" ")
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    kind = np.array([1 if w == b"\n" else 0 if w == b"" else 2 for w in words] or [0])[codes]
    piece = np.cumsum(kind == 1) + doc  # ends of lines and texts both begin a new one
    real = kind == 2
    if not real.any():
        return None
    used, tokens = np.unique(codes[real], return_inverse=True)
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs])[doc[real]]
    return [words[i] for i in used], tokens, piece[real], names, lang


def blocks(docs: DataFrame) -> DataFrame:
    """(block, words, langs, lang_words, vocabulary, tokens): texts as packed word numbers, read once, not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(group)], strict=True):
                got = _cut(b.column(1).slice(lo, hi - lo), b.column(0).slice(lo, hi - lo).to_pylist())
                if got is None:
                    continue
                words, tokens, piece, names, lang = got
                border = np.diff(piece, prepend=-1) > 0
                row = ((part << 32) | k, len(tokens), names, np.bincount(lang, minlength=len(names)).tolist(), pack(np.frombuffer(b"\n".join(words), np.uint8)), pack(tokens.astype(np.uint32), border.astype(np.uint8), lang.astype(np.uint32)))
                k += 1
                yield batch(_BLOCKS, [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()], [row])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, _BLOCKS)


class _Block:
    """A block's words, and the fingerprints of its n-grams slice by slice."""

    def __init__(self, langs: list[str], vocabulary: bytes, tokens: bytes):
        self.langs = langs
        self.words = unpack(vocabulary)[0].tobytes().split(b"\n")
        self.tokens, border, self.lang = unpack(tokens)
        self.piece = np.cumsum(border)
        self.hashes = mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64))
        self.lang_hashes = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in langs], np.uint64)

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first places, fingerprints) of all n-grams inside pieces, up to ``most`` words."""
        for at in range(0, len(self.tokens), _SLICE):
            end = min(at + _SLICE + most - 1, len(self.tokens))
            sums = _WORDS.prefixes(self.hashes[self.tokens[at:end]])
            for n in range(1, most + 1):
                count = min(_SLICE, end - at - n + 1)
                if count <= 0:
                    continue
                found = _WORDS.runs(sums, slice(0, count), slice(n, n + count))
                found = mixed(found + self.lang_hashes[self.lang[at : at + count]] * np.uint64(2 * n + 1))
                inside = np.flatnonzero(self.piece[at : at + count] == self.piece[at + n - 1 : at + n - 1 + count])
                yield n, inside + at, found[inside]


def _cell(fingerprints: np.ndarray, buckets: int) -> np.ndarray:
    return (dealt(fingerprints, buckets) << np.uint64(RANGE_BITS)) | (fingerprints & np.uint64((1 << RANGE_BITS) - 1))


def _cells_of(buckets: int, most: int, least: int):
    """Each block's cells with their counts (no more than ``least``), packed by range."""
    low = (1 << RANGE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, langs, vocabulary, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grams = _Block(langs, vocabulary, tokens).grams(most)
                cells, n = np.unique(np.concatenate([_cell(f, buckets) for _, _, f in grams]), return_counts=True)
                n = np.minimum(n, least).astype(np.uint8 if least < 256 else np.int64)
                bucket = (cells >> np.uint64(RANGE_BITS)).astype(np.int64)
                steps = np.diff((cells & np.uint64(low)).astype(np.int64), prepend=0).astype(np.int32)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                steps[starts] = (cells[starts] & np.uint64(low)).astype(np.int32)
                rows = [(int(bucket[lo]), block, pack(steps[lo:hi], n[lo:hi])) for lo, hi in zip(starts, [*starts[1:], len(bucket)], strict=True)]
                yield batch(_CELLS, [pa.int64(), pa.int64(), pa.binary()], rows)

    return run


def _frequent_cells(least: int):
    """Of one range: each block's cells whose counts over all blocks reach ``least``."""

    def run(rows: pa.Table) -> pa.Table:
        counts, out = np.zeros(1 << RANGE_BITS, np.uint8 if least < 128 else np.int64), []
        for cells in rows.column("cells"):
            steps, n = unpack(cells.as_py())
            at = np.cumsum(steps)
            counts[at] = np.minimum(counts[at] + n, least)  # more than enough counts as enough
        enough = counts >= least
        for bucket, block, cells in zip(*(rows.column(c).to_pylist() for c in ("bucket", "block", "cells")), strict=True):
            at = np.cumsum(unpack(cells)[0])
            at = at[enough[at]]
            if len(at):
                out.append((bucket, block, pack((at + (bucket << RANGE_BITS)).astype(np.uint64))))
        return pa.Table.from_batches([batch(_CELLS, [pa.int64(), pa.int64(), pa.binary()], out)])

    return run


def _texts_of(buckets: int, most: int, path: str):
    """Each block's n-grams in frequent cells, by text, with their counts in the block."""

    def grouped(block: _Block, n: int, places: np.ndarray, fingerprints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        order = np.argsort(fingerprints, kind="stable")
        places, fingerprints = places[order], fingerprints[order]
        starts = np.flatnonzero(np.diff(fingerprints, prepend=fingerprints[0] ^ np.uint64(1)))
        sizes = np.diff([*starts, len(places)])
        first = np.repeat(places[starts], sizes)
        same = block.lang[places] == block.lang[first]
        for j in range(n):
            same &= block.tokens[places + j] == block.tokens[first + j]
        alike = np.add.reduceat(same, starts) == sizes
        prints = fingerprints[starts]
        yield from zip(places[starts][alike].tolist(), sizes[alike].tolist(), prints[alike].tolist(), strict=True)
        for lo, size, f in zip(starts[~alike], sizes[~alike], prints[~alike].tolist(), strict=True):  # different texts with one fingerprint
            rows = np.stack([block.lang[places[lo : lo + size]], *(block.tokens[places[lo : lo + size] + j] for j in range(n))], 1)
            _, at, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
            yield from ((i, c, f) for i, c in zip(places[lo + at].tolist(), count.tolist(), strict=True))

    def sent(held: dict[tuple, int]) -> pa.RecordBatch:
        by_bucket: dict[int, list] = {}
        for (bucket, lang, n, phrase), count in held.items():
            by_bucket.setdefault(bucket, []).append((lang, n, phrase, count))
        rows = []
        for bucket, found in sorted(by_bucket.items()):
            lang, n, phrase, count = zip(*sorted(found), strict=True)
            names, lang = np.unique(np.array(lang, object), return_inverse=True)
            texts = np.frombuffer(b"\n".join(phrase), np.uint8)
            rows.append((bucket, names.tolist(), pack(lang.astype(np.uint32), np.array(n, np.uint8), np.array(count, np.int64)), pack(texts)))
        return batch(_SENT, [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for b in batches:
            for number, langs, vocabulary, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wanted = [unpack(c)[0] for c in read_by_key(path, "block", number, "cells")]
                if not wanted:
                    continue
                wanted, block = np.sort(np.concatenate(wanted)), _Block(langs, vocabulary, tokens)
                hits: dict[int, list] = {}
                for n, places, fingerprints in block.grams(most):
                    cells = _cell(fingerprints, buckets)
                    hit = wanted[np.minimum(np.searchsorted(wanted, cells), len(wanted) - 1)] == cells
                    hits.setdefault(n, []).append((places[hit], fingerprints[hit]))
                for n, parts in hits.items():
                    places, fingerprints = (np.concatenate(x) for x in zip(*parts, strict=True))
                    if not len(places):
                        continue
                    for i, count, f in grouped(block, n, places, fingerprints):
                        key = f * buckets >> 64, langs[block.lang[i]], n, b" ".join([block.words[t] for t in block.tokens[i : i + n]])
                        held[key] = held.get(key, 0) + count
                if len(held) >= _HELD:
                    yield sent(held)
                    held = {}
        if held:
            yield sent(held)

    return run


def _counted(least: int):
    """Of one range: phrases that occur ``least`` times, by text."""

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for langs, counts, texts in zip(*(rows.column(c) for c in ("langs", "counts", "texts")), strict=True):
            lang, n, count = unpack(counts.as_py())
            phrase = pa.array(unpack(texts.as_py())[0].tobytes().split(b"\n"), pa.binary())
            parts.append(pa.table([pa.array(langs.as_py(), pa.string()).take(pa.array(lang)), pa.array(n, pa.int32()), phrase, pa.array(count)], names=["lang", "words", "phrase", "n"]))
        out = pa.concat_tables(parts).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
        out = out.filter(pc.greater_equal(out.column("n_sum"), least))
        return pa.table([out.column("lang"), out.column("words"), out.column("phrase").cast(pa.string()), out.column("n_sum")], names=["lang", "words", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, scratch: Scratch, most: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of every phrase of up to ``most`` words that occurs ``least`` times, and (lang, n) of all words."""
    cut = scratch.table("blocks", blocks(docs))
    total = cut.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-total * most // RANGE_GRAMS))
    read = cut.select("block", "langs", "vocabulary", "tokens")
    cells = read.mapInArrow(_cells_of(buckets, most, least), _CELLS)
    write_by_key(cells.groupBy("bucket").applyInArrow(_frequent_cells(least), _CELLS).select("block", "cells"), "block", scratch.path("cells"))
    texts = read.mapInArrow(_texts_of(buckets, most, scratch.path("cells")), _SENT)
    counted = texts.groupBy("bucket").applyInArrow(_counted(least), _COUNTED)
    per = cut.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    return scratch.table("frequent", counted), per


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases whose parts attract each other most.

    Words are counted per language inside pieces between ``.,;:!?`` and line ends, A-Z lower-cased. A
    phrase of 2 to ``most`` words with a >= ``least`` occurrences scores floor(1000 a n / (l r)) at its weakest
    cut, the earliest at ties; one that always stands inside a longer candidate is dropped. Arithmetic is of 38 digits.
    Defined results: a null lang is ``und``, one with that name; null and empty texts have no words;
    rows that repeat count each; an empty table gives no rows. Ties go by a, then by the phrase's bytes. Only
    lang and text are read.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    frequent, per = frequent_phrases(docs, scratch, most, least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = frequent.where("words >= 2")
    # each part of a longer candidate by one word; longer ones still hold one of those with the same count
    outer = candidates.where("words > 2").withColumnRenamed("n", "of")
    head = F.expr("substring_index(phrase, ' ', words - 1)")
    tail = F.substr("phrase", F.char_length(F.substring_index("phrase", " ", 1)) + 2)
    held = outer.select(F.col("lang").alias("hl"), F.col("of").alias("hn"), F.explode(F.array(head, tail)).alias("hp")).distinct()
    kept = candidates.join(held, (F.col("lang") == F.col("hl")) & (F.col("phrase") == F.col("hp")) & (F.col("n") == F.col("hn")), "left_anti")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.substr("phrase", F.char_length("first") + 2))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(per, "lang")
    score = F.expr("CAST(1000 AS DECIMAL(4,0))") * wide("a") * wide("n")
    cuts = cuts.withColumn("score", F.floor((score - score % (wide("l") * wide("r"))) / (wide("l") * wide("r"))).cast("long"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_k_per_key(weakest, ["lang"], order, top, "rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
