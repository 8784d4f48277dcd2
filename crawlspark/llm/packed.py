"""Arrays packed into one binary cell, and tables whose rows a task looks up by key in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte in planes, so that sorted or repeated ones take little room."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str} {len(a)}".encode()
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
        parts += [len(head).to_bytes(1), head, planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(data):
        size = data[at]
        kind, n = data[at + 1 : at + 1 + size].decode().split()
        at += 1 + size
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def batch(names: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a record batch; ``names`` as in a schema text."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in names.split(", ")])


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """Write rows so that a task finds those of one key, a long, without reading others: a folder per key."""
    df.repartition(key).write.partitionBy(key).parquet(path)


def read_by_key(path: str, key: str, value: int, column: str) -> Iterator[bytes]:
    """The cells of one column in the rows of a key."""
    store, inner = fs.FileSystem.from_uri(path)
    for found in store.get_file_info(fs.FileSelector(f"{inner}/{key}={value}", allow_not_found=True)):
        if found.base_name.endswith(".parquet") and not found.base_name.startswith(("_", ".")):
            with store.open_input_file(found.path) as source:
                yield from pq.read_table(source, columns=[column]).column(0).to_pylist()


class Polynomial:
    """Rabin-Karp hashes modulo 2^64 of any run of symbols from prefix sums; sequences are worked on in slices."""

    def __init__(self, base: int, longest: int):
        inverse = pow(base, -1, 1 << 64)
        self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, b, np.uint64)])) for b in (base, inverse))

    def prefixes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.inverses[: len(symbols)], out=out[1:])
        return out

    def runs(self, prefixes: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Hashes of the symbols from start to end (exclusive); equal runs have equal hashes wherever they stand."""
        return (prefixes[end] - prefixes[start]) * self.powers[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def dealt(x: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes to 0..buckets-1 by their upper half."""
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
