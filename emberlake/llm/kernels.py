"""Vectorised byte kernels on Arrow batches of texts."""
from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ROOT, ROOT_2 = 0x9E3779B97F4A7C15, 0xC6BC279692B5C323
LONG_WORD = 512
TRIM_THRESHOLD, MMAP_THRESHOLD = -1, -3  # of the C library's mallopt


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


TABLE = 1 << 22  # powers that a worker keeps; longer tables are made when they are asked for
_tables: dict[int, np.ndarray] = {}


def _powers_of(root: int, n: int) -> np.ndarray:
    found = _tables.get(root)
    if found is None or len(found) < n:
        found = np.full(1 << max(10, (n - 1).bit_length()) if n else 1, root, U)
        found[0] = 1
        found = np.cumprod(found, dtype=U)
        if len(found) <= TABLE:
            _tables[root] = found
    return found[:n]


def powers(n: int, root: int = ROOT) -> np.ndarray:
    """root ** 0..n-1 modulo 2 ** 64."""
    return _powers_of(root, n)


def inverses(n: int, root: int = ROOT) -> np.ndarray:
    """root ** 0..-(n-1) modulo 2 ** 64."""
    return _powers_of(pow(root, -1, 1 << 64), n)


def lean(f):
    """f, a function on batches, as a task that gives back the memory it has used: large arrays are mapped and unmapped, and free pages go when the task ends."""

    @wraps(f)
    def run(batches, *args, **options):
        trim = _returning()
        try:
            yield from f(batches, *args, **options)
        finally:
            trim(0)

    return run


def _returning():
    """Lets the C library give freed memory back, and returns its malloc_trim (nothing, where it has none)."""
    libc = ctypes.CDLL(None)
    if mallopt := getattr(libc, "mallopt", None):
        mallopt(MMAP_THRESHOLD, 1 << 20)
        mallopt(TRIM_THRESHOLD, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())
    return getattr(libc, "malloc_trim", lambda _: None)


def chunks(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows of about `most` bytes; null texts count as empty. A longer text is a run of its own."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind, dtype = pa.binary(), np.int32
    else:
        kind, dtype = pa.large_binary(), np.int64
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(kind)
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield at, to - at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray, root: int = ROOT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text index and 64-bit hash of each word, A-Z lower-cased. Words are runs of bytes other than 0x20 and 0x09-0x0D.

    Hashes are polynomials of the bytes, mixed; another root gives independent ones. Words of over LONG_WORD
    bytes are hashed by BLAKE2b, as there are known strings that collide in polynomials modulo 2 ** 64.
    """
    n = len(data)
    z = np.zeros(0, np.int64)
    if not n:
        return z, z, z, np.zeros(0, U)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    del first, last, cut, inside
    if not len(starts):
        return z, z, z, np.zeros(0, U)
    lower = LOWER[data]
    value = lower.astype(U)
    value += U(1)
    value *= powers(n, root)
    sums = np.zeros(n + 1, U)
    np.cumsum(value, out=sums[1:])
    del value
    lengths = ends - starts
    hashed = (sums[ends] - sums[starts]) * inverses(n, root)[starts]
    hashed = mix(hashed ^ (lengths.astype(U) * U(0xD6E8FEB86659FD93)))
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        digest = hashlib.blake2b(lower[starts[k] : ends[k]].tobytes(), digest_size=8, salt=(root % 2**64).to_bytes(8, "little"))
        hashed[k] = int.from_bytes(digest.digest(), "little")
    doc = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, doc, hashed


def dealt(p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by slice, and where each slice begins in it (n + 1 bounds)."""
    order = np.argsort(p.astype(np.uint16) if n <= 65536 else p, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(p, minlength=n))])


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of long integers; null ids become the smallest long."""
    return pc.fill_null(column_of(batch, name).cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value, each with its length and type."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [np.array([len(a)], "<i8").tobytes(), a.dtype.str.ljust(8).encode(), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        n = int(np.frombuffer(blob, "<i8", 1, at)[0])
        kind = np.dtype(bytes(blob[at + 8 : at + 16]).decode().strip())
        out.append(np.frombuffer(blob, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def squeezed(blob: bytes) -> bytes:
    """A packed value, compressed: text shrinks to less than half."""
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def unsqueezed(blob) -> bytes:
    blob = memoryview(blob)
    return pa.decompress(pa.py_buffer(blob[8:]), int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Bounds of equal runs: starts, then the length."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def grouped(f, **options):
    """f with its options set, with the type hints that applyInArrow looks for."""

    def run(table: pa.Table) -> pa.Table:
        _returning()
        return f(table, **options)

    return run
