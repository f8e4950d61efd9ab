"""Byte-level BPE: a segment tree over byte positions holds the leftmost pair of lowest rank."""
from __future__ import annotations

import base64
import hashlib
from array import array
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, lean

NONE = np.int64(1) << 40  # no pair
LONG = 256  # pieces of this many bytes are merged one by one, shorter ones side by side
CACHE_PIECES, CACHE_BYTES = 100_000, 16 << 20  # of pieces that a task remembers


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.text = [str(k) for k in range(len(self.bytes))]
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        # two neighbours merge if their bytes together are a token, however that token was made
        pairs = {(ranks[t[:i]] << 20) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it is no token or an end is missing (-1)."""
        key = (a << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.pair_ranks[at], NONE)

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Pieces of up to `width` bytes (a power of two), a segment tree for each, all trees in one array."""
        n, bits = len(pieces), width.bit_length() - 1
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < lengths[:, None], self.single[raw], -1)
        after = np.tile(place + 1, (n, 1))  # width: none
        before = np.tile(place - 1, (n, 1))  # -1: none
        tree = np.full((n, 2 * width), NONE << bits, np.int64)
        tree[:, width : 2 * width - 1] = (self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) << bits) | place[:-1]
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(rows, at, key):
            node = at + width
            tree[rows, node] = key
            while True:
                node = node >> 1
                if not node[0]:
                    break
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(n)
        while True:
            top = tree[rows, 1]
            live = (top >> bits) < NONE
            rows, top = rows[live], top[live]
            if not len(rows):
                break
            i = top & (width - 1)
            j = after[rows, i]
            ids[rows, i] = top >> bits
            ids[rows, j] = -1
            k = after[rows, j]
            after[rows, i] = k
            has = k < width
            before[rows[has], k[has]] = i[has]
            put(rows, j, np.full(len(rows), NONE << bits))
            right = np.where(has, ids[rows, np.minimum(k, width - 1)], -1)
            put(rows, i, (self.rank(ids[rows, i], right) << bits) | i)
            h = before[rows, i]
            some = h >= 0
            if some.any():
                r, h = rows[some], h[some]
                put(r, h, (self.rank(ids[r, h], ids[r, i[some]]) << bits) | h)
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _alone(self, piece: bytes) -> tuple[int, ...]:
        """One long piece: the same tree in arrays of whole numbers (rank and place in one), n log n for n bytes, about 40 bytes a byte."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        raw = self.single[np.frombuffer(piece, np.uint8)]
        ids, after, before = array("i", raw.astype(np.int32).tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        leaves = np.full(2 * width, none, np.int64)
        ranks = self.rank(raw[:-1], raw[1:])
        leaves[width : width + n - 1] = np.where(ranks < NONE, (ranks << 40) | np.arange(n - 1), none)
        size = width
        while size > 1:
            leaves[size // 2 : size] = np.minimum(leaves[size : 2 * size : 2], leaves[size + 1 : 2 * size : 2])
            size //= 2
        tree = array("q", leaves.tobytes())
        del raw, leaves, ranks
        pairs, place = self.pairs, (1 << 40) - 1

        def put(at, rank):
            node = at + width
            tree[node] = none if rank is None else (rank << 40) | at
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a <= b else b
                node >>= 1

        while tree[1] < none:
            top = tree[1]
            i = top & place
            j = after[i]
            ids[i], ids[j] = top >> 40, -1
            k = after[i] = after[j]
            put(j, None)
            if k < n:
                before[k] = i
                put(i, pairs.get((ids[i] << 20) | ids[k]))
            else:
                put(i, None)
            h = before[i]
            if h >= 0:
                put(h, pairs.get((ids[h] << 20) | ids[i]))
        return tuple(x for x in ids if x >= 0)

    def pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = (whole,)
            elif len(p) >= LONG:
                out[k] = self._alone(p)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for width, rows in by_width.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for k, ids in zip(part, self._side_by_side([pieces[k] for k in part], max(2, width)), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; special strings are ordinary text."""
        split = [self.pattern.findall(t) for t in texts]
        wanted = set().union(*split)
        new = [p for p in wanted if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES or self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached, new = 0, list(wanted)
        raw = [p.encode() for p in new]
        self.cached += sum(map(len, raw))
        self.cache.update(zip(new, self.pieces(raw), strict=True))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, s))) for s in split]

    def forget(self) -> None:
        """Empties the cache of pieces."""
        self.cache, self.cached = {}, 0

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def texts_of(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20):
    """Runs of rows of about a megabyte, with their texts."""
    for at, n, data, offs in chunks(batch, name, most):
        raw = data.tobytes()
        yield batch.slice(at, n), [raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]


@lean
def _encoded(batches, path: str, pattern: str):
    e = encoder(path, pattern)
    try:
        for batch in batches:
            for rows, texts in texts_of(batch):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(e.encode(texts), pa.list_(pa.int32()))], [*rows.schema.names, "ids"])
    finally:
        e.forget()


@lean
def _decoded(batches, path: str, pattern: str):
    e = encoder(path, pattern)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in ids], pa.binary())], [*batch.schema.names, "bytes"])


@lean
def _checked(batches, path: str, pattern: str):
    e = encoder(path, pattern)
    try:
        for batch in batches:
            for rows, texts in texts_of(batch):
                ids = e.encode(texts)
                same = [e.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                rest = rows.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], [*rest.schema.names, "ids", "decodes"])
    finally:
        e.forget()


@lean
def _digests(batches, path: str, pattern: str):
    e = encoder(path, pattern)
    try:
        for batch in batches:
            for rows, texts in texts_of(batch):
                n, a, b = [], [], []
                for ids in e.encode(texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(e.text.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(e.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    finally:
        e.forget()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `ids`, the token ids of `text` (null is empty: no ids). Map-only; texts of any length, n log n in the longest piece. A column named ids is replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    docs = docs.drop("ids")
    return docs.mapInArrow(partial(_encoded, path=path, pattern=pattern), StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with `bytes`, what its `ids` stand for (null ids: none). A column named bytes is replaced."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    encoded = encoded.drop("bytes")
    return encoded.mapInArrow(partial(_decoded, path=path, pattern=pattern), StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))


def checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `ids` in place of `text`, and `decodes`: whether they decode to it (null is empty). Encoded and decoded in one pass, so a task has one worker and texts don't travel back."""
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    docs = docs.drop("ids", "decodes")
    rest = docs.drop("text").schema.fields
    return docs.mapInArrow(partial(_checked, path=path, pattern=pattern), StructType([*rest, StructField("ids", ArrayType(IntegerType())), StructField("decodes", BooleanType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids.

    Null texts are empty and have no ids; null ids stay null; rows that repeat each get their row; texts and
    pieces of any length are encoded whole. An empty table gives no rows; extra columns play no part.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_digests, path=path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
