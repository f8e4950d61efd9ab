"""Counting quotient filters of 64-bit fingerprints, and bounded bitmaps that route rows by them."""
from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import grouped, longs, pack, unpack
from .workspace import freed, slices

#: Bits of a routing bitmap: 2 ** 27 bits are 16 MB, whatever the corpus holds.
BITMAP_BITS = 27


class CountingQuotientFilter:
    """Fingerprints as quotient (high bits) and remainder (low bits), sorted, each with a count.

    A quotient's remainders form one sorted run; `ends` holds where each run ends. Nothing is
    lost: quotient and remainder together are the fingerprint, so merging filters by their
    sorted remainders gives the filter of all their insertions.
    """

    def __init__(self, q: int, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.ends, self.remainders, self.counts = q, ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, q: int | None = None) -> CountingQuotientFilter:
        f = fingerprints.astype(np.uint64)
        counts = np.ones(len(f), np.int64) if counts is None else counts
        order = np.argsort(f, kind="stable")
        f, counts = f[order], counts[order]
        first = np.ones(len(f), bool)
        first[1:] = f[1:] != f[:-1]
        at = np.flatnonzero(first)
        counts = np.add.reduceat(counts, at) if len(at) else counts
        f = f[at]
        q = q or max(1, int(len(f)).bit_length())
        ends = np.searchsorted((f >> np.uint64(64 - q)).astype(np.int64), np.arange(1 << q), side="right")
        return cls(q, ends.astype(np.int64), f & np.uint64((1 << (64 - q)) - 1), counts)

    def fingerprints(self) -> np.ndarray:
        lengths = np.diff(self.ends, prepend=0)
        return (np.repeat(np.arange(1 << self.q, dtype=np.uint64), lengths) << np.uint64(64 - self.q)) | self.remainders

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        every = (self, *others)
        return CountingQuotientFilter.of(np.concatenate([x.fingerprints() for x in every]), np.concatenate([x.counts for x in every]), max(x.q for x in every))

    def repeated(self, least: int = 2) -> np.ndarray:
        return self.fingerprints()[self.counts >= least]

    def count(self, fingerprint: int) -> int:
        quotient, rest = fingerprint >> (64 - self.q), fingerprint & ((1 << (64 - self.q)) - 1)
        a, b = (int(self.ends[quotient - 1]) if quotient else 0), int(self.ends[quotient])
        at = a + int(np.searchsorted(self.remainders[a:b], np.uint64(rest)))
        return int(self.counts[at]) if at < b and int(self.remainders[at]) == rest else 0

    def to_bytes(self) -> bytes:
        return pack(np.array([self.q]), self.ends.astype(np.uint32), self.remainders, self.counts.astype(np.uint32))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, ends, remainders, counts = unpack(blob)
        return cls(int(q[0]), ends.astype(np.int64), remainders, counts.astype(np.int64))


def build(found: list[np.ndarray], bits: int):
    """One filter for each range of fingerprints, of all those that a partition found."""
    f = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
    cuts = np.searchsorted((f >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    made = [(k, CountingQuotientFilter.of(f[a:b]).to_bytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["slice", "filter"])


def _build(batches, bits: int):
    yield from build([longs(b, "fp").view(np.uint64) for b in batches], bits)


def _merged(table: pa.Table) -> CountingQuotientFilter:
    first, *rest = [CountingQuotientFilter.from_bytes(x.as_buffer()) for chunk in table.column("filter").chunks for x in chunk]
    return first.merge(*rest)


def _bitmap(table: pa.Table, least: tuple[int, ...], bits: int) -> pa.Table:
    """The slice's part of each bitmap; the slice is a range of fingerprints, so of bits."""
    f, k, size = _merged(table), table.column("slice")[0].as_py(), 1 << (BITMAP_BITS - bits)
    out = []
    for n in least:
        part = np.zeros(size, bool)
        part[(f.repeated(n) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) - k * size] = True
        out.append(np.packbits(part).tobytes() if part.any() else None)
    return pa.table({"slice": pa.array([k] * len(least), pa.int32()), "least": pa.array(least, pa.int32()), "bits": pa.array(out, pa.binary())})


def _counted(table: pa.Table) -> pa.Table:
    f = _merged(table)
    more = f.counts > 1
    return pa.table({"fp": pa.array(f.fingerprints()[more].view(np.int64)), "n": pa.array(f.counts[more].astype(np.int64))})


def slice_bits(df: DataFrame) -> int:
    """Bits of the ranges that filters are dealt by."""
    return min(16, max(6, (slices(df, 2) - 1).bit_length()))


def filters(df: DataFrame) -> tuple[DataFrame, int]:
    """The filters of a table's column fp (long), by partition and range of fingerprints; the bits of the ranges."""
    bits = slice_bits(df)
    return df.select("fp").mapInArrow(partial(_build, bits=bits), "slice int, filter binary"), bits


def counts(df: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once: fp, n. Exact."""
    made, _ = filters(df)
    return made.groupBy("slice").applyInArrow(grouped(_counted), "fp long, n long")


def bitmaps_of(spark, made: DataFrame, bits: int, *least: int) -> list:
    """Broadcast bitmaps of BITMAP_BITS bits with the bit of every fingerprint that the filters count `least` times or more. Their size is fixed; false hits are for the caller's exact step."""
    whole = {n: np.zeros(1 << (BITMAP_BITS - 3), np.uint8) for n in least}
    size = 1 << (BITMAP_BITS - 3 - bits)
    parts = made.groupBy("slice").applyInArrow(grouped(_bitmap, least=least, bits=bits), "slice int, least int, bits binary")
    with freed(spark):
        rows = parts.where("bits IS NOT NULL").collect()  # 2 ** BITMAP_BITS bits each in all
    for row in rows:
        whole[row[1]][row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[2], np.uint8)
    return [spark.sparkContext.broadcast(whole[n].tobytes()) for n in least]


def bitmaps(df: DataFrame, *least: int) -> list:
    """bitmaps_of the fingerprints in a table's column fp."""
    made, bits = filters(df)
    return bitmaps_of(df.sparkSession, made, bits, *least)


def bitmap(df: DataFrame, repeated: bool):
    """The bitmap of all fingerprints, or of those that occur more than once."""
    return bitmaps(df, 2 if repeated else 1)[0]


def in_bitmap(fp: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned fingerprint is set."""
    place = fp >> np.uint64(64 - BITMAP_BITS)
    return (whole[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def hit(fp: Column, bits) -> Column:
    """Whether the bit of a fingerprint is set."""

    @F.pandas_udf("boolean")
    def test(f: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(f.to_numpy(np.int64).view(np.uint64), np.frombuffer(bits.value, np.uint8)))

    return test(fp)


def without(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of df whose key isn't among dropped[key] (long). Only rows that hit the bitmap of dropped keys are shuffled."""
    bits = bitmap(dropped.select(F.xxhash64(key).alias("fp")), repeated=False)
    maybe = hit(F.xxhash64(F.col(key)), bits)
    tagged = df.withColumn("__maybe", maybe)
    sure = tagged.where(~F.col("__maybe")).drop("__maybe")
    rest = tagged.where("__maybe").drop("__maybe")
    return sure.unionByName(rest.join(dropped.select(key).distinct(), key, "left_anti").select(*[F.col("`" + c + "`") for c in df.columns]))
