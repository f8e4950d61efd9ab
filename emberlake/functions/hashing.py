"""Randomness that depends on keys alone, not on partitions: the same in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
RANGE = 4503599627370496.0  # 2 ** 52: thirteen hexadecimal digits


def uniform(stream: str, *keys: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) for each key."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(RANGE)


def uniform_sql(stream: str, *keys: str, seed: int = SEED) -> str:
    text = ", ".join([f"'{seed}'", f"'{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"
