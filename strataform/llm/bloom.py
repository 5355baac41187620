"""A one-hash Bloom filter of a fixed size as a table, to keep large rows out of a shuffle.

The filter has at most FILTER_BITS bits, 8 MB, whatever the number of keys, so it may be
broadcast. Beyond some tens of millions of keys it lets more rows through; results stay the
same, as every row it lets through meets an exact join afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.llm.names import unused
from strataform.session import materialize

FILTER_BITS = 1 << 26
#: Bits of one row of a filter's table.
_ROW = 1 << 15
_FILES = 4


def _hash(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def build(keys: DataFrame, key: str, name: str) -> DataFrame:
    """(k, bits): a bit for each key's hash, 32,768 bits a row."""
    h = keys.select(_hash(F.col(key)).alias("h"))
    bits = h.groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    return materialize(keys.sparkSession, bits.coalesce(_FILES), name)  # 8 MB in all at most


def split(df: DataFrame, key: str, bloom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is surely not in the filter (null keys among them), and those whose key may be."""
    h = _hash(F.col(f"`{key}`"))
    names = [F.col(f"`{c}`") for c in df.columns]
    at = F.bitmap_bit_position(h)
    k, b = unused(df.columns, "bloom_k"), unused(df.columns, "bloom_bits")
    marked = df.withColumn(k, F.bitmap_bucket_number(h)).join(F.broadcast(bloom.select(F.col("k").alias(k), F.col("bits").alias(b))), k, "left")
    byte = F.conv(F.hex(F.col(b).substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False)) & F.col(f"`{key}`").isNotNull()
    return marked.filter(~on).select(*names), marked.filter(on).select(*names)


def bits(keys: DataFrame, key: str) -> np.ndarray:
    """The filter as bytes, for Python workers; `key` is a 64-bit hash already, repeats are welcome.

    Keys travel as numbers and become bits in the task that owns their row, so that at most
    FILTER_BITS reach the driver, whatever the number of partitions.
    """
    h = keys.select(F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("h")).select(F.floor(F.col("h") / _ROW).cast("int").alias("part"), (F.col("h") % _ROW).alias("at"))
    rows = h.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.collect():
        out[r.part * _ROW // 8 : (r.part + 1) * _ROW // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def among(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    h = (key.astype(np.uint64, copy=False) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
