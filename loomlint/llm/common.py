"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, save, scope, scratch, shared_dir  # noqa: F401

#: Rows and bytes of an Arrow batch that are worked on at a time; Spark bounds
#: the batch itself. Memory for work doesn't follow text length, but for one text.
SLICE_ROWS = 1000
SLICE_BYTES = 16 << 20

#: A run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE_ROWS rows and about SLICE_BYTES."""
    for b in batches:
        rows = max(1, min(SLICE_ROWS, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves remainder 0 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(col: str) -> Column:
    """Text as UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 8) -> DataFrame:
    """``big`` joined with ``small``, which has a key once; a hot key of ``big`` is spread over tasks by ``spread``.

    ``small`` is repeated ``salts`` times: for sides of few rows beside ``big``.
    """
    x = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    y = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.join(y, [key, "_salt"], how).drop("_salt")


#: Keys that a hot join broadcasts at most.
HOT_KEYS = 10_000


def hot_join(big: DataFrame, small: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``big`` (``total`` rows) with ``small``, which has a key once and in ``n`` how many rows of ``big`` have it.

    Keys of more than a ten-thousandth of the rows, of which there are at most
    ``HOT_KEYS``, are broadcast, so their rows stay where they lie.
    """
    hot = F.col(n) >= max(1000, -(-total // HOT_KEYS))
    few, rest = small.where(hot).drop(n), small.where(~hot).drop(n)
    return big.join(F.broadcast(few), key).unionByName(big.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))
