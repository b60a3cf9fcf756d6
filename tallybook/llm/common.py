"""Small helpers of the operators: kept tables, Arrow columns, bitmaps of hashes, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources.files import scratch_folder

BITMAP_BITS = 1 << 25
"""Bits of a bitmap of hashes (4 MB), whatever the size of the input; a full bitmap only lets more candidates through."""
_BLOCK = 32768


def keep(df: DataFrame, label: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: later steps survive lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The frame dealt out by hash over all shuffle partitions: for work that is heavy although its rows are small, so that
    small partitions must not be put together."""
    return df.repartition(partitions(df.sparkSession), *columns)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def binaries(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


def bit_of(hashed: Column) -> Column:
    """Place of a 64-bit hash in a bitmap."""
    return F.pmod(hashed, F.lit(BITMAP_BITS))


def bitmap_of(df: DataFrame, column: str) -> np.ndarray:
    """Bits of all 64-bit hashes of a column, one uint8 per 8 bits: set bits are built per block in Spark, and the driver
    joins at most BITMAP_BITS / 32768 blocks of 4 KB."""
    place = bit_of(F.col(column))
    blocks = (
        df.select(F.floor(place / _BLOCK).cast("int").alias("block"), (place % _BLOCK).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in blocks.toLocalIterator():
        out[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; no hash that was put in is missed."""
    place = hashes % np.uint64(BITMAP_BITS) if BITMAP_BITS & (BITMAP_BITS - 1) else hashes & np.uint64(BITMAP_BITS - 1)
    place = place.astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the undirected links (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label of all neighbours and then the label of the label; a round is kept as a table, and
    only a count of changes reaches the driver. A node with many links meets its label in a join that Spark can split.
    """
    both = keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        top = met.select(F.col("node").alias("low"), F.col("low").alias("root"))
        step = keep(
            met.join(top, "low").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("new")),
            "labels",
        )
        done = step.where("new").isEmpty()
        labels = step.drop("new")
        if done:
            return labels
