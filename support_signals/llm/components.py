"""Connected components and fixed-size bitmaps over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of every node in ``edges`` (columns a, b; integers).

    Alternating stars: every node hands its neighbours to the smallest of them until each edge leads to a root.  Minima
    are aggregated before the shuffle and joined back, so a node with very many neighbours is no single task's group.
    """
    e = write_table(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = write_table(small.select("p.*").where("u <> v").distinct(), "edges")
        new = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
    raise RuntimeError("components did not settle")


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``.

    Rows far above the expected bound leave first, so that each task sends about its share and not ``rows`` of its own."""
    n = df.count()
    share = 1.5 * rows / max(n, 1) + 100 / max(n, 1)
    below = df if share >= 1 else df.where(F.xxhash64(key) < F.lit(int(-(2**63) + share * 2**64)))
    return below.orderBy(F.xxhash64(key), key).limit(rows)


def bit_of(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << bits))


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits flags, packed: set where a value of ``column`` falls.  Its size does not depend on the data; a fuller
    bitmap only lets more rows pass that a later join drops."""
    return exact_bitmap(values.select(bit_of(F.col(column), bits).alias("at")), bits)


def exact_bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """The flags at the positions in column ``at``, each from 0 to 2**bits - 1."""
    at = positions.select((F.col("at") + 1).alias("at"))     # Spark's positions count from 1
    parts = (at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("map")).collect())
    out = np.zeros(max(1 << bits, 1 << 15) // 8, dtype=np.uint8)
    for row in parts:
        lo = (row["bucket"] - 1) * 4096
        out[lo:lo + 4096] = np.frombuffer(bytes(row["map"]), dtype=np.uint8)
    return out


def has_bit(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
