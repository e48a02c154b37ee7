"""Sharding by jump consistent hashing, in DataFrame functions only.

``jump_hash`` follows Lamping and Veach: a key seeds a 64-bit linear
congruential generator and jumps ahead from shard to shard; the last jump below
the shard count is its shard.  No ring table exists, and going from n to n+1
shards moves a key either nowhere or into the new shard.

Spark's ANSI longs raise on overflow, so the generator's state is held as three
limbs of 22, 22 and 20 bits, whose partial products stay far below 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Fixed value: the generator's multiplier in the published algorithm.
MULTIPLIER = 2862933555777941757
_M22, _M20 = (1 << 22) - 1, (1 << 20) - 1
_C0, _C1, _C2 = MULTIPLIER & _M22, MULTIPLIER >> 22 & _M22, MULTIPLIER >> 44


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard in [0, n_shards) of a long ``key``; a null key counts as 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        key.bitwiseAND(_M22).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(_M22).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column, _: Column) -> Column:
        t0 = s["k0"] * F.lit(_C0) + F.lit(1)
        t1 = s["k0"] * F.lit(_C1) + s["k1"] * F.lit(_C0) + F.shiftright(t0, 22)
        t2 = s["k0"] * F.lit(_C2) + s["k1"] * F.lit(_C1) + s["k2"] * F.lit(_C0) + F.shiftright(t1, 22)
        k1, k2 = t1.bitwiseAND(_M22), t2.bitwiseAND(_M20)
        draw = F.shiftleft(k2, 11) + F.shiftright(k1, 11) + F.lit(1)  # the state's top 31 bits, plus one
        onward = F.struct(
            t0.bitwiseAND(_M22).alias("k0"), k1.alias("k1"), k2.alias("k2"), s["j"].alias("b"),
            F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long").alias("j"),
        )
        return F.when(s["j"] < F.lit(n_shards), onward).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(n_shards))  # every jump goes ahead by one shard at least
    return F.aggregate(steps, start, jump, lambda s: s["b"].cast("int"))


def shard(df: DataFrame, key: str, text: str, n_shards: int, rows_per_block: int = 100_000, copies_per_row: int = 10_000) -> DataFrame:
    """Give every row its shard, its place in the shard, and its shard after one is added.

    Adds to the key column: size (UTF-8 bytes of the text plus 8), text_crc32,
    law, shard, slot, grown_shard.  Other columns are left out, so clashing
    names cannot occur.

    Slots count the rows of a shard in order of key, checksum and size, so they do
    not depend on how the table is stored.  No task sorts a shard: rows that agree in
    all of these are counted first, what is left is cut into ranges of about
    ``rows_per_block`` rows over all shards, a range is numbered in one task, and the
    running sum of the ranges' sizes gives each its first slot.  A row with more
    than ``copies_per_row`` copies is dealt out in parts of so many.

    Null text has 8 bytes and the checksum of no bytes.  Null keys go where key
    0 goes, ahead of others.  Repeated rows get slots of their own.  An empty table
    gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        df.select(
            F.col(key).alias("_key"),
            (F.octet_length(body).cast("long") + F.lit(8)).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            jump_hash(F.col(key), n_shards).alias("shard"),
            jump_hash(F.col(key), n_shards + 1).alias("grown_shard"),
        ),
        "sharded",
    )
    order = [F.col("_key").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    n_ranges = max(1, -(-rows.count() // rows_per_block))
    distinct = rows.groupBy("_key", "size", "text_crc32", "shard", "grown_shard").agg(F.count(F.lit(1)).alias("_n"))
    # The number of its range is written with each row, since a later read may deal rows out differently.
    ranged = materialize(distinct.repartitionByRange(n_ranges, F.col("shard"), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("shard", "_range").agg(F.sum("_n").alias("_m"))
    ahead = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "_range", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(firsts, ["shard", "_range"])
    placed = numbered.select("_key", "size", "text_crc32", "shard", "grown_shard", "_n", (F.col("_first") + F.col("_before")).alias("_slot"))

    def dealt(some: DataFrame) -> DataFrame:
        last = F.col("_slot") + F.col("_n") - F.lit(1)
        return some.select("_key", "size", "text_crc32", "shard", "grown_shard", F.explode(F.sequence(F.col("_slot"), last)).alias("slot"))

    few, many = placed.where(F.col("_n") <= copies_per_row), placed.where(F.col("_n") > copies_per_row)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.lit(1), F.lit(copies_per_row).cast("long")))
    parts = many.withColumn("_part", part).repartition(n_ranges, "_key", "_part")
    parts = parts.withColumns({"_n": F.least(F.col("_n") - F.col("_part"), F.lit(copies_per_row)), "_slot": F.col("_slot") + F.col("_part")}).drop("_part")
    return dealt(few).unionByName(dealt(parts)).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
