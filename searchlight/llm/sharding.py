"""Shards by jump consistent hashing, as column expressions.

A key's path through the growing number of shards is a pseudo-random walk that jumps only forward; its
shard among n is where it stands before it jumps past n. So no ring is kept, and one more shard takes
only the rows that jump onto it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the generator that jump consistent hashing is defined with; fixed value.
MULTIPLIER = 2862933555777941757


def jump_shards(key: str, n: int) -> Column:
    """A struct (shard, grown): the shard of the 64-bit key in the named column among n, and among n + 1.

    A step multiplies modulo 2^64. Long arithmetic would overflow, so the state is a decimal, which holds the product.
    """
    product = f"pmod(s.k * {MULTIPLIER}BD + 1BD, 18446744073709551616BD)"
    return F.expr(f"""aggregate(sequence(0, {n}),
      struct(cast(pmod(cast({key} as decimal(20,0)), 18446744073709551616BD) as decimal(20,0)) as k, 0L as at, 0L as shard, 0L as grown),
      (s, i) -> case when s.at > {n} then s else transform(array(cast({product} as decimal(20,0))), k -> struct(
          k as k,
          cast(floor((s.at + 1) * (2147483648D / (cast(k div 8589934592BD as double) + 1D))) as bigint) as at,
          case when s.at < {n} then s.at else s.shard end as shard,
          s.at as grown))[0] end,
      s -> struct(cast(s.shard as int) as shard, cast(s.grown as int) as grown))""")


def shard_rows(docs: DataFrame, *, shards: int = 24, buckets: int = 64) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard.

    The key decides alone (law `key`), so equal texts with different ids may part. Null ids all have one key, null texts
    are empty, and rows that are equal throughout get neighbouring slots. slot numbers the rows of a shard from 0 without
    gaps: rows are counted in buckets of each shard, so no task has to number a whole shard.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.col("doc_id").cast("bigint")).alias("__k"))
    rows = rows.withColumn("__j", jump_shards("__k", shards)).select("doc_id", "size", "text_crc32", F.col("__j.shard").alias("shard"), F.col("__j.grown").alias("grown_shard"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    # At most shards * buckets rows.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard")
