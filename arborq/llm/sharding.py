"""Sharding by jump consistent hashing, in Spark expressions only.

Each key walks the jump sequence (Lamping and Veach): the bucket of the last jump below the shard count
is its shard. No ring table is kept, and raising the count by one moves rows into the new shard alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import gapless_rank, table

# The 64-bit multiplier of the published algorithm, 2862933555777941757, in 32-bit halves.
_LOW, _HIGH = 2862933555777941757 & 0xFFFFFFFF, 2862933555777941757 >> 32
_MASK = 0xFFFFFFFF


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a long key; null for a null key.

    The generator's state is kept as two 32-bit halves, because Spark's long product raises on overflow.
    The bucket rises with each jump, so `shards` steps always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    mask = F.lit(_MASK)
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(mask).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = s["hi"], s["lo"]
        t0 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW)
        t1 = F.shiftright(lo, 16) * F.lit(_LOW)
        low_sum = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
        cross = (lo * F.lit(_HIGH)).bitwiseAND(mask) + (hi * F.lit(_LOW - (1 << 32))).bitwiseAND(mask)
        new_lo = low_sum.bitwiseAND(mask)
        new_hi = (F.shiftright(low_sum, 32) + F.shiftright(t1, 16) + cross).bitwiseAND(mask)
        jump = F.floor(
            (s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + F.lit(1)).cast("double"))
        )
        return F.when(s["j"] >= F.lit(shards), s).otherwise(
            F.struct(new_hi.alias("hi"), new_lo.alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"])
    return F.when(key.isNotNull(), walked).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row.

    size is the UTF-8 length of the text plus 1 (null text: 1), text_crc32 the unsigned CRC of its UTF-8
    bytes (null as empty). Law `key`: key and shard count decide; grown_shard is the shard with one more.
    slot numbers each shard's rows from 0. A null key is put where key 0 goes. Rows that repeat a key share
    its shard and get slots of their own; an empty table gives an empty result. Only the key and the
    derived columns are shuffled, not the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    k = F.coalesce(F.col(key).cast("long"), F.lit(0))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(k, shards).alias("shard"),
        jump_shard(k, shards + 1).alias("grown_shard"),
    )
    return gapless_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)
