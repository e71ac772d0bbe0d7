"""Lineage cuts and ranks for the graph operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir; only a local session may leave it unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir", "")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def anew(df: DataFrame) -> DataFrame:
    """As checkpointed, for tables that unions and joins with their own descendants go on from.

    A checkpointed table can hold on to what was known of columns that it no longer has, which a union of it fails on; so
    the columns have other names in it, and get their own back above it.
    """
    names = df.columns
    inside = checkpointed(df.toDF(*(f"kept_{c}" for c in names)))
    return inside.select(*(F.col(f"`kept_{c}`").alias(c) for c in names))


BLOCK = 1 << 20


def crossed(left: DataFrame, right: DataFrame, on: str, block: int | None = None) -> DataFrame:
    """The inner join on a column, whatever the number of rows that share a value on both sides.

    A value that makes more than `block` rows has either side cut into pieces; each two of them meet in a task of their own, so that no
    task holds or makes more than about a block at once, and nothing made is shuffled. Both sides are read three times.
    """
    block = block or BLOCK
    n = left.groupBy(on).agg(F.count(F.lit(1)).alias("_nl"))
    asked = checkpointed(n)
    if asked.count() <= 1 << 16:
        right = right.join(F.broadcast(asked.select(on)), on, "left_semi")
    both = checkpointed(asked.join(right.groupBy(on).agg(F.count(F.lit(1)).alias("_nr")), on))
    made = F.col("_nl") * F.col("_nr")
    large = both.where(made > block)
    total = large.agg(F.sum(made)).first()[0]
    if not total:
        return left.join(right, on)
    # A side shorter than a square block's lets the other's pieces be longer.
    side = int(block**0.5)
    pieces = lambda mine, other: F.ceil(F.col(mine) / F.greatest(F.lit(side), F.floor(F.lit(block) / F.col(other)))).cast("int")
    cuts = F.broadcast(large.select(F.col(on), pieces("_nl", "_nr").alias("_pl"), pieces("_nr", "_nl").alias("_pr")))
    dealt = []
    for df, mine, other in ((left, "l", "r"), (right, "r", "l")):
        own = F.pmod(F.xxhash64(*df.columns), F.col(f"_p{mine}")).cast("int").alias(f"_{mine}")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"_p{other}") - 1)).alias(f"_{other}")
        dealt.append(df.join(cuts, on).select(*df.columns, own, copies))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(total) // (4 * block), 1 << 14))
    met = dealt[0].repartition(tasks, on, "_l", "_r").join(dealt[1].repartition(tasks, on, "_l", "_r").hint("shuffle_hash"), [on, "_l", "_r"]).drop("_l", "_r")
    rest = left.join(cuts, on, "left_anti").join(right.join(cuts, on, "left_anti"), on)
    return met.unionByName(rest) if both.count() > large.count() else met


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 1 in an order, with groups of any size.

    Rows are range-partitioned by group and order, so a large group lies in consecutive partitions; each
    partition ranks its share and adds the rows of the group in the partitions before.
    """
    dealt = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    mine = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).alias("l")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "_part")]
    joined = mine.join(offsets.alias("r"), on)
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col("l._i") + F.col("r._before")).cast("long").alias(out))


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals in the plan, so that no Python worker hands them out."""
    columns = [c.split() for c in schema.split(", ")]
    made = [F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns, strict=True))) for row in rows]
    kind = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in columns) + ">>"
    return spark.range(1).select(F.inline(F.array(*made) if made else F.array().cast(kind)))
