"""Helpers shared by the operators: reading, lineage cuts, ranks without a hot window, components."""

from __future__ import annotations

import gc
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir; only a local session may leave it unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir", "")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files (and, where spark.cleaner.referenceTracking.cleanCheckpoints is set, the checkpoints) of tables that are
    no longer in use. Its cleaner learns of these only when the driver collects its garbage, which a short plan of large stages may not cause.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(col: Column) -> Column:
    """crc32 of the id written in decimal; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def gapless_rank(
    df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 1024, spread: list[str] | None = None
) -> DataFrame:
    """Number the rows of each group from 0 without sorting a whole group in one task.

    Rows are dealt into `buckets` buckets by a hash of `spread` (default: the order columns). Each
    (group, bucket) is ranked on its own; an offset for each (group, bucket) comes from the bucket
    counts, whose table has at most groups x buckets rows. `group` must have a bounded number of
    values, as that table is broadcast.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*(spread or order)), F.lit(buckets)).cast("int"))
    by = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(by), F.lit(0)))
        .select(*(F.col(c).alias(f"_g_{c}") for c in group), F.col("_bucket").alias("_b"), "_offset")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    on = reduce(lambda a, b: a & b, [*same, F.col("_bucket") == F.col("_b")])
    return (
        bucketed.withColumn("_i", F.row_number().over(inside))
        .join(F.broadcast(offsets), on)
        .withColumn(out, (F.col("_offset") + F.col("_i") - 1).cast("long"))
        .drop("_bucket", "_b", "_i", "_offset", *(f"_g_{c}" for c in group))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: (node, component), component = smallest node of it.

    Each round hangs every node on its least smaller neighbour, follows the pointers to the trees' tops by
    doubling, and puts the tops in place of the nodes: edges inside a tree go, so a star of any size is
    settled in one round and no join meets its centre as a hot key. Nodes without an edge are absent. The
    tables are checkpointed, so a lost executor costs a round.
    """
    rest = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    names = rest.where("false").select(F.col("u").alias("node"), F.col("v").alias("top"))
    for _ in range(max_rounds):
        if rest.isEmpty():
            tops = names.select(F.col("top").alias("node"), F.col("top").alias("component")).distinct()
            return names.select("node", F.col("top").alias("component")).unionByName(tops)
        up = checkpointed(rest.groupBy("u").agg(F.min("v").alias("p")))
        moved = True
        while moved:
            above = up.select(F.col("u").alias("m"), F.col("p").alias("q"))
            up = checkpointed(up.join(above, F.col("p") == F.col("m"), "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.select("u", "p")
        lifted = names.join(up, F.col("top") == F.col("u"), "left").select("node", F.coalesce("p", "top").alias("top"))
        names = checkpointed(lifted.unionByName(up.select(F.col("u").alias("node"), F.col("p").alias("top"))))
        half = rest.join(up, "u").where("p <> v").select(F.col("p").alias("x"), "v").distinct()
        both = half.join(up, F.col("v") == F.col("u"), "left").select("x", F.coalesce("p", "v").alias("y")).where("x <> y")
        rest = checkpointed(both.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
