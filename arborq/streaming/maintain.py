"""Keep an edge table in step with a stream of note changes.

Changes are rows (seq, op, path, new_path, content, front_matter) with op upsert, rename or delete. Each micro-batch
is folded in the order of seq, so it gives the table that its changes give one by one: upserts replace the edges of
a note, renames rewrite both ends and the owner of the edges there are by then, deletes drop them. Only upserts whose
note isn't replaced or deleted later in the batch are parsed. The state is the edge table itself, written as a new version per batch in a shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from arborq.operators.common import checkpointed

CHANGES = "seq long, op string, path string, new_path string, content string, front_matter string"


START = -(1 << 63)


def settled(names: DataFrame, changes: DataFrame, ends: list[str]) -> DataFrame:
    """(name, since, now): the name that the note called `name` after change `since` has at the end, null if an op of `ends` met it."""
    events = checkpointed(changes.where(F.col("op").isin("rename", *ends)).select(F.col("seq").alias("e_seq"), "op", F.col("path").alias("e_path"), "new_path"))
    met = names.select("name", "since").distinct().join(events, F.col("name") == F.col("e_path"), "left_semi")
    now = checkpointed(met.select("name", "since", F.col("name").alias("now"), F.col("since").alias("seq")))
    while True:
        hit = now.join(events, (F.col("now") == F.col("e_path")) & (F.col("e_seq") > F.col("seq")))
        following = checkpointed(hit.groupBy("name", "since").agg(F.min(F.struct("e_seq", "op", "new_path")).alias("e")))
        if following.isEmpty():
            return now.select("name", "since", "now")
        to = F.when(F.col("e").isNull(), F.col("now")).when(F.col("e.op") == "rename", F.col("e.new_path"))
        moved = now.join(following, ["name", "since"], "left")
        now = checkpointed(moved.select("name", "since", to.alias("now"), F.coalesce("e.e_seq", "seq").alias("seq")))


def applied(edges: DataFrame, changes: DataFrame, parse) -> DataFrame:
    """Edges after a batch of changes; parse(notes) gives edges (columns as the table's) of notes (path, content, front_matter)."""
    changes = checkpointed(changes)
    upserts = changes.where("op = 'upsert'")
    owners = settled(upserts.select(F.col("path").alias("name"), F.col("seq").alias("since")), changes, ["upsert", "delete"])
    live = upserts.join(owners, (F.col("path") == F.col("name")) & (F.col("seq") == F.col("since"))).where("now is not null")
    turns = Window.partitionBy("path").orderBy("seq")
    live = checkpointed(live.select("path", "content", "front_matter", "seq", F.row_number().over(turns).alias("turn")))
    dated = edges.withColumn("_since", F.lit(START))
    for turn in range(1, (live.agg(F.max("turn")).first()[0] or 0) + 1):  # a path has more than one only if notes were renamed
        fresh = live.where(F.col("turn") == turn)
        parsed = parse(fresh.select("path", "content", "front_matter")).select(*edges.columns)
        at = fresh.select(F.col("path").alias("_path"), F.col("seq").alias("_since"))
        dated = dated.unionByName(parsed.join(at, F.col("owner") == F.col("_path")).select(*edges.columns, "_since"))
    for column, ends in (("owner", ["upsert", "delete"]), ("src", ["delete"]), ("dst", ["delete"])):
        names = settled(dated.select(F.col(column).alias("name"), F.col("_since").alias("since")), changes, ends)
        both = dated.join(names, (F.col(column) == F.col("name")) & (F.col("_since") == F.col("since")), "left")
        kept = both.where("name is null or now is not null").withColumn(column, F.when(F.col("name").isNull(), F.col(column)).otherwise(F.col("now")))
        dated = kept.select(*edges.columns, "_since")
    return dated.select(*edges.columns)


@dataclass(frozen=True)
class EdgeTable:
    """Versions of an edge table in a shared folder; version n is the state after n micro-batches."""

    folder: str

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/v={version}")

    def write(self, edges: DataFrame, version: int) -> None:
        edges.write.mode("overwrite").parquet(f"{self.folder}/v={version}")


def maintain(changes: DataFrame, state: EdgeTable, parse, empty: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that applies each micro-batch to the table; version = batch + 1, so a batch done again gives the same version."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = state.read(spark, number) if number else empty
        state.write(applied(before, batch, parse), number + 1)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

