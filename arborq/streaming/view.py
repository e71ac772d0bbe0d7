"""Explicit and implied edges kept in step with note changes, at the cost of what changed.

Two tables lie in a shared folder, each dealt into buckets: explicit edges by the hash of their owner, and, by the hash of their source, the ways in which
an implied edge comes about, with the number of times each is there. A batch of changes is worked out on the buckets it touches; what it adds
and takes away from the explicit edges, as counts of +1 and -1, is joined with the rules (for sibling rules with the edges at
the same shared notes), and these counts are added to the ways. A way whose count reaches 0 is gone. Only touched
buckets are written; a manifest for each version tells which version holds each bucket, so a batch done again after a failure
reads what it read before and gives the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from arborq.operators.common import checkpointed, listed
from arborq.operators.edges import EDGE_COLUMNS
from arborq.operators.implied import Rule
from arborq.streaming.maintain import applied

EDGES = "src string, dst string, relation string, label string, implied boolean, implied_from string, ord long, owner string"
WAYS = "src string, dst string, relation string, stage int, ord long, rule int, turn int, implied_from string, n long"
WAY = ["src", "dst", "relation", "stage", "ord", "rule", "turn", "implied_from"]


@dataclass(frozen=True)
class Buckets:
    """Versions of a table in `folder`, dealt by the hash of `key` into `buckets`; version 0 is empty.

    Once the buckets of a version lie in more than `spread` versions, the next write takes all of them along. Files of versions that none of the last `kept` manifests
    names are emptied.
    """

    folder: str
    schema: str
    key: str
    buckets: int = 64
    spread: int = 16
    kept: int = 3

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        """The version that holds each bucket; a bucket without one is empty. At most `buckets` rows."""
        if version == 0:
            return {}
        return {r["bucket"]: r["held"] for r in spark.read.parquet(f"{self.folder}/manifest/v={version}").collect()}

    def read(self, spark: SparkSession, version: int, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: only their files are read."""
        held: dict[int, list[int]] = {}
        for bucket, v in self.manifest(spark, version).items():
            if only is None or bucket in only:
                held.setdefault(v, []).append(bucket)
        parts = [spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/data/v={v}").where(F.col("bucket").isin(b)).drop("bucket") for v, b in sorted(held.items())]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int, touched: set[int]) -> set[int]:
        """The touched buckets' rows as the version after `version`; the buckets written."""
        spark = rows.sparkSession
        manifest = self.manifest(spark, version)
        if len({v for b, v in manifest.items() if b not in touched}) >= self.spread:
            others = set(manifest) - touched
            rows, touched = rows.unionByName(self.read(spark, version, others)), touched | others
        new = version + 1
        dealt = rows.withColumn("bucket", self.bucket())
        dealt.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v={new}")
        manifest |= dict.fromkeys(touched, new)
        listed(spark, sorted(manifest.items()), "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={new}")
        self._retire(spark, new)
        return touched

    def _retire(self, spark: SparkSession, version: int) -> None:
        """Empty the versions that left the kept manifests with this one."""
        leaving = version - self.kept
        if leaving < 1:
            return
        needed = {v for n in range(leaving + 1, version + 1) for v in self.manifest(spark, n).values()}
        for v in set(self.manifest(spark, leaving).values()) - needed:
            spark.createDataFrame([], f"{self.schema}, bucket int").write.mode("overwrite").parquet(f"{self.folder}/data/v={v}")


def ways(edges: DataFrame, changed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts (WAYS) that signed changes (edge columns and n) of explicit edges bring; `edges` are those before. Places are as in `implied.candidates`."""
    spark = changed.sparkSession
    table = listed(spark, [(r.base, r.implied, r.direction, i) for i, r in enumerate(rules)], "relation string, implied_rel string, direction string, rule int")
    ruled = changed.join(F.broadcast(table), "relation")
    one = lambda a, b, turn: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(turn).alias("turn"))
    same, back = one("src", "dst", 0), one("dst", "src", 1)
    each = F.when(F.col("direction") == "forward", F.array(same)).when(F.col("direction") == "reverse", F.array(back)).otherwise(F.array(same, back))
    found = [
        ruled.where("direction <> 'sibling'").withColumn("e", F.explode(each)).select(
            "e.src", "e.dst", F.col("implied_rel").alias("relation"), F.lit(0).alias("stage"), "ord", "rule", "e.turn", F.col("relation").alias("implied_from"), "n"
        )
    ]
    moved = checkpointed(ruled.where("direction = 'sibling'"))
    before = edges.withColumn("n", F.lit(1).cast("long")).join(F.broadcast(table.where("direction = 'sibling'")), "relation")
    for stage, shared, end in ((1, "dst", "src"), (2, "src", "dst")):
        key = ["at", "relation", "implied_rel", "rule"]
        side = lambda d, x: d.select(F.col(shared).alias("at"), "relation", "implied_rel", "rule", F.struct("ord", F.col(end).alias("note"), F.coalesce("label", F.lit("")).alias("label")).alias(x), F.col("n").alias(f"{x}_n"))  # noqa: B023, E731
        touched = moved.select(F.col(shared).alias("at"), "relation", "implied_rel", "rule").distinct()
        there = checkpointed(side(before, "q").join(touched, key, "left_semi"))
        new = side(moved, "p")
        # pairs of a change and an edge from before, either way round, and of two changes
        mixed = new.join(there, key).where("p <> q")
        first, second = F.least("p", "q"), F.greatest("p", "q")
        pairs = mixed.select(*key, first.alias("a"), second.alias("b"), (F.col("p_n") * F.col("q_n")).alias("n"))
        two = new.join(side(moved, "q"), key).where("p < q").select(*key, F.col("p").alias("a"), F.col("q").alias("b"), (F.col("p_n") * F.col("q_n")).alias("n"))
        both = F.array(*(F.struct(F.col(f"{x}.note").alias("src"), F.col(f"{y}.note").alias("dst"), F.lit(t).alias("turn")) for x, y, t in (("a", "b", 0), ("b", "a", 1))))
        found.append(
            pairs.unionByName(two).withColumn("e", F.explode(both)).select(
                "e.src", "e.dst", F.col("implied_rel").alias("relation"), F.lit(stage).alias("stage"), F.col("a.ord").alias("ord"), "rule", "e.turn", F.col("relation").alias("implied_from"), "n"
            )
        )
    return reduce(DataFrame.unionByName, found).groupBy(*WAY).agg(F.sum("n").alias("n")).where("n <> 0")


@dataclass(frozen=True)
class EdgeView:
    """The view in a shared folder, for rules of `operators.implied`."""

    folder: str
    rules: tuple[Rule, ...]
    buckets: int = 64
    spread: int = 16
    kept: int = 3

    @property
    def explicit(self) -> Buckets:
        return Buckets(f"{self.folder}/edges", EDGES, "owner", self.buckets, self.spread, self.kept)

    @property
    def support(self) -> Buckets:
        return Buckets(f"{self.folder}/ways", WAYS, "src", self.buckets, self.spread, self.kept)

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """Explicit edges and, for each (src, dst, relation) that none of them covers, the implied one of the first way, as a full pass of the rules gives them."""
        explicit = self.explicit.read(spark, version).select(*EDGE_COLUMNS)
        first = self.support.read(spark, version).groupBy("src", "dst", "relation").agg(F.min(F.struct(*WAY[3:])).alias("w"))
        covered = explicit.select("src", "dst", "relation").distinct()
        new = first.join(covered, ["src", "dst", "relation"], "left_anti")
        return explicit.unionByName(
            new.select("src", "dst", "relation", F.lit(None).cast("string").alias("label"), F.lit(True).alias("implied"), F.col("w.implied_from").alias("implied_from"), F.col("w.ord").alias("ord"))
        )

    def apply(self, changes: DataFrame, version: int, parse: Callable[[DataFrame], DataFrame]) -> tuple[set[int], set[int]]:
        """Make the version after `version` by a batch of changes (see `maintain`); the buckets written of both tables.

        A batch without changes makes a version that holds all buckets where they are. Implied edges among parsed ones are not kept.
        """
        spark = changes.sparkSession
        changes = checkpointed(changes)
        names = checkpointed(changes.select(F.explode(F.array("path", "new_path")).alias("name")).where("name is not null").distinct())
        old = self.explicit.read(spark, version)
        gone = changes.where("op in ('rename', 'delete')").select(F.col("path").alias("name")).distinct()
        ends = old.select("owner", F.explode(F.array("src", "dst")).alias("name")).join(gone, "name", "left_semi").select(F.col("owner").alias("name"))
        owners = names.unionByName(ends).distinct().withColumnRenamed("name", "owner")
        touched = {r["b"] for r in owners.select(self.explicit.bucket().alias("b")).distinct().collect()}
        before = checkpointed(self.explicit.read(spark, version, touched))
        after = checkpointed(applied(before, changes, parse).where("not implied").select(*before.columns))
        self.explicit.write(after, version, touched)
        sign = lambda d, n: d.select(*EDGE_COLUMNS, F.lit(n).cast("long").alias("n"))
        delta = checkpointed(sign(after, 1).unionByName(sign(before, -1)).groupBy(*EDGE_COLUMNS).agg(F.sum("n").alias("n")).where("n <> 0"))
        added = checkpointed(ways(old, delta, list(self.rules)))
        hit = {r["b"] for r in added.select(self.support.bucket().alias("b")).distinct().collect()}
        total = self.support.read(spark, version, hit).unionByName(added).groupBy(*WAY).agg(F.sum("n").alias("n")).where("n > 0")
        self.support.write(total, version, hit)
        return touched, hit


def maintain_view(changes: DataFrame, view: EdgeView, parse: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A writer that applies each micro-batch to the view; version = batch + 1."""

    def step(batch: DataFrame, number: int) -> None:
        view.apply(batch, number, parse)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
