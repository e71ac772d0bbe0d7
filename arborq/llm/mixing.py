"""Mixing sources to target weights by Pfair scheduling.

In the ideal mix every source that has rows left is served at once, in proportion to its weight; what a source
has received by slot t is a fraction. The j-th block (from 0) of a source is released in the slot in which the ideal
begins it and due by the end of the slot in which the ideal ends it. Serving the released block of the earliest deadline in
each slot keeps every source within one block of the ideal at all times, also while others run out, as the ideal then gives
their share to the rest. Weights are exact fractions, however many sources there are.

A block is a run of rows of one source, as many that there are MAX_BLOCKS at most, one row in tables of up to as many rows. The
order of the blocks is worked out in one task, whose work is bounded by that; the rows are ranked and joined to it in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import accumulate
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import gapless_rank, table

#: Bound of the driver's state: a name, a weight and a count for each source.
MAX_SOURCES = 200_000
MAX_BLOCKS = 1_000_000
REST = "*"


@dataclass(frozen=True)
class Ideal:
    """Sources with whole-number weights and row counts, in the order in which they run out; slots begin at `start`."""

    names: list[str]
    weights: list[int]
    counts: list[int]
    start: int = 0
    gone: list[int] = field(init=False)  # rows of the sources that have run out, and the weight of the others, by phase
    rest: list[int] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "gone", list(accumulate(self.counts, initial=0)))
        object.__setattr__(self, "rest", list(accumulate(reversed(self.weights), initial=0))[::-1])

    @staticmethod
    def of(weights: dict[str, Fraction], counts: dict[str, int], start: int = 0) -> Ideal:
        scale = lcm(*(weights[s].denominator for s in counts))
        whole = {s: int(weights[s] * scale) for s in counts}
        order = sorted(counts, key=lambda s: (Fraction(counts[s], whole[s]), s))
        return Ideal(order, [whole[s] for s in order], [counts[s] for s in order], start)

    @property
    def slots(self) -> int:
        return self.gone[-1]

    def slot_of(self, source: int, block: int, phase: int) -> tuple[int, int, int]:
        """The slots, rounded down and up, by which the ideal has given a source `block` blocks; and the phase, searched from one on."""
        w = self.weights[source]
        while phase < source and block * self.weights[phase] >= self.counts[phase] * w:
            phase += 1
        whole, part = divmod(block * self.rest[phase], w)
        return self.gone[phase] + whole, self.gone[phase] + whole + (part > 0), phase

    def served(self) -> Iterator[tuple[str, int, int, int, int, int]]:
        """(source, block, phase, slot, release, deadline) of every block, in the order of the slots."""
        phases = [0] * len(self.names)
        waiting: list[tuple[int, int, int, int]] = []  # (release, source, block, deadline)
        ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block, release)

        def wait(i: int, block: int) -> None:
            release, _, phases[i] = self.slot_of(i, block, phases[i])
            heapq.heappush(waiting, (release, i, block, self.slot_of(i, block + 1, phases[i])[1]))

        for i in range(len(self.names)):
            wait(i, 0)
        for slot in range(self.slots):
            while waiting and waiting[0][0] <= slot:
                release, i, block, deadline = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, i, block, release))
            deadline, i, block, release = heapq.heappop(ready)
            yield self.names[i], block, phases[i], self.start + slot, self.start + release, self.start + deadline
            if block + 1 < self.counts[i]:
                wait(i, block + 1)


def ideals(weights: dict[str, Fraction], counts: dict[str, int]) -> list[Ideal]:
    """The mix of the sources with a weight, then, with equal shares, of those whose weight is 0: no row is dropped."""
    found, start = [], 0
    for share in ({s: weights[s] for s in counts if weights[s] > 0}, {s: Fraction(1) for s in counts if weights[s] <= 0}):
        if share:
            found.append(Ideal.of(share, {s: counts[s] for s in share}, start))
            start += found[-1].slots
    return found


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> dict[str, float]:
    """Target shares that grow as a power of the sources' row counts; null sources are the pool `*`. MAX_SOURCES at most."""
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit(REST)).alias("s")).count()
    return {r["s"]: float(r["count"]) ** power for r in _bounded(counts)}


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return found


def schedule(spark: SparkSession, plan: list[Ideal], counts: dict[str, int], size: int) -> DataFrame:
    """(pool, block, phase, turn, first, release, deadline) of every block of `size` rows: its turn in the order, and its first row's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        first = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(7)], ["pool", "block", "phase", "turn", "release", "deadline", "first"])

        for _ in batches:
            for ideal in plan:
                for row in ideal.served():
                    rows.append((*row, first))
                    first += min(size, counts[row[0]] - row[1] * size)
                    if len(rows) == 50_000:
                        yield out()
                        rows.clear()
            yield out()
            rows.clear()

    return spark.range(0, 1, 1, 1).mapInArrow(run, "pool string, block long, phase long, turn long, release long, deadline long, first long")


def mix(docs: DataFrame, targets: dict[str, float], key: str = "doc_id", source: str = "source", text: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Every row of docs, as the struct `row`, with pool, rank (in the pool), phase, slot (gapless from 0), turn, release and deadline.

    targets gives the weight of each source, taken as the exact fraction it is (only ratios count); sources that are
    null or not listed share the pool `*`, with the least listed weight unless it is listed. A weight of 0 is served after
    all others. A block is one row, or in tables of more than max_blocks rows as many as make so few blocks. Ranks follow a hash of the key and text, so repeated rows get ranks of their own and a
    null key is a key like others. An empty table gives an empty result. turn is the block's place
    in the order (the slot, if blocks are rows), and release <= turn < deadline, the window that the ideal mix gives the block; phase counts the sources that have run out in the ideal. Driver state: a weight
    and a count for each source, MAX_SOURCES at most.
    """
    shares = {s: Fraction(w) for s, w in targets.items()}
    shares.setdefault(REST, min(shares.values(), default=Fraction(1)))
    spark = docs.sparkSession
    name = F.col(source).cast("string")
    listed = F.broadcast(spark.createDataFrame([(s,) for s in shares], "_pool string"))
    pooled = docs.select(F.struct(*docs.columns).alias("row"), name.alias("_name"), F.xxhash64(F.col(key), F.col(text)).alias("_tie"), F.col(key).alias("_key"))
    pooled = pooled.join(listed, F.col("_name") == F.col("_pool"), "left").withColumn("_pool", F.coalesce("_pool", F.lit(REST))).drop("_name")
    counts = {r["_pool"]: r["count"] for r in _bounded(pooled.groupBy("_pool").count())}
    if not counts:
        none = F.lit(None).cast("long")
        return pooled.select("row", F.col("_pool").alias("pool"), *(none.alias(c) for c in ("rank", "phase", "slot", "turn", "release", "deadline")))
    ranked = gapless_rank(pooled, ["_pool"], ["_tie", "_key"], "_rank", buckets=max(1, min(1024, 65_536 // len(counts))), spread=["_tie"])
    size = max(1, -(-sum(counts.values()) // max(1, max_blocks)))
    plan = ideals(shares, {s: -(-n // size) for s, n in counts.items()})
    placed = schedule(spark, plan, counts, size).withColumnsRenamed({"pool": "_p", "block": "_b"})
    block = F.floor(F.col("_rank") / size) if size > 1 else F.col("_rank")
    both = ranked.withColumn("_block", block).join(placed.hint("merge"), (F.col("_pool") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return both.select(
        "row", F.col("_pool").alias("pool"), F.col("_rank").alias("rank"), "phase", (F.col("first") + F.col("_rank") - F.col("_block") * size).alias("slot"), "turn", "release", "deadline"
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in slot order: part files of consecutive slots, each sorted. Slots are gapless, so parts are even."""
    return mixed.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("text"))
    return mix(keyed, tempered_weights(docs)).select(
        "row.doc_id", "row.source", "pool", F.col("rank").alias("pool_rank"), "phase", "slot", "release", "deadline"
    )
