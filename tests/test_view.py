"""The incremental view of implied edges against a full rebuild, and what it reads and writes."""

import os

import numpy as np
from pyspark.sql import functions as F

from arborq.operators.edges import EDGE_COLUMNS
from arborq.operators.implied import Rule, with_implied
from arborq.streaming import maintain, view

RULES = (Rule("up", "down", "reverse"), Rule("up", "same", "sibling"), Rule("next", "near", "both"), Rule("near", "far", "forward"), Rule("same", "kin", "sibling"))


def parse(notes):
    """Content `up:a,next:b` as edges of the note, in order."""
    each = notes.where("content <> ''").select(F.col("path").alias("owner"), F.posexplode(F.split("content", ",")).alias("ord", "t"))
    return each.select(
        F.col("owner").alias("src"), F.split_part("t", F.lit(":"), F.lit(2)).alias("dst"), F.split_part("t", F.lit(":"), F.lit(1)).alias("relation"), F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("implied"), F.lit(None).cast("string").alias("implied_from"), F.col("ord").cast("long"), "owner",
    )


def changes(spark, rows):
    return spark.createDataFrame([(seq, op, path, new, content, None) for seq, (op, path, new, content) in rows], maintain.CHANGES)


def rows_of(df):
    return sorted(map(str, df.select(*EDGE_COLUMNS).collect()))


def random_changes(rng, n):
    note = lambda: f"n{rng.integers(12)}"
    out = []
    for _ in range(n):
        op = str(rng.choice(["upsert"] * 6 + ["rename", "delete"]))
        content = ",".join(f"{rng.choice(['up', 'up', 'next', 'near', 'same'])}:{note()}" for _ in range(rng.integers(0, 4)))
        out.append((op, note(), f"m{rng.integers(1000)}" if op == "rename" else None, content if op == "upsert" else None))
    return out


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    rng = np.random.default_rng(11)
    live = view.EdgeView(str(tmp_path / "v"), RULES, buckets=8, spread=2, kept=2)
    full = spark.createDataFrame([], view.EDGES)
    seq = 0
    for version, size in enumerate((14, 5, 0, 6, 4)):
        rows = [(seq + i, c) for i, c in enumerate(random_changes(rng, size))]
        seq += size
        batch = changes(spark, rows)
        live.apply(batch, version, parse)
        full = spark.createDataFrame(maintain.applied(full, batch, parse).select(*full.columns).collect(), view.EDGES)
        want = with_implied(full, list(RULES))
        assert rows_of(live.read(spark, version + 1)) == rows_of(want)
    assert full.count() and live.support.read(spark, 5).where("n < 1").count() == 0
    # a batch done again gives the same version
    live.apply(changes(spark, [(seq, ("delete", "n3", None, None))]), 5, parse)
    once = rows_of(live.read(spark, 6))
    live.apply(changes(spark, [(seq, ("delete", "n3", None, None))]), 5, parse)
    assert rows_of(live.read(spark, 6)) == once and "n3" not in "".join(once)


def parts(folder, version):
    at = os.path.join(folder, "data", f"v={version}")
    return {d for d in os.listdir(at) if d.startswith("bucket=")} if os.path.isdir(at) else set()


def test_a_small_batch_writes_few_buckets(spark, tmp_path):
    live = view.EdgeView(str(tmp_path / "v"), RULES[:1], buckets=64)
    first = [(i, ("upsert", f"n{i}", None, f"up:n{i // 3}")) for i in range(300)]
    assert len(live.apply(changes(spark, first), 0, parse)[0]) >= 60
    touched, hit = live.apply(changes(spark, [(400, ("upsert", "n7", None, "up:n100")), (401, ("upsert", "n8", None, ""))]), 1, parse)
    assert len(touched) == 2 and len(hit) == 2 and len(parts(live.explicit.folder, 2)) <= 2
    got = {(r["src"], r["dst"]) for r in live.read(spark, 2).where("relation = 'down'").collect()}
    assert ("n100", "n7") in got and ("n2", "n7") not in got and ("n2", "n8") not in got and len(got) == 299


def test_old_versions_are_emptied_and_buckets_gathered(spark, tmp_path):
    live = view.EdgeView(str(tmp_path / "v"), RULES[:1], buckets=4, spread=2, kept=2)
    for n in range(6):
        live.apply(changes(spark, [(n, ("upsert", f"n{n}", None, "up:top"))]), n, parse)
    assert live.read(spark, 6).where("not implied").count() == 6 and live.read(spark, 5).where("not implied").count() == 5
    assert len(set(live.explicit.manifest(spark, 6).values())) <= 3 and not parts(live.explicit.folder, 1)


def test_stream_into_the_view(spark, tmp_path):
    live = view.EdgeView(str(tmp_path / "v"), RULES[:1], buckets=4)
    inbox = str(tmp_path / "in")
    for batch in ([(1, ("upsert", "a", None, "up:x"))], [(2, ("rename", "a", "b", None))]):
        changes(spark, batch).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(maintain.CHANGES).parquet(inbox)
        view.maintain_view(stream, live, parse, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["src"], r["dst"], r["relation"]) for r in live.read(spark, 2).collect()} == {("b", "x", "up"), ("x", "b", "down")}
