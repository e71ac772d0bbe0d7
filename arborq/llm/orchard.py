"""Clustering around integer centroids, each vector's nearest one found by Orchard search.

Every centroid has the list of the others by distance. A vector goes down the list of its nearest centroid so far; where a
nearer one turns up it changes to that one's list, from its head. Centroids once measured are marked and not measured
again. The search ends at the first entry that is strictly further from the list's owner than twice the vector is:
by the triangle inequality what follows is further from the vector than the owner, and ties have all been seen. All
distances are squared integers, so the bound is four times the square, and exact.

A round is one pass over the vectors: each task searches its batches and gives one sum for each centroid, which are added up
by cluster and component. Only the centroids (k x dimensions numbers) reach the driver and are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import fresh_name, table

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
EXACT_IN_DOUBLE = float(1 << 53)
STEP = 4096  # vectors searched at once


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: as doubles while all are exact there, else Python's integers, which stop at the ends of long."""
    with np.errstate(over="ignore"):
        y = np.floor(flat.astype(np.float64) * scale)
    if not y.size or np.abs(y).max() < EXACT_IN_DOUBLE:
        return y
    whole = [min(max(int(v), LONG_MIN), LONG_MAX) if np.isfinite(v) else (LONG_MAX if v > 0 else LONG_MIN) for v in y.ravel()]
    return np.array(whole, object).reshape(y.shape)


def _as_exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all squared distances are exact there, and otherwise as Python's integers."""
    far = 0.0
    for a in (x, c):
        if a.size:
            far = max(far, float(max(abs(a.max()), abs(a.min()))))
    if x.dtype != object and c.dtype != object and 16 * x.shape[1] * far * far < EXACT_IN_DOUBLE:
        return x, c
    return tuple(a if a.dtype == object else np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in (x, c))


@dataclass(frozen=True)
class Orchard:
    """k centroids (integers), and for each the others by distance, ties by number, with their squared distances."""

    centroids: np.ndarray
    lists: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Orchard:
        exact = np.array(centroids, object).reshape(len(centroids), -1 if centroids else 0)
        k = len(exact)
        lists, gaps = np.zeros((k, max(0, k - 1)), np.int64), np.zeros((k, max(0, k - 1)), object)
        for i in range(k):
            apart = ((exact - exact[i]) ** 2).sum(1)
            order = sorted((j for j in range(k) if j != i), key=lambda j: (apart[j], j))
            lists[i], gaps[i] = order, [apart[j] for j in order]
        small = exact.size == 0 or max(abs(exact.max()), abs(exact.min())) < EXACT_IN_DOUBLE
        return cls(exact.astype(np.float64) if small else exact, lists, gaps)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: the smaller number) and squared distance of each row, and how many distances were measured.

        All rows step at once: each has its current centroid and its place in that one's list.
        """
        x, c = _as_exact(x, self.centroids)
        gaps = self.gaps if x.dtype == object else self.gaps.astype(np.float64)
        n, k = len(x), len(c)
        best = np.zeros(n, np.int64)
        least = ((x - c[0]) ** 2).sum(1)
        at = np.zeros(n, np.int64)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        live, measured = np.arange(n if k > 1 else 0), n
        while len(live):
            owner, place = best[live], at[live]
            near = gaps[owner, place] <= 4 * least[live]  # strictly beyond twice the distance: done
            live, owner, place = live[near], owner[near], place[near]
            other = self.lists[owner, place]
            at[live] += 1
            new = ~seen[live, other]
            rows, cand = live[new], other[new]
            seen[rows, cand] = True
            measured += len(rows)
            apart = ((x[rows] - c[cand]) ** 2).sum(1)
            won = (apart < least[rows]) | ((apart == least[rows]) & (cand < best[rows]))
            rows = rows[won]
            best[rows], least[rows], at[rows] = cand[won], apart[won], 0
            live = live[at[live] < k - 1]
        return best, least, measured


def usable(vector: Column, dimensions: int) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dimensions) & fine


def _matrices(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """A list column in steps of at most STEP rows: (first row, integers)."""
    for i in range(0, len(column), STEP):
        part = column.slice(i, STEP)
        yield i, integers(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1), scale)


def _totals(vectors: DataFrame, model: Orchard, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each cluster its count, its summed distance and its summed components: one row for each task and centroid, added up in Spark."""
    k, d = model.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, sums = [0] * k, [0] * k, np.zeros((k, d), object)
        for batch in batches:
            for _, x in _matrices(batch.column(0), scale):
                best, least, _ = model.nearest(x)
                for c in np.unique(best):
                    mine = best == c
                    small = x.dtype != object and float(np.abs(x[mine]).max()) * STEP < EXACT_IN_DOUBLE
                    part = x[mine].sum(0) if small else np.array([[int(v) for v in row] for row in x[mine]], object).sum(0)
                    count[c] += int(mine.sum())
                    far[c] += sum(min(int(v), LONG_MAX) for v in least[mine])
                    sums[c] += np.array([int(v) for v in part], object)
        used = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(used, pa.int32()), "n": pa.array([count[c] for c in used], pa.int64()), "far": pa.array([str(far[c]) for c in used], pa.string()),
            "sums": pa.array([[str(v) for v in sums[c]] for c in used], pa.list_(pa.string())),
        })

    whole = "decimal(38,0)"
    parts = vectors.mapInArrow(run, "cluster int, n long, far string, sums array<string>")
    each = parts.select("cluster", "n", F.col("far").cast(whole).alias("far"), F.posexplode("sums").alias("at", "part"))
    added = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum(F.col("part").cast(whole)).alias("part"))
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in sorted(added.collect(), key=lambda r: (r["cluster"], r["at"])):  # k x dimensions rows
        out.setdefault(r["cluster"], (r["n"], int(r["far"]), []))[2].append(int(r["part"]))
    return out


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The kept rows of vectors with cluster, distance, cluster_inertia, inertia and centroid, in place of columns of these names.

    Kept are vectors of `dimensions` components, none null or not finite; each component x is floor(scale * x). The
    first centroids are the k kept vectors with the least SHA-256 of `seed:key` (a null key is written as nothing),
    equal keys by components. Each round gives every vector to its nearest centroid (squared distance; ties: smaller
    number) and moves every centroid to the floor of its vectors' mean; one without vectors stays. Then all are given
    once more. Repeated rows and keys are vectors each, and count each. Fewer than k vectors make as many centroids;
    an empty table, or one without a kept vector, gives no rows. Components, distances and sums beyond the
    range of long stop at its ends.
    """
    made = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    v = F.col(f"`{vector}`")
    kept = vectors.where(usable(v, dimensions))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(order.alias("h"), v.cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    bare = kept.select(v.alias("v"))
    centroids = [[int(c) for c in integers(np.array(r["v"]), scale)] for r in first]
    for _ in range(rounds if centroids else 0):
        for c, (n, _, sums) in _totals(bare, Orchard.of(centroids), scale).items():
            centroids[c] = [s // n for s in sums]
    model = Orchard.of(centroids)
    ends = _totals(bare, model, scale) if centroids else {}
    within = [min(ends[c][1], LONG_MAX) if c in ends else 0 for c in range(len(centroids))]
    total = min(sum(e[1] for e in ends.values()), LONG_MAX)
    rest = [c for c in kept.columns if c.lower() not in made]
    row = fresh_name(kept, "row")
    packed = kept.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias(row), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _matrices(batch.column(1), scale):
                best, least, _ = model.nearest(x)
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column(0).slice(i, len(x)), "cluster": pa.array(best, pa.int32()), "distance": pa.array([min(int(y), LONG_MAX) for y in least], pa.int64()),
                    "cluster_inertia": pa.array([within[c] for c in best], pa.int64()), "inertia": pa.array([total] * len(x), pa.int64()),
                    "centroid": pa.array([centroids[c] for c in best], pa.list_(pa.int64())),
                })

    kind = packed.schema[row].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>").select("row.*", *made)


def op12_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")).cast("binary"), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql(rounds: int = 10) -> str:
    """Each round as tables of the centroids' and the vectors' components; plain distances to all centroids."""
    away = """SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM parts x JOIN {c} c ON c.i = x.i GROUP BY 1, 2"""
    given = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM ({away}) GROUP BY r"
    steps = []
    for n in range(rounds):
        steps.append(f"""g{n} AS MATERIALIZED ({given.format(away=away.format(c=f"c{n}"))}),
c{n + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (
    SELECT g.c, x.i, CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM parts x JOIN g{n} g ON g.r = x.r GROUP BY 1, 2
  ) m ON m.c = o.c AND m.i = o.i)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS r, vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) t(i)),
c0 AS MATERIALIZED (SELECT r AS c, i, x FROM parts WHERE r < 8),
{", ".join(steps)},
last AS MATERIALIZED ({given.format(away=away.format(c=f"c{rounds}"))}),
names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT k.vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(l.d AS BIGINT) AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(l.d) OVER () AS BIGINT) AS inertia, n.centroid_sha256
FROM last l JOIN kept k ON k.r = l.r JOIN names n ON n.c = l.c
"""


OP12_SQL = _sql()
