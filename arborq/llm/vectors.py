"""Near duplicates among embeddings: iterative quantisation and multi-index Hamming tables.

A rotation learned on a sample turns vectors into balanced binary codes. Each code is filed under each of
its substrings, whose width follows the number of rows, and looked up under every substring within a radius of
its own. Only ids and codes are filed. Of those that meet there, of one label and with whole codes that are near, the
original vectors are fetched and their cosine taken, in a block. Number of tables and radius are those that find all but
about one in fifty pairs at the threshold, which is tried on partners made for the sample. Blocks are matrices of bounded
size, so no pair is ever a row: a block gives each vector's number of links and a link to a representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import checkpointed, components, table

THRESHOLD = 0.93
MAX_FIT = 20_000
WIDTHS, MAX_PROBE = (8, 24), 2
RECALL = 0.98
PER_ROW = 256  # comparisons of codes that cost as much as sending one
BLOCK, VALUES = 16384, 1 << 20  # a part of a bucket has at most so many rows, and its vectors so many components


@dataclass(frozen=True)
class Quantiser:
    """mean and rotation (dimensions x bits): bit j is 1 where (v - mean) @ rotation[:, j] >= 0.

    `tables` substrings of `width` bits, looked up within `probe` bits; codes further apart than `radius` are no candidates.
    """

    mean: np.ndarray
    rotation: np.ndarray
    width: int
    tables: int
    probe: int
    radius: int

    def places(self) -> int:
        """The places that each code is sent to."""
        return self.tables * len(self.masks())

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of 0/1 bytes for each vector."""
        return ((x - self.mean) @ self.rotation >= 0).astype(np.uint8)

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """The number spelled by each of the substrings of each code."""
        cut = bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width)
        return cut.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def masks(self) -> np.ndarray:
        """What is to be flipped to reach every substring within the radius; 0 comes first."""
        return np.array([sum(1 << i for i in c) for k in range(self.probe + 1) for c in combinations(range(self.width), k)], np.int64)


def fit_rotation(sample: np.ndarray, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation: principal directions, then turns of nearest binary codes and nearest rotation to them."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    if len(sample) < 2:
        return np.zeros(d), rotation
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    projected = centred @ axes
    for _ in range(rounds):
        near = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(projected.T @ near)
        rotation = u @ vt
    return mean, axes @ rotation


def fit_quantiser(sample: np.ndarray, rows: int = 0, threshold: float = THRESHOLD, seed: int = 7) -> Quantiser:
    """Rotation, and the tables for labels of up to `rows` vectors.

    Each of some vectors of the sample gets a partner at the threshold in a random direction. Of the widths and radii
    by which RECALL of these pairs meet, with the fewest tables that do, the cheapest is taken: the places a code is
    sent to, times what it meets in each, which halves with each bit of width, and the parts that such a bucket is cut into.
    If none reaches RECALL, the one nearest to it.
    """
    d = sample.shape[1]
    mean, rotation = fit_rotation(sample, seed=seed)
    rng = np.random.default_rng(seed + 1)
    x = sample[:1000] if len(sample) >= 2 else _unit(rng.standard_normal((500, d)))
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * away / np.where(norm > 0, norm, 1.0)
    whole = Quantiser(mean, rotation, 1, d, 0, d)
    a, b = whole.codes(x), whole.codes(y)
    radius = min(d, math.ceil(np.quantile((a != b).sum(1), 0.999)) + 2)
    found = []
    for width in range(min(d, WIDTHS[0]), min(d, WIDTHS[1]) + 1):
        trial = Quantiser(mean, rotation, width, d // width, 0, radius)
        apart = np.bitwise_count(trial.substrings(a) ^ trial.substrings(b))
        for probe in range(MAX_PROBE + 1):
            met = np.logical_or.accumulate(apart <= probe, axis=1).mean(0)
            tables = int(np.argmax(met >= RECALL)) + 1 if met[-1] >= RECALL else d // width
            model = Quantiser(mean, rotation, width, tables, probe, radius)
            size = rows / 2.0**width
            meets = sum(math.comb(width, k) for k in range(probe + 1)) * tables * (max(1.0, size / block_rows(d)) + size / PER_ROW)
            found.append((max(0.0, RECALL - met[-1]), meets, width, probe, model))
    return min(found, key=lambda f: f[:4])[4]


def block_rows(d: int, block: int = BLOCK) -> int:
    """Rows of a part of a bucket of vectors of length d."""
    return max(1, min(block, VALUES // d))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is divided by its largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, r: np.ndarray, c: np.ndarray, step: int = 16384) -> np.ndarray:
    """The cosines of pairs of rows of length 1, each by the same sum whatever else is asked for."""
    parts = [np.einsum("ij,ij->i", x[r[i : i + step]], x[c[i : i + step]]) for i in range(0, len(r), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _near_codes(ids: np.ndarray, away: np.ndarray, side: np.ndarray | None, bucket: np.ndarray, bits: np.ndarray, model: Quantiser, t: int, step: int = 512) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Tiles (rows, rows, which pairs are candidates) of rows filed in table t, sorted by bucket.

    A row is a vector's own place or a look-up (away) of a substring near its own. Own places meet each other and the
    look-ups of vectors with a larger id, in the first table alone in which their substrings are within the radius, so
    that each pair counts once. side (0 or 1) tells the two parts of a cut bucket apart, of which only pairs across count.
    """
    n = len(ids)
    signs = bits.astype(np.float32) * 2 - 1
    sub = model.substrings(bits)
    for i in range(0, n, step):
        a = slice(i, min(n, i + step))
        for j in range(i, n, step):
            b = slice(j, min(n, j + step))
            if bucket[j] > bucket[a.stop - 1]:
                break
            near = (bits.shape[1] - signs[a] @ signs[b].T) <= 2 * model.radius + 0.5
            near &= bucket[a][:, None] == bucket[b][None, :]
            if side is not None:
                near &= side[a][:, None] != side[b][None, :]
            if i == j:
                near &= np.triu(np.ones(near.shape, bool), 1)
            if away.any():
                first, second, low = away[a][:, None], away[b][None, :], ids[a][:, None] < ids[b][None, :]
                near &= (~first & ~second) | (~first & second & low) | (first & ~second & (ids[a][:, None] > ids[b][None, :]))
            for u in range(t):
                if not near.any():
                    break
                near &= np.bitwise_count(sub[a, u][:, None] ^ sub[b, u][None, :]) > model.probe
            if near.any():
                yield a, b, near


def meeting(*args, **more) -> np.ndarray:
    """Which rows of _near_codes have a candidate."""
    met = np.zeros(len(args[0]), bool)
    for a, b, near in _near_codes(*args, **more):
        met[a] |= near.any(1)
        met[b] |= near.any(0)
    return met


def link_block(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, away: np.ndarray, side: np.ndarray | None, bucket: np.ndarray, bits: np.ndarray,
               model: Quantiser, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among the candidates of _near_codes with vectors x: each row's summed weight of partners, and a root of its links here."""
    n = len(ids)
    sums = np.zeros(n, np.int64)
    root = np.arange(n)
    for a, b, near in _near_codes(ids, away, side, bucket, bits, model, t):
        if near.sum() > near.size // 20:  # a product of matrices parts most; what is near the threshold is left to the sums below
            near &= x[a] @ x[b].T >= threshold - 1e-9
        r, c = np.nonzero(near)
        good = _cosines(x, a.start + r, b.start + c) >= threshold
        r, c = r[good] + a.start, c[good] + b.start
        if not len(r):
            continue
        sums += np.bincount(r, weight[c], n).astype(np.int64) + np.bincount(c, weight[r], n).astype(np.int64)
        root = _merged(root, r, c)
    return sums, ids[root]


def _merged(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Roots after the links r - c: the higher root of a link is hung on the lower one until nothing moves."""
    while True:
        p, q = root[r], root[c]
        apart = p != q
        if not apart.any():
            return root
        root = root.copy()
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def usable(vectors: DataFrame, vector: str) -> F.Column:
    x = F.col(vector)
    return (
        x.isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
        & F.exists(x, lambda v: v != 0)
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, max_fit: int = MAX_FIT, key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Vectors link if their labels are equal and not null and their cosine in double precision is at least
    `threshold`. Null, empty and zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal vectors of one label are one class from the start:
    they link with each other and share their links, without pairs between copies. Rows that repeat a key
    are one vector, the first by label and components, and each get its result; rows with a null key link with
    nothing and are kept. The quantisers, one for each length, are fitted on at most max_fit vectors, taken by a hash;
    every vector is indexed. A bucket of more than `block` rows (fewer for long vectors) is cut into parts, and each two parts
    meet in a group of their own, whatever share of the vectors the bucket holds. Codes meet first; vectors are then sent to
    the groups in which their codes have a candidate. An empty table gives an empty result.
    """
    every = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = every.where("id is not null").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    fine = rows.where(usable(rows, "v") & F.col("label").isNotNull()).withColumn("d", F.size("v"))
    classes = checkpointed(
        fine.groupBy("label", "d", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    members = fine.join(classes.withColumnRenamed("rep", "class"), ["label", "d", "v"]).select("id", "class", F.col("n").alias("copies"))
    counted = classes.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n"), F.sum("count").alias("all")).collect()
    largest = {r["d"]: r["n"] for r in counted}
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(max_fit).select("d", "v").toArrow()
    models: dict[int, Quantiser] = {}
    for d, rows_of_d in largest.items():
        part = sample.filter(pc.equal(sample["d"], d))["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        models[d] = fit_quantiser(_unit(part.reshape(-1, d).astype(np.float64)), rows_of_d, threshold)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.to_pandas()
            for d, part in f.groupby("d"):
                model = models[d]
                bits = model.codes(_unit(np.vstack(part["v"].to_list()).astype(np.float64)))
                sub = model.substrings(bits)
                packed = [p.tobytes() for p in np.packbits(bits, axis=1)]
                for t in range(model.tables):
                    for k, flip in enumerate(model.masks()):
                        yield pa.RecordBatch.from_pandas(
                            pd.DataFrame({
                                "label": part["label"], "d": part["d"], "t": t, "at": sub[:, t] ^ flip, "rep": part["rep"], "code": packed, "away": k > 0,
                            }), preserve_index=False,
                        )

    places = "label string, d int, t long, at long"
    filed = classes.select("label", "d", "rep", "v").mapInArrow(file, f"{places}, rep long, code binary, away boolean")
    place = ["label", "d", "t", "at"]
    limit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(VALUES) / F.col("d"))))
    sizes = (
        classes.select("label", "d", "rep", "v")
        .mapInArrow(_places(file), places)
        .groupBy(*place)
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > limit)
        .withColumn("parts", F.ceil(F.col("size") / limit).cast("int"))
        .drop("size")
    )
    packs = max(1, math.ceil(sum(r["all"] * models[r["d"]].places() / (2 * block_rows(r["d"], block)) for r in counted)))
    cut = filed.join(sizes, place, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    bucket = F.xxhash64(*place)
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = cut.withColumn("p", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["d", "parts", "cell", "lo", "hi"]
    dealt = dealt.select(
        *place, "rep", "code", "away", F.least("p", "other").alias("lo"), F.greatest("p", "other").alias("hi"),
        F.when(F.col("parts") == 1, F.pmod(bucket, F.lit(packs))).otherwise(bucket).alias("cell"), F.col("parts"),
        F.when(F.col("p") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )

    def tables_of(part: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, tuple]]:
        """The rows of each table of a group that hold more than one, and what _near_codes asks of them."""
        d = int(part["d"].iloc[0])
        part = part.assign(bucket=part.groupby(["label", "at"], sort=True).ngroup()).sort_values(["t", "bucket", "rep"], kind="stable")
        across = part["lo"].iloc[0] != part["hi"].iloc[0]
        for t, rows in part.groupby("t"):
            if len(rows) > 1:
                bits = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), axis=1)[:, :d]
                side = rows["side"].to_numpy() if across else None
                yield rows.drop(columns="bucket"), (rows["away"].to_numpy(), side, rows["bucket"].to_numpy(), bits, models[d], int(t))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        out = [rows[meeting(rows["rep"].to_numpy(), *asked)] for rows, asked in tables_of(part)]
        return pd.concat(out) if out else part.head(0)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, asked in tables_of(part):
            x = _unit(np.vstack(rows["v"].to_list()).astype(np.float64))
            found, root = link_block(rows["rep"].to_numpy(), x, rows["n"].to_numpy(), *asked, threshold)
            kept = found > 0
            out.append(pd.DataFrame({"rep": rows["rep"].to_numpy()[kept], "found": found[kept], "root": root[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "found": [], "root": []}).astype("int64")

    met = dealt.groupBy(*group).applyInPandas(meet, dealt.schema)
    fetched = met.join(classes.select("rep", "v", "n"), "rep")
    links = checkpointed(fetched.groupBy(*group).applyInPandas(link, "rep long, found long, root long"))
    found = links.groupBy("rep").agg(F.sum("found").alias("found"))
    joined = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("rep")
        .join(found, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("rep").alias("class"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = members.join(per_class, "class").select("id", (F.col("found") + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        every.select("id")
        .join(linked, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").cast("long").alias("component_id"),
            F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
        )
    )


def _places(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in file(batches):
            yield batch.select(["label", "d", "t", "at"])

    return run


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
