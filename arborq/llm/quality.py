"""Quality scores: a generalised additive model with pairwise interactions.

Features of the whole text are put into quantile bins. Cyclic boosting visits the features in turn and fits
a shallow tree on one feature's bins to the current gradient; all trees of a feature add up to one lookup
table. The pairs that still explain most get two-way tables in the same manner. A score is a sum of
table entries through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import crc_of_id, table
from arborq.llm.toxicity import training_sample

FEATURES = (
    "log_chars", "log_words", "word_mean", "word_spread", "word_longest", "words_short", "words_distinct", "word_top",
    "words_repeated", "letters_upper", "digits", "spaces", "stops", "marks", "bangs", "bars", "symbols", "brackets", "bytes_high",
    "entropy", "log_lines", "line_mean", "lines_distinct", "lines_short", "lines_stopped", "words_upper", "words_marked",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \n\t\r", "stop": b".?", "mark": b",;:'\"-", "bang": b"!",
    "bar": b"|", "symbol": b"#$%&*@^~=+<>\\/_`", "bracket": b"()[]{}",
}


def _shares() -> np.ndarray:
    found = np.zeros((256, len(_CLASSES) + 1))
    for i, chars in enumerate(_CLASSES.values()):
        found[list(chars), i] = 1
    found[128:, -1] = 1
    return found


SHARES = _shares()


def features(text: str) -> list[float]:
    """The values named in FEATURES; a text without words has zeros in all that need words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    counts = np.bincount(raw, minlength=256)
    upper, digit, space, stop, mark, bang, bar, symbol, bracket, high = (counts @ SHARES / n).tolist()
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) if len(p) else 0.0
    words, lines = text.split(), text.split("\n")
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counted = Counter(words)
    line_set = set(lines)
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(int(lengths.max())), float((lengths <= 2).mean()),
        len(counted) / k, max(counted.values(), default=0) / k, sum(map(str.__eq__, words, words[1:])) / k,
        upper, digit, space, stop, mark, bang, bar, symbol, bracket, high, entropy,
        np.log1p(len(lines)), np.log1p(len(text) / len(lines)), len(line_set) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        sum(x.endswith((".", "?", "!")) for x in lines) / len(lines), sum(map(str.isupper, words)) / k,
        sum(not w[-1].isalnum() for w in words) / k,
    ]


@dataclass(frozen=True)
class QualityModel:
    """edges: inner bin bounds by feature; tables: one entry a bin; pairs: (i, j, two-way table)."""

    bias: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for i, j, t in self.pairs:
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(self.bins(x))))


def _cut(g: np.ndarray, h: np.ndarray, a: int, b: int, ridge: float) -> tuple[float, int]:
    """Best split of bins a to b - 1: its gain and the first bin of the right side (0: none)."""
    if b - a < 2:
        return 0.0, 0
    gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
    gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
    i = int(gain.argmax())
    return (float(gain[i]), a + i + 1) if gain[i] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """A Newton step by bin from a tree of the given depth on one feature's bins."""
    parts = [(0, len(g))]
    for _ in range(depth):
        cuts = [(a, _cut(g, h, a, b, ridge)[1], b) for a, b in parts]
        parts = [q for a, c, b in cuts for q in (((a, c), (c, b)) if c else ((a, b),))]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A step by cell: the best first cut on one axis, then each side's best cut on the other; and its gain."""
    best, step = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        _, c = _cut(gg.sum(1), hh.sum(1), 0, len(gg), ridge)
        trial, gain = np.zeros_like(gg), 0.0
        for a, b in ((0, c), (c, len(gg))) if c else ((0, len(gg)),):
            side_g, side_h = gg[a:b].sum(0), hh[a:b].sum(0)
            _, d = _cut(side_g, side_h, 0, len(side_g), ridge)
            for e, f in ((0, d), (d, len(side_g))) if d else ((0, len(side_g)),):
                s, t = side_g[e:f].sum(), side_h[e:f].sum() + ridge
                trial[a:b, e:f] = s / t
                gain += s * s / t
        if gain > best:
            best, step = gain, trial.T if flip else trial
    return best, step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 120, rate: float = 0.15, ridge: float = 4.0, pairs: int = 8) -> QualityModel:
    """Fit on a bounded sample: main tables first, then the tables of the `pairs` most telling pairs.

    Without rows of both labels the tables stay empty and the score is the label's smoothed share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    edges = tuple(np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(len(FEATURES)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    blank = QualityModel(bias, edges, tuple(tables), ())
    if not len(y) or y.min() == y.max():
        return blank
    at = blank.bins(x)
    f = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, t in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, i], g, len(t)), np.bincount(at[:, i], h, len(t)), ridge)
            t += step
            f += step[at[:, i]]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(tables[i]), len(tables[j]))
        cell = at[:, i] * shape[1] + at[:, j]
        size = shape[0] * shape[1]
        return np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    g, h = slopes()
    gains = sorted(((-_pair_tree(*grid(i, j, g, h), ridge)[0], i, j) for i, j in combinations(range(len(tables)), 2)))[:pairs]
    two_way = [(i, j, np.zeros((len(tables[i]), len(tables[j])))) for _, i, j in gains]
    for _ in range(rounds // 3):
        for i, j, t in two_way:
            g, h = slopes()
            step = rate * _pair_tree(*grid(i, j, g, h), ridge)[1]
            t += step
            f += step[at[:, i], at[:, j]]
    return QualityModel(bias, edges, tuple(tables), tuple(two_way))


def _featured(batch: pa.RecordBatch, at: int) -> np.ndarray:
    texts = batch.column(at).to_pylist()
    return np.array([features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row (a column of that name is replaced); null texts count as empty, whose features are zeros."""
    docs = docs.drop(out)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.score(_featured(batch, at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


PARTS, HELD, MAX_TRAIN, ACCEPT = 4, 2, 20_000, 0.7


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> QualityModel:
    """Fit on at most max_rows labelled documents of the learning folds; their features alone reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _featured(batch, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    sample = training_sample(docs, labels, "quality", PARTS, HELD, max_rows)
    rows = sample.mapInArrow(run, "x array<double>, label int").toPandas()
    x = np.vstack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["label"].to_numpy().astype(float))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.pmod(crc_of_id(F.col("doc_id")), F.lit(PARTS)) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
