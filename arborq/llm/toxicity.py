"""Toxicity scores: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps look-alike letters, accents and digit substitutions to plain letters. The lexicon holds whole
words and stems (words that begin so). Its weights, and the exception phrases in which an entry is
harmless, are learned from labelled documents; a logistic curve turns the summed weight, normalised by
the number of words, into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import crc_of_id, table

# General insults that count even where no label shows them.
BASE_WORDS = (
    "idiot idiots moron morons imbecile imbeciles stupid dumbass loser losers scum scumbag trash pathetic worthless "
    "disgusting clown clowns filth vermin retard retards degenerate bastard bastards bitch bitches asshole assholes "
    "cunt slut whore faggot fuck fucker fucking motherfucker shithead bullshit dickhead douchebag twat wanker prick"
).split()
BASE_WEIGHT = 2.5
# Phrases in which an entry is harmless.
BASE_EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "loser bracket", "stupid simple")
# Letters of other scripts that look like Latin ones, and characters written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "i", "ɩ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ω": "w", "γ": "y", "ı": "i", "ø": "o", "ł": "i", "đ": "d", "ſ": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s",
    "7": "t", "8": "b", "9": "g", "|": "i", "l": "i",
}
INSIDE_WORDS = {"@": "a", "$": "s", "!": "i", "€": "e", "£": "i", "+": "t", "(": "c"}
HIDDEN = "​‌‍⁠﻿­"
STEM_LENGTHS = range(4, 9)
SHORTEST_WORD = 3
_INSIDE = re.compile("(?<=[^\\W_])[@$!€£+(](?=[^\\W_])")
_WORD = re.compile(r"[^\W_]+")


def _folds() -> dict[int, str | None]:
    """Accented Latin letters by their decomposition, full-width forms by their offset, then the fixed values."""
    folds: dict[int, str | None] = {}
    for c in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(c))[0].lower()
        if "a" <= plain <= "z":
            folds[c] = plain
    for c in range(0x21, 0x7F):
        folds[c + 0xFEE0] = chr(c).lower()
    for c, plain in list(folds.items()):
        folds[c] = LOOKALIKES.get(plain, plain)
    return folds | {ord(c): p for c, p in LOOKALIKES.items()} | dict.fromkeys(map(ord, HIDDEN))


FOLDS = _folds()


def fold(text: str) -> str:
    text = text.lower()
    if any(c in text for c in INSIDE_WORDS):
        text = _INSIDE.sub(lambda m: INSIDE_WORDS[m.group()], text)
    return text.translate(FOLDS)


@dataclass(frozen=True)
class ToxicityModel:
    """words and stems: weights by folded pattern; exceptions: folded phrases; curve: intercept and slopes."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, float]]] = {}
        for kind, patterns in (("word", self.words), ("stem", self.stems), ("not", dict.fromkeys(self.exceptions, 0.0))):
            for p, w in patterns.items():
                entries.setdefault(p, []).append((kind, w))
        for p, kinds in entries.items():
            found.add_word(p, (len(p), tuple(kinds)))
        if entries:
            found.make_automaton()
        return found


def matched(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Summed weight of the entries met at word bounds and not inside an exception phrase; the best of those that begin together."""
    if not len(automaton):
        return 0.0
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    n = len(folded)
    for last, (size, kinds) in automaton.iter(folded):
        first, end = last - size + 1, last + 1
        if first and folded[first - 1].isalnum():
            continue
        ends = end == n or not folded[end].isalnum()
        for kind, w in kinds:
            if kind == "not":
                if ends:
                    spared.append((first, end))
            elif (kind == "stem" or ends) and (first not in best or w > best[first][0]):
                best[first] = (w, end)
    if spared and best:
        spared.sort()
        starts, reach = [], []
        for a, b in spared:
            starts.append(a)
            reach.append(max(b, reach[-1] if reach else b))
        at = np.searchsorted(starts, list(best), "right") - 1
        best = {f: v for (f, v), i in zip(best.items(), at.tolist(), strict=True) if i < 0 or reach[i] < v[1]}
    return sum(w for w, _ in best.values())


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(1000.0 * total / (words + 20.0))])


def weigh_texts(texts: list[str | None], automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Summed weight and number of words of each text."""
    total = np.array([matched(fold(t), automaton) if t else 0.0 for t in texts])
    return total, np.array([t.count(" ") + t.count("\n") + 1 if t else 0 for t in texts], float)


def score_texts(texts: list[str | None], model: ToxicityModel, automaton: ahocorasick.Automaton | None = None) -> np.ndarray:
    total, words = weigh_texts(texts, automaton if automaton is not None else model.automaton())
    return 1.0 / (1.0 + np.exp(-_inputs(total, words) @ np.array(model.curve)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, max_rows: int) -> DataFrame:
    """(text, label) of labelled documents whose crc32 mod `parts` is not `held`: max_rows of them at most, by a hash."""
    bounded = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(parts)) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    joined = docs.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(parts)) != held).select("doc_id", "text").join(F.broadcast(bounded), "doc_id")
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), F.col("_label").alias("label"))


def _patterns(text: str) -> set[str]:
    found = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) >= SHORTEST_WORD:
            found.add(w)
        found.update(w[:n] + "*" for n in STEM_LENGTHS if n < len(w))
    return found


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label that hold each pattern, summed for some documents at a time."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        keys = list(sums[0].keys() | sums[1].keys())
        out = pd.DataFrame({"pattern": keys, "clean": [sums[0][k] for k in keys], "toxic": [sums[1][k] for k in keys]})
        for s in sums:
            s.clear()
        return out

    for batch in batches:
        for text, y in zip(batch["text"], batch["label"], strict=True):
            sums[int(y)].update(_patterns(text))
            if len(sums[0]) + len(sums[1]) > 300_000:
                yield flush()
    yield flush()


def _contexts(batches: Iterator[pd.DataFrame], candidates: frozenset[str]) -> Iterator[pd.DataFrame]:
    """Each candidate with the words beside it: near copies of a document share these, so that they count once."""
    for batch in batches:
        rows = set()
        for text, y in zip(batch["text"], batch["label"], strict=True):
            words = _WORD.findall(fold(text))
            for i, w in enumerate(words):
                for p in (w, *(w[:n] + "*" for n in STEM_LENGTHS if n < len(w))):
                    if p in candidates:
                        rows.add((p, words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else "", int(y)))
        yield pd.DataFrame(list(rows), columns=["pattern", "before", "word", "after", "label"])


def fit(sample: DataFrame, min_support: int = 6) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from a bounded (text, label) sample.

    Patterns are counted over distinct texts, then over distinct neighbouring words, so that copies and near
    copies of one toxic text do not make its other words into entries. Lexicon and exceptions are as large as the
    sample's patterns of enough support, which the bound of the sample bounds. Without labels of both kinds the
    base lexicon is used with a fixed curve.
    """
    base = {fold(w): BASE_WEIGHT for w in BASE_WORDS}
    exceptions = {fold(p) for p in BASE_EXCEPTIONS}
    texts = sample.dropDuplicates(["text", "label"])
    sizes = {int(r["label"]): int(r["count"]) for r in texts.groupBy("label").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return ToxicityModel(base, {}, tuple(sorted(exceptions)), (-3.0, 1.5, 0.3))
    ratio = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    ranked = (
        texts.mapInPandas(_counted, "pattern string, clean long, toxic long")
        .groupBy("pattern")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= min_support) & (ratio >= 8))
        .select("pattern")
    )
    candidates = frozenset(r["pattern"] for r in ranked.collect()) | {w for w in base}
    around = texts.mapInPandas(
        lambda batches: _contexts(batches, candidates), "pattern string, before string, word string, after string, label int"
    )
    counts = (
        around.groupBy("pattern")
        .agg(
            *(F.countDistinct(F.when(F.col("label") == y, F.xxhash64("before", "after"))).alias(n) for y, n in ((0, "clean"), (1, "toxic"))),
            F.countDistinct("word").alias("words"),
        )
        .collect()
    )
    seen = {r["pattern"]: (r["clean"], r["toxic"], r["words"]) for r in counts}
    weight = lambda clean, toxic: math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    order = sorted(seen, key=lambda p: (not p.endswith("*"), len(p), p))
    for p in order:
        clean, toxic, forms = seen[p]
        if toxic < min_support or weight(clean, toxic) < math.log(8):
            continue
        if any(p[:n] in stems for n in STEM_LENGTHS if n < len(p)):
            continue
        if p.endswith("*"):
            if forms >= 4:
                stems[p[:-1]] = weight(clean, toxic)
        else:
            words[p] = weight(clean, toxic)
    for p, w in base.items():
        clean, toxic, _ = seen.get(p, (0, 0, 0))
        if p not in words and not any(p.startswith(s) for s in stems) and clean <= toxic + 3:
            words[p] = w
    entries = sample.sparkSession.createDataFrame([(p,) for p in (*words, *(s + "*" for s in stems))], "pattern string")
    harmless = (
        around.join(F.broadcast(entries), "pattern")
        .select(F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase"), "before", "after", "label")
        .groupBy("phrase")
        .agg(F.countDistinct(F.when(F.col("label") == 0, F.xxhash64("before", "after"))).alias("clean"), F.max("label").alias("toxic"))
        .where((F.col("clean") >= 3) & (F.col("toxic") == 0) & F.col("phrase").contains(" "))
        .collect()
    )
    exceptions |= {r["phrase"].strip() for r in harmless if " " in r["phrase"].strip()}
    draft = ToxicityModel(words, stems, tuple(sorted(exceptions)), (0.0, 0.0, 0.0))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = draft.automaton()
        for batch in batches:
            total, n = weigh_texts(batch["text"].tolist(), automaton)
            yield pd.DataFrame({"total": total, "words": n, "label": batch["label"]})

    rows = texts.mapInPandas(weigh, "total double, words double, label int").toPandas()
    return ToxicityModel(words, stems, draft.exceptions, _curve(rows["total"].to_numpy(), rows["words"].to_numpy(), rows["label"].to_numpy()))


def _curve(total: np.ndarray, words: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are kept from falling below 0."""
    x = _inputs(total, words)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (y - p) - ridge * np.array([0.0, 1, 1]) * b
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.diag([1e-3, 1, 1]), gradient)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if b[2] < 0 or b[1] < 0:  # one slope alone, so that more weight never lowers a score
        b = np.array([b[0], max(b[1], 0.0), max(b[2], 0.0)])
    return tuple(float(v) for v in b)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row (a column of that name is replaced); null and empty texts hold no entry and get the curve's lowest score."""
    docs = docs.drop(out)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = score_texts(batch.column(at).to_pylist(), model, automaton)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


PARTS, HELD, MAX_TRAIN = 5, 0, 20_000


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> ToxicityModel:
    return fit(training_sample(docs, labels, "toxic", PARTS, HELD, max_rows))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (F.pmod(crc_of_id(F.col("doc_id")), F.lit(PARTS)) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
