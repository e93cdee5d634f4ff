"""Toxicity by a weighted lexicon, found with Aho-Corasick in folded text.

Folding lower-cases, strips accents, maps letters of other scripts that look Latin and digits
and signs that stand for letters, and lets runs of one sign be a space. Lexicon words and
their weights are learned from labelled texts, as are exception phrases: two words of which
one is in the lexicon, seen in clean texts rather than in toxic ones, whose words then do not
count. The sum of weights, with and without normalisation by the text's length, goes through
a logistic curve fitted to the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapops.llm.common import thinned

#: Labelled texts drawn for each label, those with the smallest hash of their id.
SAMPLE = 3000
#: A lexicon word is in this share of the toxic sample at least, and as much likelier there.
SHARE, ODDS = 0.02, math.log(16)
LEXICON = 2000

# Letters that look alike, and signs used for letters. i, l, 1 and | are one letter.
_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ß": "b",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i",
}
_RUNS = re.compile(r"([^\w\s])\1+")
_ZERO = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


class _Folds(dict):
    """The fold of each code point, worked out when first met."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in base if not unicodedata.combining(c)).lower()
        out = "".join(_ALIKE.get(c, c) for c in base)
        out = "".join(c if c.isalnum() else " " for c in out)
        self[code] = out
        return out


_FOLDS = _Folds(_ZERO)


def folded(text: str) -> str:
    return _RUNS.sub(" ", text).translate(_FOLDS)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float, float]


def _machine(model: Model):
    machine = ahocorasick.Automaton()
    for word, weight in model.weights.items():
        machine.add_word(word, (len(word), weight))
    if model.weights:
        machine.make_automaton()
    return machine


def _phrases(text: str, start: int, end: int) -> tuple[str, str]:
    """The word at ``start`` to ``end`` with the word before it, and with the word after it."""
    before = text[max(0, start - 64) : start].split()
    after = text[end : end + 64].split()
    own = text[start:end]
    return f"{before[-1]} {own}" if before else "", f"{own} {after[0]}" if after else ""


def features(text: str, machine, exceptions: frozenset[str]) -> tuple[float, float, int]:
    """Log of one plus the weight found, the same by length, and the number of hits."""
    text = folded(text)
    total, hits = 0.0, 0
    if len(machine):
        for last, (n, weight) in machine.iter(text):
            start, end = last - n + 1, last + 1
            if (start and text[start - 1] != " ") or (end < len(text) and text[end] != " "):
                continue
            if exceptions and not exceptions.isdisjoint(_phrases(text, start, end)):
                continue
            total += weight
            hits += 1
    words = text.count(" ") + 1
    return math.log1p(total), math.log1p(100 * total / (words + 20)), hits


def _score(x: tuple[float, float, int], curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def drawn_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``sample`` labelled documents for each label; equal texts once.

    Labels that contradict each other count as toxic. The ids are drawn first and are few.
    """
    label = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = thinned(label, ["toxic"], ["doc_id"], sample).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample).select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most 2 * sample rows of two numbers
    return texts.where("text IS NOT NULL").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learned(sample: DataFrame) -> Model:
    """Lexicon, exceptions and curve from ``text, toxic``; the driver receives counts and features only."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marks = [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set(folded(text).split())
                found += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], ["word", "toxic"])

    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, frozenset(), (-3.0 if not bad else 3.0, 0.0, 0.0))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counted = sample.selectExpr("text", "cast(toxic AS int) AS toxic").mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    chosen = counted.where(F.col("bad") >= max(2, SHARE * bad)).withColumn("odds", odds).where((F.col("odds") >= ODDS) & (F.length("word") >= 3))
    weights = {r["word"]: r["odds"] for r in chosen.orderBy(F.desc("odds"), "word").limit(LEXICON).collect()}
    plain = Model(weights, frozenset(), (0.0, 0.0, 0.0))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(plain)
        for batch in batches:
            found, marks = [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text, own = folded(text), set()
                for last, (n, _) in machine.iter(text) if len(machine) else ():
                    start, end = last - n + 1, last + 1
                    if (not start or text[start - 1] == " ") and (end == len(text) or text[end] == " "):
                        own.update(p for p in _phrases(text, start, end) if p)
                found += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], ["phrase", "toxic"])

    seen = sample.selectExpr("text", "cast(toxic AS int) AS toxic").mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    clean = seen.where((F.col("good") >= 5) & (F.col("good") * bad >= 4 * F.col("bad") * good)).orderBy(F.desc("good"), "phrase").limit(LEXICON)
    exceptions = frozenset(r["phrase"] for r in clean.collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(plain)
        for batch in batches:
            x = [features(t, machine, exceptions)[:2] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("toxic").cast(pa.float64())], ["a", "b", "toxic"])

    points = np.array(sample.select("text", "toxic").mapInArrow(measure, "a double, b double, toxic double").collect(), dtype=float)
    return Model(weights, exceptions, _fitted(points[np.lexsort(points.T)]))


def _fitted(points: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method; both labels weigh the same."""
    x, y = np.column_stack([np.ones(len(points)), points[:, :2]]), points[:, 2]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-4, 1e-4])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, hits`` for each row.

    Defined cases: null is the empty text; texts without a hit have one common score; with no
    toxic or no clean example the score is the same for all; long texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column("text"):
                x = features(text.as_py() or "", machine, model.exceptions)
                scores.append(_score(x, model.curve))
                hits.append(x[2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, pa.int64())], ["doc_id", "score", "predicted", "hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, hits long")
