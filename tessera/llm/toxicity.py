"""Toxicity scores from a character n-gram linear classifier with naive Bayes features.

Features are how often hashed character n-grams occur in a text per thousand
characters, so that long texts don't gather weight by chance. Each is scaled by
the log ratio of its naive Bayes probabilities in toxic and other texts, and a
logistic regression is fitted on the scaled features (Wang and Manning, 2012).

A text is as toxic as its most toxic window, if not more toxic as a whole: windows of
bounded length overlap by half and cover the whole text, so clean text around a
passage does not dilute it. One regression is fitted on whole texts, another on the
highest window of each text under the fit before (multiple-instance learning), as
only texts have labels; the higher of the two probabilities counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, prepare, stored
from .langid import letters

SIZES = (3, 4, 5, 6)
#: Hash buckets of the n-grams, as a power of two.
HASH_BITS = 22
#: Labelled documents of each class that are learned from, features that are kept, at most.
SAMPLE_PER_CLASS, FEATURES = 4000, 20_000
THRESHOLD = 0.3
#: Characters of a window, and fits on windows after the one on whole texts.
WINDOW, ROUNDS = 256, 2
#: Regularisation of the fit on whole texts, and on windows.
WHOLE_REG, WINDOW_REG = 1e-4, 1e-2
#: Frequencies of shorter texts are taken as if they had so many characters.
LEAST_CHARS = 100
#: Characters that are taken at a time.
SLICE = 1 << 20


def _points(text: str) -> np.ndarray:
    """Code points in lower case between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _buckets(points: np.ndarray):
    """For each n-gram size: the bucket of the n-gram that starts at each position."""
    c = np.where(letters()[points], points, 32).astype(np.uint64)
    code, n = c, 1
    for size in SIZES:
        while n < size:
            code = code[:-1] * np.uint64(0x100000001B3) + c[n:]
            n += 1
        yield size, ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _slices(points: np.ndarray):
    """The buckets of a text, a slice at a time; each n-gram is in one slice."""
    for start in range(0, len(points), SLICE):
        for _, found in _buckets(points[start:start + SLICE + max(SIZES) - 1]):
            yield found[:SLICE]


def _scale(chars: int) -> float:
    return 1000 / max(chars, LEAST_CHARS)


def text_frequencies(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and their frequencies per thousand characters."""
    points = _points(text or "")
    found = [np.unique(x, return_counts=True) for x in _slices(points)]
    buckets, back = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([c for _, c in found]), minlength=len(buckets))
    return buckets, counts * _scale(len(points))


def window_frequencies(text: str | None, start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of the n-grams that start in one window of a text."""
    points = _points(text or "")[start:start + window + max(SIZES) - 1]
    found = np.concatenate([x[:window] for _, x in _buckets(points)])
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, counts * _scale(min(len(points), window))


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float
    window: int = 0  # characters of a window; 0 takes each text as one window

    def table(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out

    def scores(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        """Probability of the toxic class of each whole text: that of its highest window."""
        total, _ = self.highest(texts, table)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -700, 700)))

    def highest(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weighted sum of the highest window of each text, and where that window starts."""
        total, start = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            points = _points(text or "")
            if len(points) > SLICE:
                total[k], start[k] = self._top(self._long(points, table), len(points))
            else:
                group.append((k, points))
                size += len(points)
                if size > SLICE:
                    self._add(group, table, total, start)
                    group, size = [], 0
        self._add(group, table, total, start)
        return total, start

    def _step(self, chars: int) -> int:
        """Characters of a block; two blocks in a row are a window."""
        return self.window // 2 or chars

    def _long(self, points: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The weighted sums of the n-grams that start in each block of a text, a slice at a time."""
        step = self._step(len(points))
        sums = np.zeros(-(-len(points) // step))
        for first in range(0, len(points), SLICE):
            for _, found in _buckets(points[first:first + SLICE + max(SIZES) - 1]):
                value = table[found[:SLICE]]
                at = np.flatnonzero(value)
                np.add.at(sums, (first + at) // step, value[at].astype(np.float64))
        return sums

    def _add(self, group: list, table: np.ndarray, total: np.ndarray, start: np.ndarray) -> None:
        """Set the highest windows of several texts that are taken together."""
        if not group:
            return
        chars = np.array([len(p) for _, p in group])
        steps = np.array([self._step(n) for n in chars])
        ends, blocks = np.cumsum(chars), -(-chars // steps)
        first = np.cumsum(blocks) - blocks
        sums = np.zeros(blocks.sum())
        for size, found in _buckets(np.concatenate([p for _, p in group])):
            at = np.flatnonzero(table[found])
            row = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[row]
            at, row = at[inside], row[inside]
            block = first[row] + (at - (ends - chars)[row]) // steps[row]
            sums += np.bincount(block, weights=table[found[at]], minlength=len(sums))
        for (k, _), n, a, m in zip(group, chars, first, blocks, strict=True):
            total[k], start[k] = self._top(sums[a:a + m], n)

    def _top(self, sums: np.ndarray, chars: int) -> tuple[float, int]:
        if len(sums) == 1:
            return sums[0] * _scale(chars), 0
        step = self._step(chars)
        lengths = np.minimum(chars - np.arange(len(sums) - 1) * step, 2 * step)
        values = (sums[:-1] + sums[1:]) * 1000 / np.maximum(lengths, LEAST_CHARS)
        at = int(values.argmax())
        return values[at], at * step


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS, features: int = FEATURES,
          seed: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[Model]:
    """Fit on the labelled rows that may be learned from: a model of whole texts, one of windows.

    Each class takes its ``sample`` first documents in a pseudo-random order of
    ids, with their whole texts. A document that is labelled more than once has
    its highest label; null labels and null ids are left out. The driver gets
    ``features`` buckets. Without both classes there is one model without
    features, which scores the only class it knows (0 if none).
    """
    spark = prepare(docs.sparkSession)
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
              .groupBy("id").agg(F.max("label").alias("label")))
    # at most ``sample`` ids of either class, so small enough to broadcast
    taken = bounded_sample(marked, "label", "id", sample, seed).select("id", "label")
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(taken), "id").select("label", "text"))

    def sums(batches):
        total = np.zeros((2, 1 << HASH_BITS), dtype=np.float32)
        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                x, f = text_frequencies(text.as_py())
                total[label, x] += f
        at = np.flatnonzero(total.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            own = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(t[own].astype(np.float64)) for t in total)],
                                             ["bucket", "clean", "toxic"])

    rows = stored(texts, "toxicity")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return [Model(np.empty(0, np.int64), np.empty(0, np.float32), 700.0 if 1 in sizes else -700.0)]
    table = stored(rows.mapInArrow(sums, "bucket int, clean double, toxic double")
                   .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "frequencies")
    all_clean, all_toxic = table.agg(F.sum(F.col("clean") + 1), F.sum(F.col("toxic") + 1)).first()
    clean, toxic = F.col("clean") + 1, F.col("toxic") + 1
    ratio = F.log(toxic / F.lit(float(all_toxic))) - F.log(clean / F.lit(float(all_clean)))
    surprise = F.abs(ratio) / F.sqrt(1 / toxic + 1 / clean)
    top = (table.select("bucket", ratio.alias("ratio"), surprise.alias("z"))
           .orderBy(F.desc("z"), "bucket").limit(features).collect())
    chosen = sorted((r["bucket"], r["ratio"]) for r in top)
    buckets = np.array([b for b, _ in chosen], dtype=np.int64)
    ratios = np.array([r for _, r in chosen])
    shared = spark.sparkContext.broadcast((buckets, ratios))

    def features_of(found):
        own, r = shared.value
        x, f = found
        _, at, of = np.intersect1d(own, x, assume_unique=True, return_indices=True)
        return {"at": [at.astype(np.int32)], "value": [r[at] * f[of]]}

    def whole(batches):
        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                yield pa.RecordBatch.from_pydict({"label": [float(label)], **features_of(text_frequencies(text.as_py()))})

    def highest(known):
        def run(batches):
            model = replace(known.value, window=window)
            table = model.table()
            for b in batches:
                for label, text in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                    t = text.as_py()
                    start = int(model.highest([t], table)[1][0])
                    yield pa.RecordBatch.from_pydict(
                        {"label": [float(label)], **features_of(window_frequencies(t, start, model.window))})
        return run

    size, window = len(buckets), WINDOW
    vector = F.udf(lambda at, value: Vectors.sparse(size, at, value), VectorUDT())

    def fitted(picked, reg, window):
        scaled_rows = picked.select("label", vector("at", "value").alias("features"))
        fit = LogisticRegression(maxIter=60, regParam=reg, standardization=False).fit(scaled_rows)
        return Model(buckets, (fit.coefficients.toArray() * ratios).astype(np.float32), float(fit.intercept), window)

    schema = "label double, at array<int>, value array<double>"
    first = last = fitted(stored(rows.mapInArrow(whole, schema), "features"), WHOLE_REG, 0)
    picked = None
    for _ in range(ROUNDS):
        # windows of earlier rounds stay, so a clean window that was high once is not forgotten
        found = stored(rows.mapInArrow(highest(spark.sparkContext.broadcast(last)), schema), "windows")
        picked = found if picked is None else picked.union(found)
        last = fitted(picked, WINDOW_REG, window)
    return [first, last]


def score(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher if more likely toxic) of every row.
    Whole texts are scored, and the highest of the ``models`` counts; a null text counts as empty. Repeated rows get equal
    scores, and other columns are ignored. An empty table gives no rows; very long texts are scored a slice at a time."""
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(models)

    def run(batches):
        tables = [m.table() for m in known.value]
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = np.max([m.scores(texts, t) for m, t in zip(known.value, tables, strict=True)], axis=0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
