"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams (one to three characters
within a word, the word's ends marked by a space) in order of frequency. A
document is ranked the same way and gets the language whose profile has the
least out-of-place distance: the sum of rank differences over the document's
n-grams, one absent from the profile counting as the profile's length
(Cavnar and Trenkle, 1994).
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out, prepare

#: n-grams of a profile.
PROFILE = 300
#: Documents that each language's profile is learned from, at most.
SAMPLE_PER_LANGUAGE = 2000
#: A text with a lower score is unlike every language that was learned.
LEAST_SCORE = 0.2
#: Characters taken at a time, so that a very long text needs bounded memory.
SLICE = 1 << 20
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _sorted_counts(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    counts = np.diff(first, append=len(codes)) if weights is None else \
        np.add.reduceat(weights, first) if len(first) else weights
    return codes[first], counts


def _slice_grams(points: np.ndarray) -> np.ndarray:
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a word
    if not keep.any():
        return np.empty(0, np.uint64)
    run = np.where(letter, points, 32)[keep].astype(np.uint64)
    run = np.concatenate([[np.uint64(32)], run, [np.uint64(32)]][: 3 if run[-1] != 32 else 2])
    two = run[:-1] << np.uint64(21) | run[1:]
    three = two[:-1] << np.uint64(21) | run[2:]
    return np.concatenate([run[run != 32], two, three[run[1:-1] != 32]])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, as sorted codes, and their counts."""
    codes, counts, start = [], [], 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and text[end].isalpha():  # no word is cut
            end += 1
        part = text[start:end].lower().encode("utf-32-le", "surrogatepass")
        c, n = _sorted_counts(_slice_grams(np.frombuffer(part, dtype="<u4")))
        codes.append(c)
        counts.append(n)
        start = end
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _sorted_counts(np.concatenate(codes), np.concatenate(counts))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes; equally frequent ones in order of code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Profiles of all languages as one sorted table of codes by languages' ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int32)
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], dtype=np.uint64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score. The score is one less the best distance's share of
        the largest one possible; ties go to the first language by name."""
        grams = ranked(*gram_counts(text), self.size) if text else ()
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, grams)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == grams, at, len(self.codes))
        ranks = self.ranks[at]
        away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(grams))[:, None]), self.size).sum(axis=0)
        best = int(away.argmin())
        return self.names[best], 1 - float(away[best]) / (self.size * len(grams))


def learn(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE, seed: int = 10,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from rows that may be learned from and have a language.

    Each language takes its ``sample`` first documents in a pseudo-random order
    of ids, with their whole texts. The driver gets ``size`` n-grams for each language.
    An empty table, or one without languages, gives no profiles.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(F.col("lang").isNotNull() & ~held_out("id"))
    # at most ``sample`` ids of each language, so small enough to broadcast
    drawn = (bounded_sample(own.select("lang", "id"), "lang", "id", sample, seed)
             .select(F.col("lang").alias("_lang"), F.col("id").alias("_id")).distinct())
    taken = own.join(F.broadcast(drawn), (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id")),
                     "left_semi").select("lang", "text")

    def count(batches):
        held: dict[str, list] = {}
        kept = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(c := gram_counts(text))
                    kept += len(c[0])
            if kept > 1 << 21:
                yield from _emit(held)
                held, kept = {}, 0
        yield from _emit(held)

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = (taken.mapInArrow(count, "lang string, code long, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n"))
            .withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= size).collect())
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return Profiles(profiles, size)


def _emit(held: dict[str, list]):
    for lang, found in held.items():
        codes, n = _sorted_counts(np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
            ["lang", "code", "n"])


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row of ``docs``.

    A null text and one without letters get ``und`` and score 0, as every text
    does when no language was learned. All other columns pass through as they
    are; columns that have the two result names are replaced. An empty table gives
    no rows; the n-grams of a very long text are counted whole.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop(lang_out, score_out)
    known = spark.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            found = [known.value.predict(t.as_py()) for t in b.column(at)]
            yield (b.append_column(lang_out, pa.array([f[0] for f in found], pa.string()))
                   .append_column(score_out, pa.array([f[1] for f in found], pa.float64())))

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()),
                           T.StructField(score_out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language with at least this score.
    Rejected are null texts, texts without letters, and texts unlike all languages."""
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            found = (known.value.predict(t.as_py()) for t in b.column(at))
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the learnable rows of ``docs`` and predict every row."""
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
