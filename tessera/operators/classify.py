"""Model-backed classification of conversation text.

Two-step rule of the guard: ask for one token; exactly ``safe`` -> not
flagged; otherwise ask again (prompt + first token) for up to
``REASON_TOKENS`` tokens and keep that text as the reason.

* :func:`classify` runs any ``model_fn(prompts, max_tokens) -> list[str]`` in
  ``mapInPandas``, in batches of at most ``batch_size`` prompts.
* :func:`load_once` makes such a function of a loader: each Python worker loads the
  model when it gets its first batch and keeps it for all later tasks.
* :func:`train_toxicity_model` / :func:`ml_guard` give an offline default: a
  Spark ML pipeline (tokenize -> hashing TF -> IDF -> logistic regression)
  trained on labelled documents; fitting and scoring run in the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .moderation import category_policy

FIRST_TOKENS = 1
REASON_TOKENS = 15
SAFE = "safe"
BATCH_PROMPTS = 256


_LOADED: dict[str, Callable] = {}  # of this worker, by loader


def load_once(load: Callable[[], Callable], loads=None) -> Callable:
    """A model function that calls ``load() -> model_fn`` once in each Python worker.

    ``load`` runs on the workers (only it is shipped, not the model). ``loads``, an
    accumulator, counts the loads. Workers live on between tasks
    (``spark.python.worker.reuse``), so there are at most as many as the session has
    cores, and one more for each worker that was lost.
    """
    name = uuid.uuid4().hex

    def model(*args):
        from tessera.operators import classify as here  # the worker's own module holds what is loaded
        if name not in here._LOADED:
            here._LOADED[name] = load()
            if loads is not None:
                loads.add(1)
        return here._LOADED[name](*args)

    return model


def _in_batches(model_fn: Callable, prompts: list[str], size: int, *args) -> list:
    return [x for k in range(0, len(prompts), size) for x in model_fn(prompts[k:k + size], *args)]


def classify(df: DataFrame, model_fn: Callable[[list[str], int], list[str]], prompt_col: str = "prompt",
             key_cols: list[str] | None = None, batch_size: int = BATCH_PROMPTS) -> DataFrame:
    """``(keys…, first_token, flagged, reason)`` for every prompt row."""
    keys = key_cols or [c for c in df.columns if c != prompt_col]
    schema = T.StructType([*[df.schema[k] for k in keys],
                           T.StructField("first_token", T.StringType()),
                           T.StructField("flagged", T.BooleanType()),
                           T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").tolist()
            first = _in_batches(model_fn, prompts, batch_size, FIRST_TOKENS)
            flagged = [t != SAFE for t in first]
            reason = [None] * len(prompts)
            idx = [i for i, f in enumerate(flagged) if f]
            if idx:
                more = _in_batches(model_fn, [prompts[i] + first[i] for i in idx], batch_size, REASON_TOKENS)
                for i, r in zip(idx, more):
                    reason[i] = r
            out = pdf[keys].copy()
            out["first_token"], out["flagged"], out["reason"] = first, flagged, reason
            yield out

    return df.select(*keys, prompt_col).mapInPandas(run, schema)


RESULT_SCHEMA = "category string, rationale string"


def classify_structured(df: DataFrame, model_fn: Callable[[list[str]], list[str]], prompt_col: str = "prompt",
                        key_cols: list[str] | None = None, batch_size: int = BATCH_PROMPTS) -> DataFrame:
    """Prompt -> model -> ``{category, rationale}`` -> policy:
    ``(keys…, category, rationale, code, decision, error)``.

    ``model_fn(prompts) -> list[str]`` returns JSON texts (at most ``batch_size`` prompts a call).
    Output that is no JSON object, or lacks a field, and a category outside the
    list give an ``error`` and no decision; the other rows go on.
    """
    keys = key_cols or [c for c in df.columns if c != prompt_col]
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_out", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            out["_out"] = _in_batches(model_fn, pdf[prompt_col].fillna("").tolist(), batch_size)
            yield out

    parsed = (df.select(*keys, prompt_col).mapInPandas(run, schema)
              .withColumn("_r", F.from_json("_out", RESULT_SCHEMA))
              .select(*keys, F.col("_r.category").alias("category"), F.col("_r.rationale").alias("rationale")))
    missing = F.col("category").isNull() | F.col("rationale").isNull()
    judged = category_policy(parsed)
    error = (F.when(missing, "Invalid structured output")
             .when(F.col("code").isNull(), F.concat(F.lit("Unknown category: "), F.col("category"))))
    return judged.withColumn("error", error).withColumn("decision", F.when(error.isNull(), F.col("decision"))) \
        .select(*keys, "category", "rationale", "code", "decision", "error")


def train_toxicity_model(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic",
                         key: str = "doc_id", dim: int = 1 << 16, max_iter: int = 20):
    """Fit the default guard on ``docs ⋈ labels``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    train = docs.select(key, F.col(text_col).alias("_text")).join(
        labels.select(key, F.col(label_col).cast("double").alias("_label")), key)
    stages = [RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"[^\p{L}\p{N}]+"),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
              IDF(inputCol="_tf", outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter,
                                 probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")]
    return Pipeline(stages=stages).fit(train)


def ml_guard(model, text_col: str = "content", threshold: float = 0.5, reason: str = "S10"):
    """Wrap a fitted pipeline as a guard over ``text_col``: first token
    ``unsafe`` when P(toxic) >= threshold, reason ``reason``."""
    from pyspark.ml.functions import vector_to_array

    def score(df: DataFrame) -> DataFrame:
        s = model.transform(df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))))
        p = vector_to_array("_prob").getItem(1)
        unsafe = p >= threshold
        return (s.withColumn("p_toxic", p)
                .withColumn("first_token", F.when(unsafe, "unsafe").otherwise(SAFE))
                .withColumn("flagged", unsafe)
                .withColumn("reason", F.when(unsafe, F.lit(reason)))
                .drop("_text", "_tok", "_tf", "_features", "_raw", "_prob", "_pred"))
    return score
