"""Quality classifier: supervised subword embeddings.

Every white-space token of a text, in its own case, stands for hashed features: the token itself, its character n-grams
between boundary marks, and, when it repeats the token before, the word bigram of a token and itself. Each feature has a learned vector; a document is the average of its features' vectors,
followed by a softmax layer. Both are learned together by numpy stochastic gradient descent on a bounded sample of labelled
documents (`sample_rows`, 3000 by default); the model is two small arrays whose size does not depend on the data.

As the output layer is linear, a token's share of the two logits is one pair of numbers; tasks keep them per distinct token.

Defined results: null and empty texts average nothing and get the score that the output bias alone gives; a training sample
with one class or none gives the smoothed share of label 1 to every text; repeated rows are scored independently; an empty
table gives an empty table; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct tokens that a task remembers at once.
CACHE_TOKENS = 300_000


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 3000
    buckets: int = 1 << 17
    dim: int = 8
    ngrams: tuple[int, ...] = (2, 3)
    steps: int = 12_000  # at least four passes over the sample
    rate: float = 0.1
    seed: int = 7
    repeat_weight: int = 16  # features that a token stands for when it repeats the one before

    @property
    def repeated(self) -> int:
        """The bucket of the word bigram "a token and itself"."""
        return crc32(b"<=> <=>") % self.buckets


def features(token: str, buckets: int, ngrams: tuple[int, ...]) -> list[int]:
    """Hashed features of one token: the token and its n-grams between boundary marks."""
    marked = f"<{token}>".encode("utf-8", "surrogatepass")
    return [crc32(marked) % buckets] + [crc32(marked[i : i + n], n) % buckets for n in ngrams for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray  # buckets x dim
    out: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def weights(self) -> np.ndarray:
        """Each feature's logit of label 1 less that of label 0."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0])


def _sparse(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and their shares of all its features."""
    known: dict[str, list[int]] = {}
    rows = []
    for text in texts:
        all_features: list[int] = []
        last = None
        for token in text.split():
            if (f := known.get(token)) is None:
                f = known[token] = features(token, s.buckets, s.ngrams)
            all_features += f
            if token == last:
                all_features += [s.repeated] * s.repeat_weight
            last = token
        ids, n = np.unique(np.array(all_features, np.int64), return_counts=True)
        rows.append((ids, (n / max(1, len(all_features))).astype(np.float32)))
    return rows


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """One document a step; a feature's rate falls with the gradients that it has met; a rare class weighs more."""
    rng = np.random.default_rng(s.seed)
    y = np.array(labels, np.int64)
    vectors = ((rng.random((s.buckets, s.dim), np.float32) - 0.5) / s.dim).astype(np.float32)
    share = (np.bincount(y, minlength=2) + 1) / (len(y) + 2)
    out, bias = ((rng.random((s.dim, 2), np.float32) - 0.5) / s.dim).astype(np.float32), np.log(share).astype(np.float32)
    if len(set(labels)) < 2:
        return Model(s, np.zeros_like(vectors), out, bias)
    rows, weight = _sparse(texts, s), 0.5 + 0.25 / share
    met, met_out, met_bias = np.full(s.buckets, 1e-8, np.float32), 1e-8, 1e-8
    for _ in range(max(4, s.steps // len(rows))):
        for i in rng.permutation(len(rows)):
            ids, shares = rows[i]
            hidden = shares @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back, down = out @ p, np.outer(hidden, p)
            met_out += float((down * down).sum())
            met_bias += float(p @ p)
            out -= (s.rate / np.sqrt(met_out)) * down
            bias -= (s.rate / np.sqrt(met_bias)) * p
            if len(ids):
                met[ids] += shares * shares * float(back @ back)
                vectors[ids] -= np.outer(s.rate * shares / np.sqrt(met[ids]), back)
    return Model(s, vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Learns from at most settings.sample_rows labelled documents outside the held-out fifth."""
    rows = common.labelled_sample(docs, labels, label, settings.sample_rows).orderBy("doc_id", "text").toPandas()
    return train(rows["text"].tolist(), rows["label"].tolist(), settings)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text column."""
    s, weights, base = model.settings, model.weights().astype(np.float64), float(model.bias[1] - model.bias[0])
    again = s.repeat_weight * float(weights[s.repeated])

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[float, int]] = {}

        def share(token: str) -> tuple[float, int]:
            if len(known) >= CACHE_TOKENS:
                known.clear()
            ids = features(token, s.buckets, s.ngrams)
            found = (float(weights[ids].sum()), len(ids))
            if len(token) <= common.REMEMBERED_CHARS:
                known[token] = found
            return found

        def logit(x: str | None) -> float:
            total, n, last = 0.0, 0, None
            for token in (x or "").split():
                w, k = known.get(token) or share(token)
                total += w
                n += k
                if token == last:
                    total += again
                    n += s.repeat_weight
                last = token
            return base + (total / n if n else 0.0)

        for texts in batches:
            z = np.array([logit(x) for x in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return scored(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    return docs.withColumn("score", score(F.col("text"), model)).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, as the contract of op10 names them."""
    model = fit(docs, labels, "quality", settings)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
