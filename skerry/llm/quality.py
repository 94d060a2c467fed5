"""Operator 5, quality by supervised subword embeddings.

Each hashed word, word pair and character n-gram has a learned vector; a
document is the mean of its features' vectors, and a softmax layer gives the
class.  Vectors and layer are trained together by stochastic gradient descent
in numpy.  To score, the layer is folded into one number per feature, which is
the same function at a fraction of the work.

Fitted on a bounded sample: about ``sample`` labelled training documents,
chosen by a hash of the id.

Defined results: a null or empty text has no features and scores by the layer's
bias.  Label rows with nulls are ignored.  Without training labels of both
classes every score is the share of label 1.  A null doc_id is held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.features import Sparse, collected, linear_score, subwords, unit_hash
from skerry.llm.langid import held_out

THRESHOLD = 0.3
BITS = 17


def train(y: np.ndarray, rows: Sparse, dims: int, rounds: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, layer, bias) by SGD over single documents."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (1 << BITS, dims)).astype(np.float32)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    layer, bias = rng.normal(0, 1, (dims, 2)).astype(np.float32), np.log([1 - share, share]).astype(np.float32)
    total, step = rounds * len(y), 0
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            now, step = rate * (1 - step / total), step + 1
            a, b = rows.bounds[i], rows.bounds[i + 1]
            at, value = rows.bucket[a:b], rows.value[a:b]
            own = vectors[at]
            mean = value @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= now * 0.1 * np.outer(mean, p)
            bias -= now * 0.1 * p
            vectors[at] = own - now * len(value) ** 0.5 * np.outer(value, back).astype(np.float32)
    return vectors, layer, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, dims: int = 8, rounds: int = 6, rate: float = 0.5, seed: int = 13) -> tuple[np.ndarray, float]:
    """Folded (weight by feature, bias) from training documents and labels (doc_id, quality)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(5, 0)).select("doc_id", (F.col("quality") == 1).cast("int").alias("y"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not good or good == n:
        share = good / n if n else 0.0
        return np.zeros(1 << BITS), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    chosen = known.where(unit_hash(F.col("doc_id"), seed) < min(1.0, sample / n))
    y, rows = collected(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), subwords, lambda n: n / n.sum())  # the sample's bound
    if not len(y):
        return np.zeros(1 << BITS), float(np.log(good / (n - good)))
    vectors, layer, bias = train(y, rows, dims, rounds, rate, seed)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights, bias = fit(docs.where(~held_out(5, 0)), labels, **options)
    score = linear_score(F.col("text"), subwords, weights, bias, docs.sparkSession)
    return docs.select("doc_id", held_out(5, 0).alias("held_out"), score.alias("score")).select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
