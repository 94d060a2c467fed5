"""Operator 1, language identification by nearest centroid.

A text becomes a unit TF-IDF vector of hashed byte 1- to 3-grams of its
lower-cased letters.  Each language gets several centroids by spherical
k-means over a sample of its training texts; a text takes the language of the
nearest centroid by cosine (of equal ones the first by name).  A text is
rejected if its cosine is below half of that which 99 of 100 training texts of
that language and of like length have, or below 0.03 where fewer than 20 of
them are of like length: a loose bound, which keeps clean documents.

There may be any number of languages: they are sampled and their centroids
compared in blocks, one in memory at a time.

The classifier is fitted on a bounded sample, about ``sample`` texts of each
language chosen by a hash of the id (a documented bound; the sample's size is
binomial around it).  Everything else runs over all rows, and no text leaves
its task.

Defined results: a null text, and one without any letter, is ``und`` with score
0 and rejected.  Rows with a null lang or id don't train.  Repeated rows get
the same result.  Without training rows every text is ``und`` and, since there
is nothing to reject it by, only texts without letters are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.shared import fold, written

UNKNOWN = "und"
#: A block holds at most so many languages.
BLOCK = 512
BUCKETS = 24


def _letters() -> np.ndarray:
    """Lower-cased letters and bytes of non-ASCII characters; all else is a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_TABLE = _letters()


def _counts(s: K.Slice, dims: int) -> np.ndarray:
    """Hashed n-gram counts, one row for each text."""
    n, docs = len(s.data), s.hi - s.lo
    total = np.zeros(docs * dims, np.float32)
    if not n:
        return total.reshape(docs, dims)
    d = _TABLE[s.data].astype(np.uint32)
    size = np.diff(s.offsets)
    doc = np.repeat(np.arange(docs, dtype=np.int64) * dims, size)
    left = np.repeat(s.offsets[1:], size) - np.arange(n)  # bytes up to the text's end
    blank = d == 32
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    code = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(1, 4):
            if n < k:
                break
            code = code[: n - k + 1] * np.uint32(256) + d[k - 1 :]
            keep = left[: n - k + 1] >= k
            keep &= ~(blank[: n - k + 1] & blank[k - 1 :])  # nothing but spaces at both ends
            at = ((code[keep] + np.uint32(k * 0x1000193)) * np.uint32(0x9E3779B1)) >> shift
            total += np.bincount(doc[: n - k + 1][keep] + at, minlength=docs * dims)
    return total.reshape(docs, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _bucket(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), BUCKETS - 1)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        centre = _unit(np.stack([x[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))]))
    return centre


class Model:
    """Centroids (unit rows), their languages, inverse document frequencies and
    the least cosine that each language accepts by length bucket."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.langs, self.centroids, self.idf, self.least = langs, centroids, idf, least

    def nearest(self, x: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the nearest centroid, cosine, too far) of n-gram counts."""
        near = _unit(np.log1p(x) * self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = near[np.arange(len(best)), best]
        return best, cosine, cosine < self.least[best, _bucket(total)]


def _predicted(models: list, column: pa.Array, lettered: pa.Array) -> pa.Array:
    """The best of all blocks (broadcasts of models) for each text."""
    n = len(column)
    lang, score, rejected = np.full(n, UNKNOWN, object), np.full(n, -1.0), np.full(n, bool(models))
    ok = lettered.fill_null(False).to_numpy(zero_copy_only=False)
    for block in models:
        model = block.value
        names = np.array(model.langs, object)
        for s in K.slices(column, rows=256):
            x = _counts(s, len(model.idf))
            best, cosine, far = model.nearest(x, x.sum(axis=1))
            at = np.flatnonzero(cosine > score[s.lo : s.hi])
            lang[s.lo + at], score[s.lo + at], rejected[s.lo + at] = names[best[at]], cosine[at], far[at]
        if len(models) > 1:  # one block in memory at a time
            vars(block).pop("_value", None)
    lang[~ok], score[~ok], rejected[~ok] = UNKNOWN, 0.0, True
    return pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(rejected)], ["lang_pred", "score", "rejected"])


def _blocks_of(rows: Iterator, size: int, key: str) -> Iterator[list]:
    """Rows in blocks of at most ``size`` different values of ``key``, which is grouped."""
    block, seen = [], set()
    for r in rows:
        if len(seen) == size and r[key] not in seen:
            yield block
            block, seen = [], set()
        seen.add(r[key])
        block.append(r)
    if block:
        yield block


def fit(train: DataFrame, dims: int = 8192, clusters: int = 4, sample: int = 1000, rounds: int = 8, seed: int = 7, block: int = BLOCK) -> list:
    """Broadcasts of models, each of a block of languages, from ``train`` (doc_id, text, lang)."""
    spark = train.sparkSession
    rows = train.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0), rows=256):
                x = _counts(s, dims)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(s.lo, s.hi - s.lo), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([x[i, a].astype("<f4").tobytes() for i, a in enumerate(at)], pa.binary())], ["lang", "at", "count"])

    kept = None
    for some in _blocks_of(known.orderBy("lang").toLocalIterator(), block, "lang"):
        share = F.create_map(*(F.lit(x) for r in some for x in (r["lang"], min(1.0, sample / r["n"]))))
        chosen = rows.where(place < share[F.col("lang")]).select("text", "lang")  # null for other languages
        part = written(chosen.mapInArrow(vectors, "lang string, at binary, count binary"), "langid-sample")
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        return []

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                df[np.frombuffer(at, "<u2")] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    n, df = 0, np.zeros(dims, np.int64)
    for r in kept.select("at").coalesce(16).mapInArrow(presence, "n long, df binary").collect():
        n, df = n + r["n"], df + np.frombuffer(r["df"], np.int64)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def centroids(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), dims), np.float32)
        for i, (at, count) in enumerate(zip(pdf["at"], pdf["count"], strict=True)):
            x[i, np.frombuffer(at, "<u2")] = np.frombuffer(count, "<f4")
        bucket = _bucket(x.sum(axis=1))
        x = _unit(np.log1p(x) * idf)
        centre = _k_means(x, clusters, rounds, seed)
        near = (x @ centre.T).max(axis=1)
        least = np.array([0.5 * np.quantile(near[bucket == b], 0.01) if (bucket == b).sum() >= 20 else 0.03 for b in range(BUCKETS)])
        return pd.DataFrame({"lang": key[0], "k": range(len(centre)), "centroid": [c.astype("<f4").tobytes() for c in centre], "least": [least.tobytes()] * len(centre)})

    found = written(kept.groupBy("lang").applyInPandas(centroids, "lang string, k int, centroid binary, least binary"), "centroids")
    models = []
    for some in _blocks_of(found.orderBy("lang", "k").toLocalIterator(), block, "lang"):
        model = Model([r["lang"] for r in some], np.stack([np.frombuffer(r["centroid"], "<f4") for r in some]), idf, np.stack([np.frombuffer(r["least"]) for r in some]))
        models.append(spark.sparkContext.broadcast(model))  # block * clusters * dims * 4 bytes at most
    return models


def language(text: Column, models: list) -> Column:
    """Struct column lang_pred, score, rejected."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, lettered in batches:
            yield _predicted(models, column, lettered)

    return predict(text, text.rlike(r"\p{L}"))


def held_out(modulus: int, remainder: int) -> Column:
    """Rows that don't train: that remainder, or a null id."""
    return F.coalesce(fold(F.col("doc_id"), modulus) == remainder, F.lit(True))


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document; learns from the rows whose crc32 mod 4 is not 2."""
    out = language(F.col("text"), fit(docs.where(~held_out(4, 2)), **options))
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), out.alias("found")).select("doc_id", "held_out", "found.*")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language isn't rejected; columns as given."""
    return docs.where(~language(F.col("text"), fit(docs.where(~held_out(4, 2)), **options))["rejected"])
