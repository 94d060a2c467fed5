"""Operator 11, hard-negative mining with an orthogonal PCA rotation.

1. Components become integers floor(scale * x).  One pass sums the second
   moments of all rows (a matrix of the dimension's size, added up in Spark);
   its eigenvectors are the rotation.
2. Anchors are written and taken in chunks of at most ``CHUNK_BYTES``, which are
   broadcast; the rows stay where they are, and each chunk is a pass over them.
3. A task multiplies an anchor's and a row's leading rotated components.  The
   product of the residual norms, with slack for rounding, bounds the rest; a
   pair that can't reach the anchor's worst kept row (or the window of scores
   asked for) is discarded.  What is left adds further components and is tested
   again; survivors are verified by integer products of whole vectors.
4. The first pass finds each anchor's positives, the second the negatives in the
   windows of their scores; a task sends its best rows only.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part.  A shorter vector counts as filled up with
zeros; an empty one has product 0 with all.  Repeated rows (same id, label and
vector) count once; a row is never paired with a row of its own id.  Equal
scores go by the smaller id.  Products beyond 9.2e16 in size count as that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.shared import written

CHUNK_BYTES = 16 << 20
#: Pairs that a task looks at together.
PAIRS = 1 << 20
MOST = (2**63 - 1) // 100
FOUND = "anchor int, slot int, score long, other long"
_FOUND = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("other", pa.int64())])


class Vectors(NamedTuple):
    """Integer vectors (whole numbers as doubles), their rotation, and the norms
    of what each stage of the comparison has not multiplied yet."""

    id: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    rest: np.ndarray

    def take(self, rows: np.ndarray | slice) -> Vectors:
        return Vectors(*(x[rows] for x in self))


class Chunk(NamedTuple):
    """Anchors; with the scores of their positives (a row each, -1 after the last) in the second pass."""

    anchors: Vectors
    rotation: np.ndarray
    cuts: list[int]
    positives: np.ndarray | None


def usable(rows: DataFrame) -> DataFrame:
    """id, label, v (doubles) of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)), F.lit(False)))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def _matrix(column: pa.Array, scale: int, dim: int | None = None) -> np.ndarray:
    """The integer vectors of a list column, filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    dim = dim or max(1, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(flat * scale)
    return out


def rotation(rows: DataFrame, scale: int) -> np.ndarray:
    """Eigenvectors of the second moments of all rows, the largest first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 1))
        for b in batches:
            if b.num_rows:
                total = _added(total, (x := _matrix(b.column(0), scale)).T @ x)
        yield _packed(total)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 1))
        for b in batches:
            for part in b.column(1).to_pylist():
                one = np.frombuffer(part)
                total = _added(total, one.reshape(math.isqrt(len(one)), -1))
        yield _packed(total)

    sums = rows.select("v").mapInArrow(moments, "part int, sums binary")
    total = np.zeros((1, 1))
    for r in sums.withColumn("part", F.spark_partition_id() % 16).repartition(16, "part").mapInArrow(together, "part int, sums binary").toLocalIterator():
        one = np.frombuffer(r["sums"])
        total = _added(total, one.reshape(math.isqrt(len(one)), -1))
    return np.linalg.eigh(total / max(1.0, np.abs(total).max()))[1][:, ::-1]


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((max(len(a), len(b)),) * 2)
    out[: len(a), : len(a)] = a
    out[: len(b), : len(b)] += b
    return out


def _packed(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def vectors(batch: pa.RecordBatch, scale: int, turn: np.ndarray, cuts: list[int]) -> Vectors:
    """The rows (id, label, v) of a batch, each once."""
    whole = _matrix(batch.column(2), scale, len(turn))
    id_, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.lexsort((label, id_))
    if len(order) > 1 and np.any(np.diff(id_[order]) == 0):
        _, keep = np.unique(np.column_stack([id_.astype(np.int64), label.astype(np.int64), whole.view(np.int64)]), axis=0, return_index=True)
        id_, label, whole = id_[keep], label[keep], whole[keep]
    turned = whole @ turn
    left = np.cumsum(np.column_stack([turned * turned, np.zeros(len(turned))])[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(np.column_stack([left[:, c] for c in [0, *cuts]]))  # the first is the whole norm
    return Vectors(id_.astype(np.int64), label.astype(np.int64), whole, turned, rest)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < MOST:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    exact = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a.tolist(), b.tolist())]
    return np.array([max(-MOST, min(MOST, x)) for x in exact], np.int64)


def survivors(a: Vectors, x: Vectors, cuts: list[int], asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs ``asked`` for with a score from the
    anchor's ``low`` to its ``high``."""
    high = np.where(high >= 0.999 * MOST, np.inf, high)  # greater products count as MOST
    slack = 1e-10 * np.outer(a.rest[:, 0], x.rest[:, 0]) + 1e-6
    part = a.turned[:, : cuts[0]] @ x.turned[:, : cuts[0]].T
    reach = np.outer(a.rest[:, 1], x.rest[:, 1]) + slack
    i, j = np.nonzero(asked & (part + reach >= low[:, None]) & (part - reach <= high[:, None]))
    part, slack = part[i, j], slack[i, j]
    for k, (begin, end) in enumerate(zip(cuts, cuts[1:]), 2):
        part = part + _pairwise(a.turned[:, begin:end], x.turned[:, begin:end], i, j)
        reach = a.rest[i, k] * x.rest[j, k] + slack
        stay = (part + reach >= low[i]) & (part - reach <= high[i])
        i, j, part, slack = i[stay], j[stay], part[stay], slack[stay]
    score = np.concatenate([np.zeros(0, np.int64), *(products(a.whole[i[p : p + 65536]], x.whole[j[p : p + 65536]]) for p in range(0, len(i), 65536))])
    stay = (score >= low[i]) & (score <= high[i])
    return i[stay], j[stay], score[stay]


def _pairwise(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[p : p + 65536]], b[j[p : p + 65536]]) for p in range(0, len(i), 65536))])


class Best:
    """The ``most`` best (score, id) of each key, without repeats."""

    def __init__(self, keys: int, most: int):
        self.most, self.worst = most, np.full(keys, -np.inf)
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, key: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        self.new.append((key, score, other))
        self.waiting += len(key)
        if self.waiting > 4096 + len(self.worst):
            self.merge()

    def merge(self) -> None:
        key, score, other = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((other, -score, key))
        key, score, other = key[order], score[order], other[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (np.diff(key) != 0) | (np.diff(score) != 0) | (np.diff(other) != 0)
        key, score, other = key[fresh], score[fresh], other[fresh]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = place == self.most - 1
        self.worst[key[last]] = score[last]
        self.kept = [c[place < self.most] for c in (key, score, other)]
        self.new, self.waiting = [], 0


def _found(best: Best, slots: int) -> pa.RecordBatch:
    best.merge()
    key, score, other = best.kept
    return pa.RecordBatch.from_arrays([pa.array((key // slots).astype(np.int32)), pa.array((key % slots).astype(np.int32)), pa.array(score), pa.array(other)], schema=_FOUND)


def _pieces(batches: Iterator[pa.RecordBatch], scale: int, chunk: Chunk) -> Iterator[Vectors]:
    step = max(16, PAIRS // max(1, len(chunk.anchors.id)))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield vectors(pa.RecordBatch.from_arrays([c.slice(lo, step) if i < 2 else pa.concat_arrays([c.slice(lo, step)]) for i, c in enumerate(batch.columns)], names=batch.schema.names), scale, chunk.rotation, chunk.cuts)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks with their rank; a repeat has the rank of its first."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most).distinct()


def _positives(rows: DataFrame, chunk: Chunk, scale: int, most: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(chunk)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        a = c.anchors
        best = Best(len(a.id), most)
        for x in _pieces(batches, scale, c):
            asked = (a.label[:, None] == x.label) & (a.id[:, None] != x.id)
            i, j, score = survivors(a, x, c.cuts, asked, best.worst, np.full(len(a.id), np.inf))
            best.add(i, score, x.id[j])
        yield _found(best, 1)

    return _ranked(rows.mapInArrow(find, FOUND), most)


def _negatives(rows: DataFrame, chunk: Chunk, scale: int, most: int, low: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(chunk)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        a, slots = c.anchors, c.positives.shape[1]
        least = np.where(c.positives >= 0, -(-low * c.positives // 100), np.iinfo(np.int64).max).astype(float)
        best, high = Best(c.positives.size, most), c.positives.max(axis=1).astype(float)
        for x in _pieces(batches, scale, c):
            floor = np.maximum(best.worst.reshape(least.shape), least).min(axis=1)
            i, j, score = survivors(a, x, c.cuts, a.label[:, None] != x.label, floor, high)
            if len(i):
                asked = (score[:, None] <= c.positives[i]) & (100 * score[:, None] >= low * c.positives[i]) & (c.positives[i] >= 0)
                pair, slot = np.nonzero(asked)
                best.add(i[pair] * slots + slot, score[pair], x.id[j[pair]])
        yield _found(best, slots)

    return _ranked(rows.mapInArrow(find, FOUND), most)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` tells the anchors by ``vec_id``.  A negative has another label and
    a score from ``low`` percent of the positive's to the positive's.
    """
    spark, good = rows.sparkSession, usable(rows)
    anchors = written(usable(rows.where(anchor)).distinct(), "anchors")
    turn = rotation(good, scale)
    dim, count = len(turn), anchors.count()
    cuts = sorted({max(1, dim * k // 16) for k in (2, 4, 8)})
    chunks = max(1, math.ceil(count * (16 * dim + 200) / CHUNK_BYTES))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for k in range(chunks if count else 0):
        table = anchors.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == k).orderBy("id").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        own = vectors(table.to_batches()[0], scale, turn, cuts)
        near = _positives(good, Chunk(own, turn, cuts, None), scale, positives).toArrow()  # ``positives`` rows for each anchor of the chunk
        i, rank, score, other = (near.column(c).to_numpy() for c in ("anchor", "rank", "score", "other"))
        scores = np.full((len(own.id), positives), -1, np.int64)
        scores[i, rank - 1] = np.maximum(score, -1)  # below zero the window is empty
        found = written(_negatives(good, Chunk(own, turn, cuts, scores), scale, negatives, low), "negatives")
        names = spark.createDataFrame(pa.table({"anchor": near.column("anchor"), "slot": pa.array(rank - 1, pa.int32()), "anchor_id": pa.array(own.id[i]), "positive_id": near.column("other"), "positive_score": near.column("score")}))
        out = out.unionByName(found.join(F.broadcast(names), ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))  # names: bounded by the chunk
    return out
