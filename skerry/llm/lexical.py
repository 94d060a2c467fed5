"""Operator 12, ranked lexical search with MaxScore in shards.

1. The items' terms are written, and taken in blocks of at most ``block`` (item,
   term) rows; a block is broadcast.
2. One pass over the documents counts documents, terms, and for each term of the
   block the documents that hold it.
3. A second pass cuts each task's documents into shards (``shard_bytes`` of text
   or 65,536 documents).  A shard has a posting list for each term of the block
   with every document's exact contribution, and the largest as upper bound.  An
   item's lists are sorted by bound: those whose bounds together stay below its
   tenth score so far are non-essential.  The others are added up; the
   non-essential ones are probed, largest first, only for documents that can
   still reach that score.
4. Each task sends an item's best documents; a window keeps the best of all.

Nothing is dropped: a document below the bound can't be among the best, and one
that equals the worst of them stays until ids decide.  Posting lists are made
again in each pass instead of being stored.

Defined results: a null text has no terms and isn't counted among the documents.
Each row of ``docs`` is a document, repeated ids included; equal scores go by
doc_id, null ids last.  Rows of ``items`` with one item_id are one item; rows
without an id or a term are none.  A term is told by its 64-bit hash, length,
and first and last eight bytes.  A very long text is a shard of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_DOCS = 1 << 16

_MEMBER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOW = K.lowered()
#: Masks that keep a word's first bytes, by their number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Vocabulary(NamedTuple):
    """The terms of a block, sorted by hash."""

    hash: np.ndarray
    length: np.ndarray
    head: np.ndarray
    tail: np.ndarray


class Items(NamedTuple):
    ids: list
    terms: list[np.ndarray]


def _keys(data: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length, first and last (up to) eight bytes of each word."""
    length = w.end - w.start
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    short = np.minimum(length, 8)
    return K.hash_spans(data, w), length, eight[w.start + 8] & _FIRST[short], eight[w.end] >> (8 * (8 - short)).astype(np.uint64)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    found = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))
    return items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(found).alias("term")).distinct()


def _block(rows: DataFrame) -> tuple[Vocabulary, Items]:
    """The vocabulary and the items of a block; bounded by its rows."""
    table = rows.orderBy("item_id", "term").toArrow()
    words, place = np.unique(np.array(table.column("term").to_pylist(), object), return_inverse=True)
    column = pa.array(list(words), pa.string())
    data, offsets = K.buffers(column)
    keys = _keys(data, K.Words(offsets[:-1], offsets[1:], np.arange(len(words))))
    order = np.argsort(keys[0])
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    by: dict = {}
    for item, term in zip(table.column("item_id").to_pylist(), rank[place].tolist(), strict=True):
        by.setdefault(item, []).append(term)
    return Vocabulary(*(k[order] for k in keys)), Items(list(by), [np.array(t) for t in by.values()])


def _matched(s: K.Slice, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, term, occurrences) for the vocabulary's terms, by text."""
    w = K.spans(_MEMBER[s.data], s.offsets)
    n = np.bincount(w.doc, minlength=s.hi - s.lo)
    h, *rest = _keys(_LOW[s.data], w)
    at = np.minimum(np.searchsorted(v.hash, h), len(v.hash) - 1)
    hit = v.hash[at] == h
    for own, known in zip(rest, v[1:], strict=True):
        hit &= own == known[at]
    pairs, tf = np.unique(w.doc[hit] * len(v.hash) + at[hit], return_counts=True)
    return n, pairs // len(v.hash), pairs % len(v.hash), tf


def _counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and for each of the vocabulary its documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        held = np.zeros(len(v.hash) + 2, np.int64)  # the terms, then documents and all terms
        for batch in batches:
            for s in K.slices(batch.column(0)):
                n, _, term, _ = _matched(s, v)
                held[:-2] += np.bincount(term, minlength=len(v.hash))
                held[-2:] += np.count_nonzero(n), n.sum()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], ["term", "n"])

    df = np.zeros(len(vocabulary.hash) + 2, np.int64)
    for term, n in docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[term] = n
    shared.unpersist()
    return int(df[-2]), int(df[-1]), df[:-2]


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Shard:
    """Posting lists of some documents, with exact contributions and their upper bounds."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        wide = n.astype(object) if 90 * int(n.max(initial=0)) * n_docs >= 1 << 63 else n.astype(np.int64)
        m = 10 + (90 * wide * n_docs) // max(1, n_terms)
        order = np.argsort(term, kind="stable")
        self.docs, tf, own = doc[order], tf[order], term[order]
        self.value = (weights[own] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))).astype(np.int64)
        self.first = np.searchsorted(own, np.arange(len(weights) + 1))
        self.upper = np.zeros(len(weights), np.int64)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            self.upper[full] = np.maximum.reduceat(self.value, self.first[full])
        self.sums = np.zeros(len(n), np.int64)

    def best(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score ``least`` or more, and their scores."""
        terms = terms[self.upper[terms] > 0]
        terms = terms[np.argsort(self.upper[terms])]
        bound = np.cumsum(self.upper[terms])
        essential = int(np.searchsorted(bound, least))  # those before it don't reach it together
        for t in terms[essential:]:
            part = slice(self.first[t], self.first[t + 1])
            self.sums[self.docs[part]] += self.value[part]
        docs = np.flatnonzero(self.sums)
        score = self.sums[docs]
        self.sums[docs] = 0
        for j in range(essential - 1, -1, -1):
            may = score + bound[j] >= least
            docs, score = docs[may], score[may]
            if not len(docs):
                break
            part = slice(self.first[terms[j]], self.first[terms[j] + 1])
            listed = self.docs[part]
            at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
            score = score + np.where(listed[at] == docs, self.value[part][at], 0)
        good = score >= least
        return docs[good], score[good]


def _best_of_block(docs: DataFrame, vocabulary: Vocabulary, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, most: int, shard_bytes: int, kinds: tuple[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, wanted, w = shared.value
        best: list[list[tuple]] = [[] for _ in wanted.ids]
        held: list[tuple] = []
        size = rows = 0

        def rank() -> None:
            begins = np.cumsum([0] + [len(h[1]) for h in held])
            ids = [i for h in held for i in h[0]]
            shard = Shard(np.concatenate([h[1] for h in held]), np.concatenate([h[2] + b for h, b in zip(held, begins)]), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), w, n_docs, n_terms)
            for i, terms in enumerate(wanted.terms):
                found, score = shard.best(terms, -best[i][-1][0] if len(best[i]) == most else 1)
                if len(found) > most:
                    keep = score >= np.partition(score, -most)[-most]
                    found, score = found[keep], score[keep]
                if len(found):
                    new = [(-x, ids[d] is None, ids[d]) for d, x in zip(found.tolist(), score.tolist(), strict=True)]
                    best[i] = heapq.nsmallest(most, best[i] + new, key=lambda t: t[:2] if t[1] else t)
            held.clear()

        for batch in batches:
            for s in K.slices(batch.column(1)):
                held.append((batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist(), *_matched(s, v)))
                size, rows = size + len(s.data), rows + s.hi - s.lo
                if size >= shard_bytes or rows >= SHARD_DOCS:
                    rank()
                    size = rows = 0
        if held:
            rank()
        flat = [(item, -t[0], t[2]) for item, own in zip(wanted.ids, best, strict=True) for t in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], item_type), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], id_type)], ["item_id", "score", "doc_id"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, item_type = to_arrow_type(docs.schema["doc_id"].dataType), pa.array(items.ids[:1]).type if kinds[0] == "string" else pa.int64()
    return written(docs.select("doc_id", "text").mapInArrow(search, f"item_id {kinds[0]}, score long, doc_id {kinds[1]}"), "best")


def search(docs: DataFrame, items: DataFrame, most: int = 10, block: int = 1_000_000, shard_bytes: int = 32 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents of each item."""
    kinds = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    if kinds[0] != "string":
        items, kinds = items.select(F.col("item_id").cast("long").alias("item_id"), "text"), ("bigint", kinds[1])
    terms = written(item_terms(items), "terms")
    blocks = max(1, -(-terms.count() // block))
    out = docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, score long, doc_id {kinds[1]}")
    for i in range(blocks):
        vocabulary, wanted = _block(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i))
        if wanted.ids:
            n_docs, n_terms, df = _counts(docs, vocabulary)
            out = out.unionByName(_best_of_block(docs, vocabulary, wanted, term_weights(df, n_docs), n_docs, n_terms, most, shard_bytes, kinds))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
