"""Operator 3, benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 13 words of a benchmark item (a shorter item is one window) is
a pattern.  A search keeps a position at a possible last word; the block of
words that ends there says how far it may shift, since no pattern has that
block nearer to its end.  At shift 0 the block's bucket holds the patterns with
that suffix, and direct comparison confirms one.  Patterns are grouped by
length so that one short item doesn't shorten the shifts of all the others.

The benchmark is dealt into blocks of at most ``block_words`` words.  Each
block is a broadcast of bounded size, and the driver and each task hold one at a
time; a document is searched once for each block.  Documents are not shuffled.
Occurrences that overlap are united, so their order (ties too) doesn't matter; a
very long text is one slice.

Defined results: a null or wordless text has no words, no hits and is clean.
Items with a null id or without words are no items; rows with the same id are
one item.  Repeated documents get the same result each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.shared import written

WINDOW = 13


def _word_table() -> bytes:
    """Byte -> lower-cased byte, or space where it is no part of a word."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


TABLE = _word_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _grams(length: int) -> int:
    """Words in a block, for patterns of this length."""
    return 3 if length >= 9 else 2 if length >= 4 else 1


class Patterns:
    """Shift and suffix tables of one block of the benchmark."""

    def __init__(self, chunks: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = sorted({item for item, _ in chunks})
        number = {item: i for i, item in enumerate(self.items)}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item, words in chunks:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            m = min(window, len(ids))
            group = by_length.setdefault(m, {})
            for i in range(len(ids) - m + 1):
                owners = group.setdefault(tuple(ids[i : i + m]), [])
                if number[item] not in owners[-1:]:
                    owners.append(number[item])
        self.base = len(self.vocabulary) + 1
        self.groups = []
        for m, group in sorted(by_length.items()):
            size = _grams(m)
            shift: dict[int, int] = {}
            suffix: dict[int, dict[tuple[int, ...], list[int]]] = {}
            for pattern, owners in group.items():
                key = 0
                for end in range(size, m + 1):
                    key = self._key(pattern, end, size)
                    shift[key] = min(shift.get(key, m), m - end)
                suffix.setdefault(key, {})[pattern] = owners
            self.groups.append((m, size, m - size + 1, shift, suffix))

    def _key(self, ids, end: int, size: int) -> int:
        key = 0
        for x in ids[end - size : end]:
            key = key * self.base + x
        return key

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(word ranges inside any occurrence, items that occur)."""
        known = self.vocabulary.get
        ids = [known(w, 0) for w in words]
        ranges, items, n, base = [], set(), len(ids), self.base
        for m, size, most, shift, suffix in self.groups:
            at, of = m, shift.get
            while at <= n:
                if size == 3:
                    key = (ids[at - 3] * base + ids[at - 2]) * base + ids[at - 1]
                elif size == 2:
                    key = ids[at - 2] * base + ids[at - 1]
                else:
                    key = ids[at - 1]
                step = of(key, most)
                if step:
                    at += step
                    continue
                owners = suffix[key].get(tuple(ids[at - m : at]))
                if owners is not None:
                    ranges.append((at - m, at))
                    items.update(owners)
                at += 1
        return ranges, items


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcasts of :class:`Patterns`, each from at most about ``block_words`` words."""
    spark, piece = benchmark.sparkSession, max(window, block_words // 8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of((text or "").encode())
                if item is not None and words:
                    for k in range(0, max(1, len(words) - window + 1), piece):
                        own = words[k : k + piece + window - 1]
                        out.append((item, k // piece, len(own), b" ".join(own).decode()))
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "k", "n", "words"), x, strict=True)) for x in out], pa.schema([("item", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("words", pa.string())]))

    chunks = benchmark.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(cut, "item string, k long, n long, words string")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    parts = -(-2 * total // block_words) if total > block_words else 1
    dealt = chunks.withColumn("part", F.pmod(F.xxhash64("item", "k"), F.lit(parts)))
    rows, out, now = [], [], None
    for r in written(dealt, "benchmark").orderBy("part", "item", "k").toLocalIterator():  # one part in memory
        if r["part"] != now and rows:
            out.append(spark.sparkContext.broadcast(Patterns(rows, window)))
            rows = []
        now = r["part"]
        rows.append((r["item"], r["words"].encode().split()))
    if rows:
        out.append(spark.sparkContext.broadcast(Patterns(rows, window)))
    return out


def _search(column: pa.Array, blocks: list) -> pa.Array:
    n = len(column)
    n_words, n_hit, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
    ranges: dict[int, list[tuple[int, int]]] = {}
    for block in blocks or [None]:
        patterns = block and block.value
        for s in K.slices(column):
            raw, bounds = s.data.tobytes().translate(TABLE), s.offsets.tolist()
            for d, (a, b) in enumerate(zip(bounds, bounds[1:]), s.lo):
                words = raw[a:b].split()
                n_words[d] = len(words)
                if patterns:
                    got, who = patterns.search(words)
                    if got:
                        ranges.setdefault(d, []).extend(got)
                        items[d] += [patterns.items[i] for i in who]
        if len(blocks) > 1:  # one block in memory at a time
            vars(block).pop("_value", None)
    for d, got in ranges.items():
        edge = np.zeros(n_words[d] + 1, np.int64)
        for a, b in got:
            edge[a] += 1
            edge[b] -= 1
        n_hit[d] = int((np.cumsum(edge) > 0).sum())
    owners = [sorted(set(x)) for x in items]
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in owners], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in owners]), pa.array((n_hit > 0) & (20 * n_hit >= n_words)), pa.array(owners, pa.list_(pa.string()))],
        ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


def occurrences(text: Column, benchmark: DataFrame, window: int = WINDOW, block_words: int = 400_000) -> Column:
    """Struct column with what ``text`` holds of ``benchmark`` (item_id, text)."""
    blocks = _blocks(benchmark, window, block_words)

    @F.arrow_udf("struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,items:array<string>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _search(batch, blocks)

    return search(text)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, items, digest and verdict."""
    return docs.select("doc_id", occurrences(F.col("text"), benchmark, **options).alias("found")).select("doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256", "found.contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated; columns as given."""
    return docs.where(~occurrences(F.col("text"), benchmark, **options)["contaminated"])
