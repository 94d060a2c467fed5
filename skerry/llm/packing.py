"""Operator 10, best-fit packing of tokenised documents by large-item matching.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens,
and only the pieces' lengths decide the packing.  Lengths are integers up to
the capacity, so the packing is computed on the histogram of lengths, whose
size doesn't depend on the data: pieces above a third of the capacity pair at
most twice per sequence by greedy matching (largest with its largest fitting
partner), then smaller ones, longest first, go where the least room remains.
The plan gives every length runs of ranks, and a piece finds its place from
its rank among the pieces of its length.  Ranks come from counts per task and
length, so that a very common length is never gathered in one task.

Defined results: a null or empty text is a document of the end token alone.
Repeated rows, equal or null ids are packed like any other row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.shared import written

END = 2
CAPACITY = 1024
_RESERVED = b"<|endoftext|>"


class Encoder:
    """ids of ``byte_bpe_50k.json`` by the ``tokenizers`` library, from a memo of chunks.

    A text is cut before every space or line feed that follows a character
    which surely isn't white space.  The vocabulary's pre-tokeniser always
    splits there, so a text's ids are its chunks' ids in a row, and a task
    encodes each different chunk once.  Chunks are encoded by the same ranks
    in ``tiktoken``; texts with the reserved token's string go whole to
    ``tokenizers``, which alone treats it specially.
    """

    def __init__(self, most: int = 4_000_000):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
        self.core = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.path, self.whole, self.most = public_tokenizers.path("byte_bpe_50k.json"), None, most
        self._reset()

    def _reset(self) -> None:
        self.at: dict[int, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, solid: np.ndarray) -> None:
        """Add chunks; ``solid``: begins with a space or line feed, ends with no space."""
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(start[solid].tolist(), end[solid].tolist())]
        ids = np.asarray(self.core.encode_ordinary(b"".join(texts).decode()), np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x) for x in texts]), side="left") + 1 if texts else np.zeros(0, np.int64)
        rest = [self.core.encode_ordinary(raw[a:b].decode()) for a, b in zip(start[~solid].tolist(), end[~solid].tolist())]
        size = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in rest], np.int64)]).astype(np.int64)
        k, base = len(self.at), len(self.pool)
        self.at.update(zip(np.concatenate([hashes[solid], hashes[~solid]]).tolist(), range(k, k + len(size))))
        self.pool = np.concatenate([self.pool, ids, np.array([i for x in rest for i in x], np.uint32)])
        self.begin = np.concatenate([self.begin, base + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])

    def encode(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text), with the end token after each text."""
        data, offsets, docs = s.data, s.offsets, s.hi - s.lo
        n = len(data)
        blank = (data == 32) | (data == 10)
        firm = (data > 32) & (data < 127)
        firm[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut = np.zeros(n, bool)
        cut[1:] = blank[1:] & firm[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)[: len(start)]
        doc = np.searchsorted(offsets, start, side="right") - 1
        hashes = K.hash_spans(data, K.Words(start, end, doc))
        some, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.pool) > self.most:
            self._reset()
        known = self.at
        new = first[np.fromiter((h not in known for h in some.tolist()), bool, len(some))]
        if len(new):
            self._learn(hashes[new], data, start[new], end[new], blank[start[new]] & firm[end[new] - 1])
        at = np.fromiter(map(known.__getitem__, some.tolist()), np.int64, len(some))[which]
        size = self.size[at]
        per = np.bincount(doc, weights=size, minlength=docs).astype(np.int64)
        source = np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        bounds = np.concatenate([[0], np.cumsum(per + 1)])
        ids = np.full(bounds[-1], END, np.uint32)
        ids[np.arange(len(source)) + np.repeat(np.arange(docs), per)] = self.pool[source]
        if _RESERVED in (raw := data.tobytes()):
            from tokenizers import Tokenizer

            self.whole = self.whole or Tokenizer.from_file(self.path)
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for i in range(docs):
                if _RESERVED in (text := raw[offsets[i] : offsets[i + 1]]):
                    parts[i] = np.array([*self.whole.encode(text.decode(), add_special_tokens=False).ids, END], np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its task
    and rank among that task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                ids, bounds = encoder.encode(s)
                total = np.diff(bounds)
                number = -(-total // capacity)
                doc = np.repeat(np.arange(s.hi - s.lo), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                head = total - (number - 1) * capacity  # the first piece's length
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(first, count) + np.repeat(ranks[sizes], count)
                ranks[sizes] += count
                raw = ids.astype("<u4").tobytes()
                view = memoryview(raw)
                begin = (bounds[:-1][doc] + start).tolist()
                blobs = [view[4 * a : 4 * (a + n)] for a, n in zip(begin, length.tolist())]
                columns = [batch.column(0).slice(s.lo, s.hi - s.lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(b, "<i4") for b in blobs], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length, runs (first rank, pieces, first sequence, pieces per
    sequence, offset of the first) that place all its pieces."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used, sequence = [0] * (capacity + 1), 0
    room: dict[int, list[tuple[int, int]]] = {}

    def put(size: int, n: int, first: int, each: int, offset: int) -> None:
        runs.setdefault(size, []).append((used[size], n, first, each, offset))
        used[size] += n
        left[size] -= n

    def leave(first: int, n: int, gap: int) -> None:
        if n and gap:
            room.setdefault(gap, []).append((first, n))

    third = capacity // 3
    for size in range(capacity, third, -1):
        partner = min(size, capacity - size)
        while left[size]:
            while partner > third and left[partner] < 1 + (partner == size):
                partner -= 1
            if partner <= third:
                n = left[size]
                put(size, n, sequence, 1, 0)
                leave(sequence, n, capacity - size)
            elif partner == size:
                n = left[size] // 2
                put(size, 2 * n, sequence, 2, 0)
                leave(sequence, n, capacity - 2 * size)
            else:
                n = min(left[size], left[partner])
                put(size, n, sequence, 1, 0)
                put(partner, n, sequence, 1, size)
                leave(sequence, n, capacity - size - partner)
            sequence += n
    for size in range(third, 0, -1):
        gap = size
        while left[size]:
            while gap < capacity and not room.get(gap):
                gap += 1
            if gap == capacity and not room.get(gap):
                n = -(-left[size] // (capacity // size))
                leave(sequence, n, capacity)
                sequence += n
            first, n = room[gap].pop()
            each = min(gap // size, left[size])
            full = min(n, left[size] // each)
            put(size, full * each, first, each, capacity - gap)
            leave(first, full, gap - each * size)
            leave(first + full, n - full, gap)
    return runs


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of :func:`pieces`."""
    spark = found.sparkSession
    tasks = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs = plan({r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = spark.sparkContext.broadcast({size: np.array(x, np.int64).T for size, x in runs.items()})  # bounded by the capacity

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for one in np.unique(size):
            at = np.flatnonzero(size == one)
            first, _, begin, each, fill = table.value[int(one)]
            k = np.searchsorted(first, r[at], side="right") - 1
            i = r[at] - first[k]
            sequence[at], offset[at] = begin[k] + i // each[k], fill[k] + i % each[k] * one
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    out = found.join(base, ["part", "length"]).withColumn("seat", seat(F.col("length"), F.col("rank") + F.col("base")))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if "ids" in found.columns else [])
    return out.select(*kept, "seat.sequence_id", "seat.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset (and ids, if asked)."""
    return place(written(pieces(docs, capacity, with_ids), "pieces"), capacity)
