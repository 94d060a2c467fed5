"""Operator 2, line dedup with two Bloom filters.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
A key of at least ``min_chars`` code points that at least ``min_docs``
documents hold loses all its lines except in the largest doc_id holding it.

1. Every task sends the 64-bit hashes of its keys, each once, with whether it
   saw one more than once, to the segment of the filters that owns the hash.
   A segment builds two Bloom filters: hashes seen once, hashes seen twice.
2. The twice-seen filters (``max_filter_mb`` in all at most, whatever the
   input's size; a fuller filter only suspects more) are broadcast, and only
   lines that they suspect are shuffled, as 128-bit digests with their doc_id.
3. Exact counts of distinct documents by digest confirm the repeats and choose
   the document that keeps them.

Defined results: a null or empty text is one empty line, and a null text stays
null in the cleaned documents.  Rows that share a doc_id are one document when
counting.  Rows with a null doc_id are never counted and lose no line.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.shared import fresh, input_bytes, written

SEGMENT_BITS = 1 << 22
PROBES = 4
FLUSH = 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None if it has less than ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    n = len(key)
    return key if n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars) else None


def _digests(text: bytes, min_chars: int) -> list[bytes | None]:
    """128-bit cryptographic digests of the lines' keys, in order."""
    blake = hashlib.blake2b
    return [None if (key := line_key(line, min_chars)) is None else blake(key, digest_size=16).digest() for line in text.split(b"\n")]


def _probes(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(21)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(h + np.uint64(j) * step) & np.uint64(SEGMENT_BITS - 1) for j in range(PROBES)]


def _segments(docs: DataFrame, max_filter_mb: int) -> int:
    wanted, most = input_bytes(docs) >> 23, (max_filter_mb << 23) // SEGMENT_BITS
    return 1 << max(0, min(int(wanted), most).bit_length() - 1)


def twice_seen(docs: DataFrame, segments: int, min_chars: int) -> np.ndarray:
    """Packed twice-seen filters, one row per segment."""
    down = np.uint64(64 - segments.bit_length() + 1)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.frombuffer(b"".join(held), "<u8"), return_counts=True)
            where = (h >> down).astype(np.int64) if segments > 1 else np.zeros(len(h), np.int64)
            cuts = np.searchsorted(where, np.arange(segments + 1))
            rows = [(i, h[a:b].tobytes(), h[a:b][n[a:b] > 1].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "seen", "twice"])

        for batch in batches:
            for s in K.slices(batch.column(0)):
                raw, bounds = s.data.tobytes(), s.offsets.tolist()
                for a, b in zip(bounds, bounds[1:]):
                    held.extend({d[:8] for d in _digests(raw[a:b], min_chars) if d is not None})
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, seen, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment not in once:
                    once[segment], twice[segment] = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                probes = _probes(np.frombuffer(seen, "<u8"))
                again = np.logical_and.reduce([once[segment][p] for p in probes])
                for p in probes:
                    once[segment][p] = True
                    twice[segment][p[again]] = True
                for p in _probes(np.frombuffer(more, "<u8")):
                    twice[segment][p] = True
        for segment, bits in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["segment", "bits"])

    seen = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(hashes, "segment int, seen binary, twice binary")
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in seen.repartition(min(segments, 512), "segment").mapInArrow(filters, "segment int, bits binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def suspects(docs: DataFrame, filters: np.ndarray, min_chars: int) -> DataFrame:
    """(doc_id, digest) of each key that the twice-seen filters hold."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # max_filter_mb at most
    segments = len(filters)
    down = np.uint64(64 - segments.bit_length() + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for s in K.slices(batch.column(1)):
                raw, bounds = s.data.tobytes(), s.offsets.tolist()
                own = [list({d for d in _digests(raw[a:b], min_chars) if d is not None}) for a, b in zip(bounds, bounds[1:])]
                flat = [d for x in own for d in x]
                if not flat:
                    continue
                h = np.frombuffer(b"".join(flat), "<u8")[::2].copy()
                where = (h >> down).astype(np.int64) if segments > 1 else np.zeros(len(h), np.int64)
                hit = np.logical_and.reduce([(bits[where, (p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 for p in _probes(h)]).astype(bool)
                doc = np.repeat(np.arange(s.lo, s.hi), [len(x) for x in own])[hit]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([flat[i] for i in np.flatnonzero(hit)], pa.binary())], ["doc_id", "digest"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(probe, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary")


def repeats(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, max_filter_mb: int = 64) -> DataFrame:
    """(doc_id, drop): the digests of the keys that each document loses."""
    filters = twice_seen(docs, _segments(docs, max_filter_mb), min_chars)
    pairs = written(suspects(docs, filters, min_chars), "suspected-lines")
    confirmed = pairs.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written, so that both sides of the join are plain shuffles, and a digest
    # that very many documents hold is split by adaptive execution
    confirmed = written(confirmed, "repeated-lines")
    lost = pairs.join(confirmed, "digest").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))


def _cleaned(docs: DataFrame, min_chars: int, **options) -> tuple[DataFrame, str]:
    """The documents with a struct column (n_lines, n_dropped, kept), and its name."""

    @F.arrow_udf("struct<n_lines:long,n_dropped:long,kept:string>")
    def cut(text: pa.Array, drop: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for s in K.slices(text):
            raw, bounds = s.data.tobytes(), s.offsets.tolist()
            for a, b, lost in zip(bounds, bounds[1:], drop.slice(s.lo, s.hi - s.lo).to_pylist()):
                one = raw[a:b]
                n_lines.append(one.count(b"\n") + 1)
                if lost:
                    gone, lines = set(lost), one.split(b"\n")
                    stay = [line for line, d in zip(lines, _digests(one, min_chars), strict=True) if d is None or d not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    one = b"\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(one)
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "kept"])

    own, drop, lines = (fresh(docs, c) for c in ("own", "lost", "lines"))
    lost = repeats(docs, min_chars, **options).withColumnsRenamed({"doc_id": own, "drop": drop})
    joined = docs.join(lost, docs["doc_id"] == lost[own], "left")
    return joined.withColumn(lines, cut(F.col("text"), F.col(drop))), lines


def line_report(docs: DataFrame, min_chars: int = 40, **options) -> DataFrame:
    """One row per document: lines before, lines dropped, digest of what stays."""
    got, lines = _cleaned(docs.select("doc_id", "text"), min_chars, **options)
    return got.select("doc_id", f"{lines}.n_lines", f"{lines}.n_dropped", F.sha2(F.col(f"{lines}.kept").cast("binary"), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, **options) -> DataFrame:
    """The documents without their dropped lines; columns as given."""
    got, lines = _cleaned(docs, min_chars, **options)
    text = F.when(F.col("text").isNotNull(), F.col(f"{lines}.kept")).alias("text")
    return got.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns))
