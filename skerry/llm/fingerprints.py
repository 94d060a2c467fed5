"""Operator 8, document fingerprints by randomised edit embedding.

A shared random walk turns a string into a longer one: step j copies the
character at the walk's place and moves on by a random bit that depends only
on j and that character.  After an edit two walks soon meet again, so a small
edit distance becomes a small Hamming distance.

Texts are cut into segments of at most ``MOST`` bytes at places that the text
itself decides (after white space, by a hash of the bytes before it), and each
segment is walked by itself; all segments of a slice take their steps
together.  The walked string is sampled: every band of ``BAND`` consecutive
output symbols is hashed with its place in the segment.  A fingerprint keeps,
for each of ``SLOTS`` slots, a byte of the least band hash that falls into it.
The likeness of two fingerprints is the share of equal slots, among those that
either text fills.  :func:`near_pairs` groups slots into bands to find
candidates and verifies them by likeness.

Defined results: a null text is an empty text; its fingerprint has no filled
slot, and two empty texts have likeness 1.  "Next" follows descending doc_id,
null ids last, rows with equal ids by descending text (ties of both are equal
rows); after the last row comes the first.  A table with one row is its own
next.  Ids may be of any type with an order.  A very long text is one slice.

The walk starts anew at every segment and positions are sampled by content, so
the likeness is a share of equal samples of the embedding, not the Hamming
distance of two whole embeddings: whole walks of long texts would have to be
aligned, and a step for each character can't be shared among texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skerry.llm import kernels as K
from skerry.llm.shared import input_bytes

U64 = np.uint64
SLOTS = 128
MOST = 96
BAND = 6
STEPS_PER_BYTE = 2
#: The walk's shared random bits by step and byte.
WALK = ((K.mix64(np.arange(MOST * STEPS_PER_BYTE * 256, dtype=U64) + U64(0xED17)) >> U64(63)).astype(np.uint8)).reshape(-1, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row): content-defined cuts, then cuts of what is still too long."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 3:
        before = data[:-3].astype(np.uint32) * np.uint32(0x01000193) ^ data[1:-2].astype(np.uint32) * np.uint32(0x85EBCA6B) ^ data[2:-1].astype(np.uint32) * np.uint32(0xC2B2AE35)
        cut[3:] = _SPACE[data[2:-1]] & ((before * np.uint32(0x9E3779B1)) >> np.uint32(29) < 2)
    for k in (1, 2):  # the three bytes before these places aren't all of the same row
        near = offsets[:-1] + k
        cut[near[near < offsets[1:]]] = False
    cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, n))
    pieces = -(-length // MOST)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + k * MOST
    length = np.minimum(np.repeat(length, pieces) - k * MOST, MOST)
    return start, length, np.searchsorted(offsets, start, side="right") - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint8 fingerprints, one row per text; 0 marks an empty slot."""
    docs = len(offsets) - 1
    out = np.full(docs * SLOTS, 1 << 31, np.int64)
    start, length, row = _segments(data, offsets)
    if len(start):
        order = np.argsort(-length, kind="stable")
        place, end, row = start[order], (start + length)[order] - 1, row[order]
        steps = (length * STEPS_PER_BYTE)[order]
        active = np.searchsorted(-steps, -np.arange(steps[0]), side="left")  # segments with more steps
        symbol = np.zeros(len(place), np.uint32)
        with np.errstate(over="ignore"):
            for j in range(int(steps[0])):
                k = active[j]
                here = data[place[:k]]
                symbol[:k] = symbol[:k] * np.uint32(0x01000193) + here
                place[:k] += WALK[j][here]
                np.minimum(place[:k], end[:k], out=place[:k])
                if j % BAND == BAND - 1:
                    h = (symbol[:k] ^ np.uint32(j * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x2C1B3C6D)
                    slot = row[:k] * SLOTS + (h >> np.uint32(25))
                    np.minimum.at(out, slot, (h & np.uint32(0x1FFFFFF)).astype(np.int64))
                    symbol[:k] = 0
            short = steps < BAND  # a segment without a whole band
            if short.any():
                h = symbol[short] * np.uint32(0x9E3779B1)
                np.minimum.at(out, row[short] * SLOTS + (h >> np.uint32(25)), (h & np.uint32(0x1FFFFFF)).astype(np.int64))
    return np.where(out < 1 << 31, out % 255 + 1, 0).astype(np.uint8).reshape(docs, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fills (1 for two empty ones)."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(filled > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(filled, 1), 1.0)


def _of(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of many texts, in slices of about a megabyte."""
    out = [np.zeros((0, SLOTS), np.uint8)]
    for s in K.slices(pa.array(texts, pa.large_binary())):
        out.append(fingerprints(s.data, s.offsets))
    return np.concatenate(out)


def _starts(data: np.ndarray) -> np.ndarray:
    """Byte places where code points begin."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text with its last third replaced by the head of ``following``)."""
    at = _starts(np.frombuffer(text, np.uint8))
    n = len(at)
    third = n // 3
    if not third:
        return n, text
    head = following[: 4 * third]  # at most four bytes a code point
    begins = _starts(np.frombuffer(head, np.uint8))
    return n, text[: at[n - third]] + (head[: begins[third]] if len(begins) > third else head)


def _cuts(docs: DataFrame, parts: int) -> list:
    """Ids that part the table into about ``parts`` ranges, descending.

    Numbers by Spark's approximate quantiles; ids of another type by a sample of
    some thousand ids with the least hashes.  They bound the ranges, not the rows.
    """
    if parts < 2:
        return []
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        return sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 0.2 / parts)), reverse=True)
    some = sorted({r["doc_id"] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(min(20_000, 64 * parts)).collect()}, reverse=True)
    return some[:: max(1, len(some) // parts)][1:]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``last`` in partitions of consecutive rows, descending.

    Each partition ends with a copy of the row that follows it (``last``), so
    that every row meets its next one within its own task.  Ranges of ids come
    from Spark's approximate quantiles of the id column alone; only one row per
    range is looked up by its id.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, min(20000, input_bytes(docs) >> 22))
    cuts = _cuts(docs.where(F.col("doc_id").isNotNull()), parts)
    # range 0 has the largest ids; nulls come after all
    tree = lambda lo, hi: F.lit(lo) if lo == hi else F.when(F.col("doc_id") > cuts[(lo + hi) // 2], tree(lo, (lo + hi) // 2)).otherwise(tree((lo + hi) // 2 + 1, hi))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(tree(0, len(cuts)))
    ranged = docs.withColumn("part", place.cast("int"))
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # a row for each range
    owner = {r["head"]: heads[k - 1]["part"] for k, r in enumerate(heads)}
    ids = [h for h in owner if h is not None]
    found = docs.where(F.col("doc_id").isin(ids) if ids else F.lit(False))
    if None in owner:
        found = found.unionByName(docs.where(F.col("doc_id").isNull()))
    first = found.groupBy("doc_id").agg(F.max("text").alias("text"))
    to = F.create_map(*(F.lit(x) for h in ids for x in (h, owner[h]))) if ids else F.lit(None)
    copy = first.select("doc_id", "text", F.coalesce(to[F.col("doc_id")] if ids else to, F.lit(owner.get(None, 0))).cast("int").alias("part"), F.lit(True).alias("last"))
    both = ranged.withColumn("last", F.lit(False)).unionByName(copy.select("doc_id", "text", "part", "last"))
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.col("last"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def flush(whole: bool) -> pa.RecordBatch:
            """Rows whose next row is known; the last one stays."""
            own = _of(texts)
            pairs = [edited(a, b) for a, b in zip(texts, texts[1:])]
            other = _of([x for _, x in pairs])
            n = len(pairs)
            out = [pa.array(ids[:n], kind), pa.array([k for k, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, x in pairs], pa.string()), pa.array([x.tobytes().hex() for x in own[:n]], pa.string()), pa.array([x.tobytes().hex() for x in other], pa.string()), pa.array(likeness(own[:n], other)), pa.array(likeness(own[:n], own[1:]))]
            del ids[:n], texts[:n]
            return pa.RecordBatch.from_arrays(out, names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held > K.SLICE_BYTES and len(texts) > 1:
                    yield flush(False)
                    held = len(texts[0])
        if len(texts) > 1:
            yield flush(True)

    return in_order(docs).select("doc_id", "text").mapInArrow(walk, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every document, without a shuffle."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([x.tobytes().hex() for s in K.slices(column) for x in fingerprints(s.data, s.offsets)], pa.string())

    return docs.select("doc_id", of(F.col("text")).alias("fingerprint"))


def near_pairs(prints: DataFrame, bands: int = 64, least: float = 0.5, block: int = 2048) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints that are near, each named
    by the smallest doc_id that has it.  :func:`members` ties the copies to it.

    Fingerprints with the same slots in a band are candidates, and every two of a
    band's are verified, in blocks of ``block`` by ``block``; a pair that shares
    several bands comes from the first.  With 64 bands of two slots a pair of
    likeness 0.5 shares none with probability 0.75 ** 64, one in 100 million.
    Rows go out for near pairs only; fewer bands make fewer candidates.
    """
    width, id_type = 2 * SLOTS // bands, dict(prints.dtypes)["doc_id"]
    own = prints.where(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.substring(F.col("fingerprint"), k * width + 1, F.lit(width)).alias("slots")))
    keyed = own.select("rep", "fingerprint", F.explode(cut).alias("k")).select("rep", "fingerprint", "k.*").where(F.col("slots") != "0" * width)
    sizes = keyed.groupBy("band", "slots").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    at = keyed.join(sizes, ["band", "slots"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = at.withColumn("other", other).select("band", "slots", "rep", "fingerprint", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        band, i, j = (key[k].as_py() for k in (0, 2, 3))
        x = np.frombuffer(bytes.fromhex("".join(table["fingerprint"].to_pylist())), np.uint8).reshape(-1, SLOTS)
        where, rep, found = np.array(table["own"].to_pylist()), table["rep"].to_pylist(), []
        groups = np.flatnonzero(where == i), np.flatnonzero(where == j)
        parts = x.reshape(len(x), bands, -1)
        for k in groups[0]:
            to = groups[1][groups[1] > k] if i == j else groups[1]
            near = likeness(x[k][None], x[to])
            to, near = to[near >= least], near[near >= least]
            same = (parts[to, :band] == parts[k, :band]).all(axis=2) & (parts[to, :band] > 0).any(axis=2)
            first = ~same.any(axis=1)
            found += [(*sorted((rep[k], rep[t])), float(v)) for t, v in zip(to[first], near[first], strict=True)]
        kind = table["rep"].type
        return pa.table([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "likeness"])

    return dealt.groupBy("band", "slots", "i", "j").applyInArrow(verify, f"a {id_type}, b {id_type}, likeness double")


def members(prints: DataFrame) -> DataFrame:
    """doc_id, rep: the smallest doc_id with the same fingerprint."""
    own = prints.where(F.col("doc_id").isNotNull())
    return own.join(own.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "fingerprint").select("doc_id", "rep")
