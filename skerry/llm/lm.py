"""Operator 6, language-model scores by a hierarchical Pitman-Yor model.

The model is a three-level restaurant hierarchy over words.  Every word that
comes before another has a restaurant of its own, however rare it is, and so has
a text's start.  Its parent is the restaurant of its class (the start, or a hash
of the word's last two bytes); all classes share one parent, the unigram
restaurant, whose base is uniform over the vocabulary and one unknown word.

1. Word counts of all training documents, by hash bucket.  Words with at least
   1/``HOT`` of all tokens (so at most ``HOT`` words) are hot.
2. Counts of (word before, word), by bucket: the word's, or for hot words the
   pair's.  Documents are read in flushes of ``FLUSH`` tokens; a flush sends each
   of its different pairs once, so no pair can fill a bucket.  A document keeps
   the places of its tokens' pairs in its flush, and a bucket the places of the
   flushes' pairs in its own.
3. Chinese-restaurant seating: with the restaurants' totals of the last round
   fixed, buckets are independent.  In each, Gibbs sweeps take all customers of
   a pair away, seat them anew one after another (in growing blocks once there
   are many), and accept the new seating by its importance weight; tables are
   the customers of the parent.  A word's class and unigram seats are in its
   bucket; those of hot words are a table of fixed size (word, class).  Totals
   of words' own restaurants are a table by word before: every bucket sends its
   part there and gets the totals of its contexts back.
4. Predictive probabilities are averaged over sweeps.  Each bucket answers each
   flush with the log probabilities (32 bits each) of the pairs it sent, in their
   order, and a flush sums them over its documents' tokens.

Words are known by 64-bit hashes (V words have about V*V/2**57 pairs alike),
contexts by 40 bits of them and their class (at most V*V/2**41 pairs of words share
a restaurant: one at 1.5 million words, one word in 200 at ten billion).  Numbers
travel sorted, as differences, in as few bytes as their largest needs, compressed;
tables between steps are deleted once the next one is written.

Defined results: a null or empty text is the end token alone.  Rows with a null
doc_id are held out.  Repeated rows train once each and score alike.  Without
training documents N = V = 0, and every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.langid import held_out
from skerry.llm.shared import dropped, input_bytes, written

U64 = np.uint64
HOT = 8192
CLASSES = 255
#: Class restaurants: the text's start and the classes.  Words have their own below.
CONTEXTS = 1 + CLASSES
END = U64(0x1F0E5A77C0DE0E4D)
START = U64(0x51A7B3C94D)
CONTEXT_BITS = 48  # 40 of the word's hash, 8 of its class
FLUSH = 3 << 19
_LOWER = K.lowered()


class Tokens(NamedTuple):
    doc: np.ndarray
    word: np.ndarray
    context: np.ndarray  # 40-bit hash of the word before, then its class: 0 at a text's start, else from 1


def tokens(s: K.Slice) -> Tokens:
    """Words of every row and one end token each, in order."""
    data, docs = _LOWER[s.data], s.hi - s.lo
    w = K.word_spans(s.data, s.offsets)
    count = np.bincount(w.doc, minlength=docs)
    total = len(w.start) + docs
    ends = np.cumsum(count + 1) - 1
    body = np.ones(total, bool)
    body[ends] = False
    word, suffix = np.full(total, END), np.zeros(total, np.int64)
    word[body] = K.hash_spans(data, w)
    last = data[w.end - 1].astype(np.int64)
    second = np.where(w.end - w.start > 1, data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    suffix[body] = (last * 31 + second) % CLASSES
    context = np.roll((word >> U64(24)) << U64(8) | (1 + suffix).astype(U64), 1)
    context[ends - count] = START << U64(8)
    return Tokens(np.repeat(np.arange(docs), count + 1), word, context)


def _pair(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64-bit hash of each pair."""
    return K.mix64(word * U64(0x9E3779B97F4A7C15) ^ K.mix64(context))


def _find(sorted_hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Place of each word in ``sorted_hashes``, -1 if it isn't there."""
    if not len(sorted_hashes):
        return np.full(len(word), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, word), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == word, at, -1)


def _bucket_bits(docs: DataFrame) -> int:
    return min(20, max(4, int(input_bytes(docs) >> 22).bit_length()))


def _part_bits(bits: int) -> int:
    """Contexts are dealt to fewer parts than pairs, so that a row holds more of them."""
    return max(3, bits - 3)


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0, each array in as few bytes a number as its largest needs,
    low bytes first, compressed."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out += [bytes([width]), len(a).to_bytes(4, "little"), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes) -> list[np.ndarray]:
    raw = pa.decompress(b[4:], int.from_bytes(b[:4], "little"), codec="zstd", asbytes=True)
    found, at = [], 1
    for _ in range(raw[0]):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 5], "little")
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
        found.append(out.view("<i8").ravel())
        at += 5 + n * width
    return found


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def _run_starts(a: np.ndarray) -> np.ndarray:
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return np.flatnonzero(new)


def _blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def word_counts(train: DataFrame, bits: int) -> DataFrame:
    """One row per bucket: sorted word hashes, counts, their sums and how many
    words occur once and twice."""
    partial = pa.schema([("bucket", pa.int32()), ("word", pa.binary()), ("n", pa.binary())])
    full = pa.schema([*partial, ("tokens", pa.int64()), ("types", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, which = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return word, np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def flush() -> pa.RecordBatch:
            word, n = merged()
            cuts = np.searchsorted((word >> U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
            held.clear()
            return _batch([(i, _blob(word[a:b], "<u8"), _blob(n[a:b], "<i8")) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a], partial)

        for batch in batches:
            for s in K.slices(batch.column(0), rows=8192):
                held.append(np.unique(tokens(s).word, return_counts=True))
                size += len(held[-1][0])
                if size > 2 * FLUSH:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        word, which = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in table["word"].to_pylist()]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([np.frombuffer(x, "<i8") for x in table["n"].to_pylist()])).astype(np.int64)
        return pa.Table.from_batches([_batch([(table["bucket"][0].as_py(), _blob(word, "<u8"), _blob(n, "<i8"), int(n.sum()), len(n), int((n == 1).sum()), int((n == 2).sum()))], full)])

    return train.select("text").mapInArrow(count, "bucket int, word binary, n binary").groupBy("bucket").applyInArrow(merge, "bucket int, word binary, n binary, tokens long, types long, once long, twice long")


CELLS = "bucket int, word binary, context binary, n binary"
_CELLS = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("word", "context", "n"))])


def hot_rows(counts: DataFrame) -> DataFrame:
    """(word, class, customers) of 256 hot words a row, from (hot word * CONTEXTS + class, n)."""

    def merge(table: pa.Table) -> pa.Table:
        pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        return pa.Table.from_batches([_batch([(-1 - int(table["bucket"][0].as_py()), _blob(pair // CONTEXTS, "<u8"), _blob(pair % CONTEXTS, "<u2"), _blob(n, "<i8"))], _CELLS)])

    return counts.withColumn("bucket", F.expr(f"cast(pair div {256 * CONTEXTS} as int)")).groupBy("bucket").applyInArrow(merge, CELLS)


def pair_rows(docs: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """One row per bucket of words that aren't hot and of pairs of hot words (place >= 0),
    and one per flush of documents (place < 0).

    A bucket's data: words, how many pairs each has, contexts, and of every pair, in
    order of word and context, the context's number and the training count.  sent: the
    flushes, how many pairs each sent, and the numbers of these pairs.  A flush's data:
    of every document the numbers of its tokens' pairs among those that the flush sent
    (ascending, bucket by bucket), how many tokens it has, and whether it trains.
    """
    id_type = dict(docs.dtypes)["doc_id"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[pa.Array] = []
        learns: list[np.ndarray] = []
        task, number, size, rows = TaskContext.get().partitionId(), 0, 0, 0

        def flush() -> pa.RecordBatch:
            word, context, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            train, at = np.concatenate(learns), (task << 32) + number
            contexts, context = np.unique(context, return_inverse=True)
            context = context.astype(np.int32)
            words, dish = np.unique(word, return_inverse=True)
            del word
            place = _find(hot, words)
            common = np.flatnonzero((place >= 0)[dish]).astype(np.int32)
            bucket = (_pair(words[dish[common]], contexts[context[common]]) >> U64(64 - bits)).astype(np.int64)
            dish[common] = len(words) + bucket * len(hot) + place[dish[common]]
            del common, bucket
            dish *= len(contexts)
            dish += context
            del context
            pair, which = np.unique(dish, return_inverse=True)
            del dish
            n = np.bincount(which[train[doc]], minlength=len(pair))
            which += doc * np.int64(len(pair))
            which.sort()
            first = _run_starts(which // len(pair))
            sizes = np.diff(np.append(first, len(which)))
            which %= len(pair)
            step = _steps(which)
            step[first] = which[first]
            del which, doc
            dish, context = np.divmod(pair, len(contexts))
            is_hot = dish >= len(words)
            part, place = np.divmod(dish - len(words), max(1, len(hot)))
            word = words[np.where(is_hot, 0, dish)]
            word[is_hot] = hot[place[is_hot]]
            bucket = np.where(is_hot, part + (1 << bits), (word >> U64(64 - bits)).astype(np.int64))
            cuts = np.append(_run_starts(bucket), len(bucket))
            out = []
            for a, b in zip(cuts, cuts[1:]):
                own, numbers = np.unique(context[a:b], return_inverse=True)
                starts = _run_starts(word[a:b])
                out.append((int(bucket[a]), at, _pack(_steps(word[a:b][starts]), np.diff(np.append(starts, b - a)), _steps(contexts[own]), numbers, n[a:b])))
            out.append((-1 - at, at, _pack(step, sizes, train)))
            names = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0] * len(out) + [len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), lists], ["place", "flush", "data", "ids"])

        for batch in batches:
            for s in K.slices(batch.column(1), rows=8192):
                t = tokens(s)
                held.append((t.word, t.context, (t.doc + rows).astype(np.int32)))
                ids.append(batch.column(0).slice(s.lo, s.hi - s.lo))
                learns.append(batch.column(2).slice(s.lo, s.hi - s.lo).to_numpy(zero_copy_only=False))
                size, rows = size + len(t.word), rows + s.hi - s.lo
                if size > FLUSH:
                    yield flush()
                    ids.clear()
                    learns.clear()
                    number, size, rows = number + 1, 0, 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        if table["place"][0].as_py() < 0:
            return table.append_column("sent", pa.nulls(table.num_rows, pa.binary())).select(["place", "flush", "data", "sent", "ids"])
        table = table.sort_by("flush")
        parts = [_unpack(x) for x in table["data"].to_pylist()]
        words, dish = np.unique(np.concatenate([np.cumsum(p[0].view(U64)) for p in parts]), return_inverse=True)
        contexts, context = np.unique(np.concatenate([np.cumsum(p[2]) for p in parts]), return_inverse=True)
        shift = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
        dish = np.repeat(dish, np.concatenate([p[1] for p in parts]))
        context = context[np.concatenate([p[3] + k for p, k in zip(parts, shift, strict=True)])]
        sizes = np.array([len(p[3]) for p in parts])
        n = np.concatenate([p[4] for p in parts])
        del parts
        pair, which = np.unique(dish * len(contexts) + context, return_inverse=True)
        n = np.bincount(which, weights=n).astype(np.int64)
        dish, context = np.divmod(pair, len(contexts))
        sent = _steps(which)
        first = np.cumsum(sizes) - sizes
        sent[first] = which[first]
        data = _pack(_steps(words), np.bincount(dish), _steps(contexts), context, n)
        return pa.Table.from_arrays([table["place"][:1], pa.array([None], pa.int64()), pa.array([data], pa.binary()), pa.array([_pack(table["flush"].to_numpy(), sizes, sent)], pa.binary()), pa.nulls(1, table["ids"].type)], ["place", "flush", "data", "sent", "ids"])

    rows = docs.select("doc_id", "text", (~held_out(7, 2)).alias("train")).mapInArrow(spread, f"place long, flush long, data binary, ids array<{id_type}>")
    return rows.groupBy("place").applyInArrow(merge, f"place long, flush long, data binary, sent binary, ids array<{id_type}>")


def _continued(step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers from their differences, which begin anew in every group."""
    total, first = np.cumsum(step), np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - step[first], sizes)


class Totals(NamedTuple):
    """What buckets share: customers and tables of the class restaurants, and of the parent."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    discount: float
    parent_discount: float
    strength: float
    base: float  # probability of each word in the uniform base

    def back(self) -> np.ndarray:
        """Weight of the parent's probability, by context."""
        return (self.strength + self.discount * self.tables) / (self.strength + self.customers)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.parent_discount * tables + (self.strength + self.parent_discount * self.parent_tables) * self.base) / (self.strength + self.parent_customers)


def _seat(n: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seat ``n`` customers of each dish; ``weight``: the chance weight of a new
    table.  Returns tables and the log importance weight of the seating."""
    tables, log_weight = np.minimum(n, 1).astype(np.float64), np.zeros(len(n))
    active = np.flatnonzero(n > 1)
    active = active[np.argsort(-n[active], kind="stable")]
    size, w, t, lw, done = n[active], weight[active], np.ones(len(active)), np.zeros(len(active)), 1
    while len(size) and size[0] > done:
        k = int(np.searchsorted(-size, -done, side="left"))
        block = np.minimum(size[:k] - done, max(1, done // 16))
        norm = w[:k] + done - discount * t[:k]
        p = w[:k] / norm
        lw[:k] += block * np.log(norm)
        t[:k] += rng.random(k) < p if done < 32 else rng.binomial(block, p)
        done += max(1, done // 16)
    tables[active], log_weight[active] = t, lw
    return tables, log_weight


class Pairs:
    """The pairs of one row and the Gibbs sampler over their seating."""

    def __init__(self, word: bytes, context: bytes, n: bytes, totals: Totals, seed: int):
        self.word, self.context = np.frombuffer(word, "<u8"), np.frombuffer(context, "<u2").astype(np.int64)
        self.n, self.totals, self.rng = np.frombuffer(n, "<i8"), totals, np.random.default_rng(seed)
        new = np.ones(len(self.word), bool)
        new[1:] = self.word[1:] != self.word[:-1]
        self.dish = np.cumsum(new) - 1
        self.types = int(new.sum())
        self.count = np.bincount(self.dish, weights=self.n, minlength=self.types)
        self.tables = np.minimum(self.n, 1).astype(np.float64)
        self.log_weight = np.full(len(self.n), -np.inf)
        self.parent_tables = np.minimum(self.count, 1.0)

    def reset(self, n: np.ndarray) -> None:
        """New customers; what was seated for others is seated anew."""
        n = n.astype(np.int64)
        self.log_weight[n != self.n] = -np.inf
        self.n, self.tables = n, np.clip(self.tables, np.minimum(n, 1), n)

    def parent(self) -> np.ndarray:
        return self.totals.parent(np.bincount(self.dish, weights=self.tables, minlength=self.types), self.parent_tables)

    def sweep(self) -> None:
        g = self.totals
        weight = (g.strength + g.discount * g.tables[self.context]) * self.parent()[self.dish]
        tables, log_weight = _seat(self.n, weight, g.discount, self.rng)
        take = np.log(self.rng.random(len(self.n))) < log_weight - self.log_weight
        self.tables[take], self.log_weight[take] = tables[take], log_weight[take]
        customers = np.bincount(self.dish, weights=self.tables, minlength=self.types).astype(np.int64)
        root = np.full(self.types, (g.strength + g.parent_discount * g.parent_tables) * g.base)
        self.parent_tables = _seat(customers, root, g.parent_discount, self.rng)[0]

    def probability(self) -> np.ndarray:
        """Predictive probability of each pair under the present seating."""
        g = self.totals
        own = (self.n - g.discount * self.tables) / (g.strength + g.customers[self.context])
        return own + g.back()[self.context] * self.parent()[self.dish]

    def averaged(self, burn: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean predictive probability of each pair, and of each word in the parent."""
        own, above = np.zeros(len(self.n)), np.zeros(self.types)
        for k in range(burn + samples):
            self.sweep()
            if k >= burn:
                own, above = own + self.probability() / samples, above + self.parent() / samples
        return own, above


def _sums(rows: DataFrame, totals: Totals, sweeps: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(customers, tables by context, parent's tables, pairs seen once and twice) after some sweeps."""
    schema = pa.schema([("context", pa.int32()), ("customers", pa.int64()), ("tables", pa.int64()), ("parent_tables", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, tables, above, once, twice = np.zeros(CONTEXTS), np.zeros(CONTEXTS), 0.0, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                p = Pairs(r["word"], r["context"], r["n"], totals, r["bucket"] + (1 << 20))
                for _ in range(sweeps):
                    p.sweep()
                customers += np.bincount(p.context, weights=p.n, minlength=CONTEXTS)
                tables += np.bincount(p.context, weights=p.tables, minlength=CONTEXTS)
                above += p.parent_tables.sum()
                once, twice = once + int((p.n == 1).sum()), twice + int((p.n == 2).sum())
        some = np.flatnonzero(customers)
        first = np.arange(len(some)) == 0
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(customers[some].astype(np.int64)), pa.array(tables[some].astype(np.int64)), pa.array(np.where(first, int(above), 0)), pa.array(np.where(first, once, 0)), pa.array(np.where(first, twice, 0))], schema=schema)

    out = rows.select("bucket", "word", "context", "n").mapInArrow(seat, "context int, customers long, tables long, parent_tables long, once long, twice long").groupBy("context").agg(*(F.sum(c).alias(c) for c in schema.names[1:])).collect()
    customers, tables = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
    for r in out:
        customers[r["context"]], tables[r["context"]] = r["customers"], r["tables"]
    return customers, tables, float(sum(r["parent_tables"] for r in out)), np.array([sum(r["once"] for r in out), sum(r["twice"] for r in out)])


def _discount(once: float, twice: float) -> float:
    """The share taken from counts, from how many things occur once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


class Shared(NamedTuple):
    """What buckets need besides their own pairs and the totals of their contexts."""

    totals: Totals
    discount: float  # of the words' own restaurants
    hot: np.ndarray
    count: np.ndarray  # training counts of hot words
    table: np.ndarray  # probability of hot words by class
    bits: int


class Restaurants:
    """One bucket's pairs in the words' own restaurants, and the classes above.

    ``customers`` and ``tables`` are totals by context.  A pair seen once sits at one
    table always; only the others are seated anew.
    """

    def __init__(self, bucket: int, data: bytes, g: Shared):
        words, pairs, contexts, self.context, self.n = _unpack(data)
        self.contexts = np.cumsum(contexts)
        self.dish = np.repeat(np.arange(len(words)), pairs)
        words, kind = np.cumsum(words.view(U64)), (self.contexts & 255)[self.context]
        self.g, seed = g, bucket + (1 << 20)
        self.customers, self.own_tables = np.zeros(len(contexts)), np.zeros(len(contexts))
        self.rng = np.random.default_rng([seed, 1])
        self.tables, self.some = np.minimum(self.n, 1).astype(np.float64), np.flatnonzero(self.n > 1)
        self.log_weight = np.full(len(self.some), -np.inf)
        self.is_hot = bucket >= 1 << g.bits
        if self.is_hot:
            place = _find(g.hot, words)
            self.count, self.cell = g.count[place], place[self.dish] * CONTEXTS + kind
            self.fixed = g.table.ravel()[self.cell].astype(np.float64) if len(g.table) else np.zeros(len(self.n))
        else:
            self.count = np.bincount(self.dish, weights=self.n, minlength=len(words)).astype(np.int64)
            cells, self.cell = np.unique(self.dish * CONTEXTS + kind, return_inverse=True)
            self.classes = Pairs(_blob(words[cells // CONTEXTS], "<u8"), _blob(cells % CONTEXTS, "<u2"), _blob(self.up(len(cells)), "<i8"), g.totals, seed)

    def up(self, cells: int) -> np.ndarray:
        """Customers of the class restaurants: the tables below."""
        return np.bincount(self.cell, weights=self.tables, minlength=cells)

    def above(self) -> np.ndarray:
        return self.fixed if self.is_hot else self.classes.probability()[self.cell]

    def sweep(self) -> None:
        some = self.some
        above = self.fixed[some] if self.is_hot else self.classes.probability()[self.cell[some]]
        tables, log_weight = _seat(self.n[some], (self.g.totals.strength + self.g.discount * self.own_tables)[self.context[some]] * above, self.g.discount, self.rng)
        take = np.log(self.rng.random(len(some))) < log_weight - self.log_weight
        self.tables[some[take]], self.log_weight[take] = tables[take], log_weight[take]
        if not self.is_hot:
            self.classes.reset(self.up(len(self.classes.n)))
            self.classes.sweep()

    def probability(self) -> np.ndarray:
        """Predictive probability of each pair under the present seating."""
        strength, d = self.g.totals.strength, self.g.discount
        return (self.n - d * self.tables + (strength + d * self.own_tables)[self.context] * self.above()) / (strength + self.customers)[self.context]

    def averaged(self, burn: int, samples: int) -> np.ndarray:
        own = np.zeros(len(self.n))
        for k in range(burn + samples):
            self.sweep()
            if k >= burn:
                own += self.probability() / samples
        return own


def _restaurants(left: pa.Table, right: pa.Table, g: Shared) -> Restaurants | None:
    """A bucket with the totals that came back for its contexts."""
    if not left.num_rows:
        return None
    p = Restaurants(left["bucket"][0].as_py(), left["data"][0].as_py(), g)
    if right.num_rows:
        totals = [_unpack(x) for x in right.sort_by("part")["totals"].to_pylist()]  # contexts were asked for in order, part by part
        p.customers, p.own_tables = (np.concatenate(x).astype(np.float64) for x in zip(*totals, strict=True))
    return p


SEATED = "what int, part int, bucket int, x binary, y binary"
_SEATED = pa.schema([("what", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
ANSWERS = "bucket int, part int, totals binary"
_ANSWERS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("totals", pa.binary())])


def _buckets(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.where("place >= 0").select(F.col("place").cast("int").alias("bucket"), "data", *columns)


def _seated(rows: DataFrame, answers: DataFrame, shared: object, sweeps: int) -> DataFrame:
    """Every bucket after some sweeps.

    what 0: its contexts, their customers and tables, for each part of the contexts;
    1: customers of hot words' classes; 2: sums over the bucket.
    """

    def seat(left: pa.Table, right: pa.Table) -> pa.Table:
        g = shared.value
        p = _restaurants(left, right, g)
        if p is None:
            return _SEATED.empty_table()
        bucket = left["bucket"][0].as_py()
        for _ in range(sweeps):
            p.sweep()
        customers, tables = (np.bincount(p.context, weights=x, minlength=len(p.contexts)) for x in (p.n, p.tables))
        part = p.contexts >> (CONTEXT_BITS - _part_bits(g.bits))
        cuts = np.append(_run_starts(part), len(part))
        out = [(0, int(part[a]), bucket, _pack(_steps(p.contexts[a:b]), customers[a:b], tables[a:b]), b"") for a, b in zip(cuts, cuts[1:])]
        sums = np.zeros(2 * CONTEXTS + 5)
        sums[-5:-3] = (p.n == 1).sum(), (p.n == 2).sum()
        if p.is_hot:
            cell, which = np.unique(p.cell, return_inverse=True)
            out.append((1, 0, bucket, _blob(cell, "<i8"), _blob(np.bincount(which, weights=p.tables), "<i8")))
        else:
            c = p.classes
            sums[:CONTEXTS], sums[CONTEXTS : 2 * CONTEXTS] = (np.bincount(c.context, weights=x, minlength=CONTEXTS) for x in (c.n, c.tables))
            sums[-3:] = c.parent_tables.sum(), (c.n == 1).sum(), (c.n == 2).sum()
        out.append((2, 0, bucket, _blob(sums, "<f8"), b""))
        return pa.Table.from_batches([_batch(out, _SEATED)])

    return _buckets(rows).groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(seat, SEATED)


def _answers(seated: DataFrame) -> DataFrame:
    """Totals of the words' own restaurants, for every bucket that asked."""

    def total(table: pa.Table) -> pa.Table:
        bucket, part, asked = table["bucket"].to_pylist(), table["part"][0].as_py(), [_unpack(x) for x in table["x"].to_pylist()]
        which = np.unique(np.concatenate([np.cumsum(x[0]) for x in asked]), return_inverse=True)[1]
        customers, tables = (np.bincount(which, weights=np.concatenate([x[k] for x in asked])) for k in (1, 2))
        cuts = np.cumsum([0, *(len(x[0]) for x in asked)])
        return pa.Table.from_batches([_batch([(b, part, _pack(customers[which[i:j]], tables[which[i:j]])) for b, i, j in zip(bucket, cuts, cuts[1:], strict=False)], _ANSWERS)])

    return seated.where("what = 0").select("part", "bucket", "x").groupBy("part").applyInArrow(total, ANSWERS)


def _bucket_sums(seated: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * CONTEXTS + 5)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                out += np.frombuffer(x, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["x"])

    return sum((np.frombuffer(r["x"], "<f8") for r in seated.where("what = 2").select("x").mapInArrow(add, "x binary").collect()), np.zeros(2 * CONTEXTS + 5))  # a row for each task


def _cells(seated: DataFrame, hot: int) -> DataFrame:
    """(pair, n): customers of hot word * CONTEXTS + class."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(hot * CONTEXTS, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(x, "<i8")] += np.frombuffer(y, "<i8")
        some = np.flatnonzero(total)
        for k in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + (1 << 16)]), pa.array(total[some[k : k + (1 << 16)]])], ["pair", "n"])

    return seated.where("what = 1").select("x", "y").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _replies(rows: DataFrame, answers: DataFrame, shared: object, burn: int, samples: int) -> DataFrame:
    """For every bucket and flush: the log10 probabilities of the pairs that it sent
    (32 bits each), and how often each of their words was seen, with how many pairs."""
    schema = pa.schema([("flush", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _restaurants(left, right, shared.value)
        if p is None:
            return schema.empty_table()
        own = np.log10(np.maximum(p.averaged(burn, samples), 1e-300)).astype("<f4").view("<u4")
        flush, sizes, sent = _unpack(left["sent"][0].as_py())
        sent, cuts, out = _continued(sent, sizes), np.cumsum([0, *sizes]), []
        for k, a, b in zip(flush.tolist(), cuts, cuts[1:], strict=False):
            dish = p.dish[sent[a:b]]
            starts = _run_starts(dish)
            out.append((k, left["bucket"][0].as_py(), _pack(own[sent[a:b]], p.count[dish[starts]], np.diff(np.append(starts, b - a)))))
        return pa.Table.from_batches([_batch(out, schema)])

    return _buckets(rows, "sent").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, "flush long, bucket int, reply binary")


def _summed(rows: DataFrame, replies: DataFrame, id_type: str, n: int, v: int) -> DataFrame:
    """Every document's sums over the replies to its flush."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["ids"].combine_chunks().flatten()
        step, size, train = _unpack(left["data"][0].as_py())
        reply = [_unpack(x) for x in right.sort_by("bucket")["reply"].to_pylist()]  # a flush numbers its pairs bucket by bucket
        own = np.concatenate([x[0] for x in reply]).astype("<u4").view("<f4").astype(np.float64)
        count = np.concatenate([np.repeat(x[1], x[2]) for x in reply])
        token, first = _continued(step, size), np.cumsum(size) - size
        known, base, score = (np.add.reduceat(x[token], first) for x in ((count > 0).astype(np.int64), np.log10((count + 1) / (n + v + 1)), own))
        return pa.Table.from_arrays([ids, pa.array(train == 0), pa.array(size), pa.array(known), pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    docs = rows.where("place < 0").select("flush", "data", "ids")
    return docs.groupBy("flush").cogroup(replies.groupBy("flush")).applyInArrow(add, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _hot_table(rows: DataFrame, totals: Totals, hot: int, burn: int, samples: int) -> np.ndarray:
    """Probability of each hot word by class (hot * CONTEXTS numbers)."""
    schema = pa.schema([("word", pa.binary()), ("context", pa.binary()), ("own", pa.binary()), ("dish", pa.binary()), ("above", pa.binary())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = Pairs(r["word"], r["context"], r["n"], totals, r["bucket"] + (1 << 20))
                own, above = p.averaged(burn, samples)
                yield _batch([(r["word"], r["context"], _blob(own, "<f8"), _blob(np.unique(p.word), "<u8"), _blob(above, "<f8"))], schema)

    out = np.zeros((hot, CONTEXTS), np.float32)
    for r in rows.mapInArrow(score, "word binary, context binary, own binary, dish binary, above binary").toLocalIterator():
        dish, above = np.frombuffer(r["dish"], "<u8").astype(np.int64), np.frombuffer(r["above"])
        out[dish] = above[:, None] * totals.back()[None, :]
        out[np.frombuffer(r["word"], "<u8").astype(np.int64), np.frombuffer(r["context"], "<u2")] = np.frombuffer(r["own"])
    return out


def scores(docs: DataFrame, rounds: int = 2, burn: int = 2, samples: int = 3, strength: float = 1.0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10)."""
    spark, id_type, bits = docs.sparkSession, dict(docs.dtypes)["doc_id"], _bucket_bits(docs)
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out(7, 2))
    words = written(word_counts(train, bits), "words")
    n, v, once, twice = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice"))).first()
    least = max(1, -(-n // HOT))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                count = np.frombuffer(r["n"], "<i8")
                at = np.flatnonzero(count >= least)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["word"], "<u8")[at].view(np.int64)), pa.array(count[at])], ["word", "n"])

    found = words.select("word", "n").mapInArrow(common, "word long, n long").collect()  # HOT rows at most
    hot = np.array([r["word"] for r in found], np.int64).view(U64)
    count = np.array([r["n"] for r in found], np.int64)
    order = np.argsort(hot)
    hot, count = hot[order], count[order]
    dropped(words)

    rows = written(pair_rows(docs, hot, bits), "pairs")
    share = spark.sparkContext.broadcast
    g = Shared(Totals(np.zeros(CONTEXTS), np.zeros(CONTEXTS), 0.0, float(v), 0.5, _discount(once, twice), strength, 1 / (v + 1)), 0.5, hot, count, np.zeros((0, CONTEXTS), np.float32), bits)
    answers, cells = spark.createDataFrame([], ANSWERS), None
    for k in range(rounds + 1):  # the first one seats nobody, it only counts
        seated = written(_seated(rows, answers, share(g), burn if k else 0), "seated")
        dropped(answers if k else None, cells)
        answers, sums, cells = written(_answers(seated), "answers"), _bucket_sums(seated), written(hot_rows(_cells(seated, len(hot))), "cells")
        dropped(seated)
        customers, tables, above, seen = _sums(cells, g.totals, burn if k else 0)
        tables = tables + sums[CONTEXTS : 2 * CONTEXTS]
        totals = g.totals._replace(customers=customers + sums[:CONTEXTS], tables=tables, parent_customers=tables.sum())
        if k:
            totals = totals._replace(parent_tables=above + sums[-3])
        else:
            g = g._replace(discount=_discount(*sums[-5:-3]))
            totals = totals._replace(discount=_discount(*(seen + sums[-2:])))
        g = g._replace(totals=totals, table=_hot_table(cells, totals, len(hot), burn, samples))  # HOT * CONTEXTS * 4 bytes at most

    replies = written(_replies(rows, answers, share(g), burn, samples), "replies")
    dropped(answers, cells)
    return _summed(rows, replies, id_type, n, v)


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds each document's perplexity under the model."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
