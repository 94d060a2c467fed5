"""Operator 7, MinHash near-dedup by an LSH forest.

A document's set holds its distinct ``words``-word shingles; documents whose
sets have a Jaccard similarity of ``similarity`` per cent or more are linked.

1. One pass makes each document's set hash (128 bits, so equal sets meet as
   one class with its smallest doc_id) and MinHash signature.
2. The forest: each tree sorts the classes by another sequence of signature
   values.  The sort is a range partitioning with the id as last key, so a
   large region of near copies spreads over tasks.  Neighbours in a tree that
   share a prefix of ``depth`` values at least are candidates; in a crowded
   region neighbours share longer prefixes, so the depth adapts by itself.
   Each class brings a 32-byte sketch along, and pairs that it shows to be
   far below the threshold go at once.
3. Confirmation on full sets, in two rounds: first each class with its most
   alike candidate, which usually joins a group; then every candidate pair
   whose ends are still in different components.  A pair inside a component
   can't change the result and needs no check.  Each pair meets the components
   once and full sets once at most.
4. A region with more classes than the window shows has lost candidates.  There
   every class outside the region's largest component is compared with the
   whole region by signature, in blocks of ``BLOCK`` by ``BLOCK`` classes.  This
   only tells which classes have an alike one in a block; those go there again
   with their full sets, and the block's task confirms pair after pair, skipping
   what earlier links of the block have joined.  Tables hold a row for a class
   in a block and a link for each join, never anything for a pair; the pairs of a
   crowd that isn't joined are compared inside the tasks.

A linked pair is missed only if no tree has it in one region (at the threshold a
tree does with probability 0.51, so 24 trees miss one in 30 million), or if fewer
than ``least`` of the 64 sketch values agree (one in 80,000 at the threshold, one
in 25 million at 0.85), and no other pairs join the two.

Defined results: null, empty and wordless texts have an empty set and are
linked with nothing.  Rows that share a doc_id are one document.  A row with a
null doc_id takes no part: its component is null and it is kept.  Equal texts
and ties of likeness are settled by the smallest doc_id; a very long text is one
slice of a batch, and its set is as long as its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.components import components
from skerry.llm.shared import fresh, written

U64 = np.uint64
VALUES = 64
TREES = 24
KEY_VALUES = 8
BLOCK = 1024
_MULTIPLIERS = K.mix64(np.arange(1, VALUES + 1, dtype=U64) * U64(7919)) | U64(1)
_LOWER = K.lowered()
_TREE_ORDER = np.stack([np.random.default_rng(t).permutation(VALUES)[:KEY_VALUES] for t in range(TREES)])


def sets(s: K.Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds by row): each row's distinct shingles, ascending."""
    docs = s.hi - s.lo
    w = K.word_spans(s.data, s.offsets)
    h = K.hash_spans(_LOWER[s.data], w)
    count = np.bincount(w.doc, minlength=docs)
    take = max(0, len(h) - words + 1)
    with np.errstate(over="ignore"):
        shingle = np.zeros(take, U64)
        for k in range(words):
            shingle = shingle * U64(0x9E3779B97F4A7C15) + h[k : k + take]
        shingle = K.mix64(shingle)
        inside = w.doc[:take] == w.doc[words - 1 : words - 1 + take] if take else np.zeros(0, bool)
        shingle, doc = shingle[inside], w.doc[:take][inside]
        few = np.flatnonzero((count > 0) & (count < words))
        if len(few):
            first = (np.cumsum(count) - count)[few]
            whole = np.zeros(len(few), U64)
            for k in range(words - 1):
                more = count[few] > k
                whole[more] = whole[more] * U64(0x9E3779B97F4A7C15) + h[first[more] + k]
            shingle = np.concatenate([shingle, K.mix64(whole + count[few].astype(U64))])
            doc = np.concatenate([doc, few])
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32 if docs > 32767 else np.int16), kind="stable")]
    shingle, doc = shingle[order], doc[order]
    if len(shingle):
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
        shingle, doc = shingle[new], doc[new]
    return shingle, np.searchsorted(doc, np.arange(docs + 1))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set hash (k1, k2), signature (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1), rows=8192):
                shingle, bounds = sets(s, words)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
                least = np.zeros((len(full), VALUES), "<u4")
                if len(full):
                    start = bounds[:-1][full]
                    with np.errstate(over="ignore"):
                        k1[full] = np.add.reduceat(K.mix64(shingle), start)
                        k2[full] = np.add.reduceat(K.mix64(shingle ^ U64(0x5DEECE66D1234567)), start)
                        for k, a in enumerate(_MULTIPLIERS):
                            least[:, k] = np.minimum.reduceat(((shingle * a) >> U64(32)).astype(np.uint32), start)
                blob: list[bytes | None] = [None] * len(n)
                for i, row in zip(full.tolist(), least):
                    blob[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(blob, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "signature"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, k1 long, k2 long, signature binary")


def _fixed(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return K.buffers(column)[0].reshape(-1, width).view(kind)


def candidates(classes: DataFrame, depth: int, window: int, least: int, partitions: int) -> DataFrame:
    """(x, y, alike): neighbours in any tree; alike is the number of equal sketch
    values.  Rows with a region instead name the regions wider than the window.

    Neighbours are sought within ranges, then among the first and last rows of
    all ranges, so that no border parts them.
    """
    id_type, names = dict(classes.dtypes)["rep"], ["x", "y", "alike", "region"]
    schema = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("sketch", pa.binary())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            value = _fixed(batch.column(1), 4 * VALUES, "<u4")
            nibble = (value & 15).astype(np.uint8)
            sketch = pa.array([x.tobytes() for x in nibble[:, ::2] | nibble[:, 1::2] << 4], pa.binary())
            for t, order in enumerate(_TREE_ORDER):
                key = (value[:, order] & 0xFFFF).astype(">u2")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array([x.tobytes() for x in key], pa.binary()), batch.column(0), sketch], ["tree", "key", "rep", "sketch"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What :func:`neighbours` gives, then the first and last rows of the range."""
        first: list[pa.RecordBatch] = []
        last: list[pa.RecordBatch] = []
        rows = 0

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal last, rows
            for batch in batches:
                if rows < window and batch.num_rows:
                    first.append(batch.slice(0, window - rows))
                rest = batch.slice(max(0, window - rows))
                rows += batch.num_rows
                tail = pa.Table.from_batches([*last, rest]) if batch.num_rows else None
                if tail is not None:
                    last = tail.slice(max(0, tail.num_rows - window)).to_batches()
                yield batch

        for out in neighbours(watched()):
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(out.num_rows, f.type) for f in schema)], [*names, *schema.names])
        for b in first + last:
            none = pa.nulls(b.num_rows, b.schema.field(2).type)
            yield pa.RecordBatch.from_arrays([b.column(2), none, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary()), b.column(0), b.column(1).cast(pa.binary()), b.column(3).cast(pa.binary())], [*names, *schema.names])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), _fixed(batch.column(1), 2 * KEY_VALUES, ">u2"), batch.column(2), _fixed(batch.column(3), VALUES // 2, "u1"))
            if held is None:
                tree, key, rep, sketch = now
            else:
                tree, key, sketch = (np.concatenate([held[i], now[i]]) for i in (0, 1, 3))
                rep = pa.concat_arrays([held[2], now[2]])
            old = 0 if held is None else len(held[0])
            for step in range(1, window + 1):
                at = np.arange(max(old, step), len(tree))
                at = at[(tree[at] == tree[at - step]) & (key[at, :depth] == key[at - step, :depth]).all(axis=1)]
                if step == window and len(at):
                    wide = _regions(tree[at], key[at, :depth])
                    none = pa.nulls(len(wide), rep.type)
                    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(wide), pa.int32()), pa.array(wide, pa.binary())], names)
                differ = sketch[at] ^ sketch[at - step]
                alike = ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)
                at, alike = at[alike >= least], alike[alike >= least]
                if len(at):
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(at - step)), rep.take(pa.array(at)), pa.array(alike.astype(np.int32)), pa.nulls(len(at), pa.binary())], names)
            held = (tree[-window:].copy(), key[-window:].copy(), rep.slice(max(0, len(rep) - window)), sketch[-window:].copy())

    planted = classes.select("rep", "signature").mapInArrow(plant, f"tree int, key binary, rep {id_type}, sketch binary")
    ordered = planted.repartitionByRange(partitions, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    shown = f"x {id_type}, y {id_type}, alike int, region binary"
    within = written(ordered.mapInArrow(ends, f"{shown}, tree int, key binary, sketch binary"), "ranges")
    # a tree's borders lie together and in order
    borders = within.where("tree IS NOT NULL").select("tree", "key", F.col("x").alias("rep"), "sketch").repartition(TREES, "tree").sortWithinPartitions("tree", "key", "rep")
    return within.where("tree IS NULL").select(*names).unionByName(borders.mapInArrow(neighbours, shown))


def _regions(tree: np.ndarray, prefix: np.ndarray) -> list[bytes]:
    """Different (tree, prefix) pairs as bytes, the tree first."""
    return sorted({bytes([t]) + k.tobytes() for t, k in zip(tree.tolist(), prefix.astype(">u2"))})


def _alike_places(row: np.ndarray, every: np.ndarray, low: np.ndarray, tree: int, depth: int, least: int, other: np.ndarray) -> np.ndarray:
    """Places of the signatures in ``every`` (``low``: their lower halves) that are
    alike and of an ``other`` component, the most alike first.  Pairs that a
    tree before this one has in one region are left to that tree."""
    alike = (every == row).sum(axis=1)
    at = np.flatnonzero((alike >= least) & other)
    if tree and len(at):
        same = low[at] == (row & 0xFFFF).astype(np.uint16)
        at = at[~same[:, _TREE_ORDER[:tree, :depth]].all(axis=2).any(axis=1)]
    return at[np.argsort(-alike[at], kind="stable")]


def _signatures_of(table: pa.Table, column: str) -> np.ndarray:
    return _fixed(table[column], 4 * VALUES, "<u4")


def crowded(classes: DataFrame, regions: DataFrame, depth: int, least: int) -> DataFrame:
    """Which classes still have to be confirmed in which block of ``regions``:
    region, i, j, rep and own (whether the class is one of the block's askers).

    classes: rep, n_shingles, signature, component.  Of two components in a
    region, one at least isn't its largest; each of that one's classes meets the
    whole region, in blocks (i, j).  A block has a row at most for each of its
    classes on either side.
    """
    id_type = dict(classes.dtypes)["rep"]
    shown = f"region binary, i int, j int, rep {id_type}, own boolean"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = _fixed(batch.column(1), 4 * VALUES, "<u4")
            for t, order in enumerate(_TREE_ORDER):
                prefix = (value[:, order[:depth]] & 0xFFFF).astype(">u2")
                yield pa.RecordBatch.from_arrays([pa.array([bytes([t]) + k.tobytes() for k in prefix], pa.binary()), batch.column(0)], ["region", "rep"])

    def compare(key: tuple, some: pa.Table, every: pa.Table) -> pa.Table:
        asking, wanted = [], np.zeros(every.num_rows, bool)
        if some.num_rows and every.num_rows:
            x, y = _signatures_of(some, "own_signature"), _signatures_of(every, "signature")
            ids, parts, low = some["own_component"].to_pylist(), np.array(every["component"].to_pylist(), object), (y & 0xFFFF).astype(np.uint16)
            for i, row in enumerate(x):
                at = _alike_places(row, y, low, key[0].as_py()[0], depth, least, parts != ids[i])
                if len(at):
                    asking.append(i)
                    wanted[at] = True
        reps = pa.concat_arrays([some["own_rep"].combine_chunks().take(pa.array(asking, pa.int64())), every["rep"].combine_chunks().filter(pa.array(wanted))])
        n = len(reps)
        columns = [pa.array([key[0].as_py()] * n, pa.binary()), *(pa.array([key[c].as_py()] * n, pa.int32()) for c in (1, 2))]
        return pa.table([*columns, reps, pa.array(np.arange(n) < len(asking))], ["region", "i", "j", "rep", "own"])

    own = classes.select("rep", "signature").mapInArrow(spread, f"region binary, rep {id_type}").join(regions, "region")
    members = written(own.join(classes, "rep"), "crowds")
    units = F.sum(1 + F.col("n_shingles") / 2048)  # long texts fill a block sooner
    counts = members.groupBy("region", "component").agg(units.alias("n"))
    sizes = counts.groupBy("region").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    blocks, others = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.greatest((F.col("size") - F.col("top")) / BLOCK, F.lit(1))).cast("int")
    one = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sized = members.join(sizes, "region")
    some = sized.where(F.col("component") != F.col("main")).select(F.col("region").alias("own_region"), *(F.col(c).alias(f"own_{c}") for c in ("rep", "component", "signature")), one(others).alias("own_i"), each(blocks).alias("own_j"))
    every = sized.select("region", "rep", "component", "signature", one(blocks).alias("j"), each(others).alias("i"))
    keys = ["region", "i", "j"]
    return some.groupBy(*(f"own_{k}" for k in keys)).cogroup(every.groupBy(*keys)).applyInArrow(compare, shown)


def joining(asked: DataFrame, classes: DataFrame, full: DataFrame, similarity: int, depth: int, least: int) -> DataFrame:
    """Links (a, b) between the classes that :func:`crowded` names, confirmed on full
    sets block by block; within a block, pairs that earlier links already join
    are skipped, so a block has fewer links than classes."""
    id_type, keys = dict(asked.dtypes)["rep"], ["region", "i", "j"]
    rows = asked.join(classes.select("rep", "signature", "component"), "rep").join(full, "rep")

    def confirm(key: tuple, some: pa.Table, every: pa.Table) -> pa.Table:
        above: dict = {}
        found: list[tuple] = []

        def top(c: object) -> object:
            while c in above:
                c = above[c]
            return c

        if some.num_rows and every.num_rows:
            x, y = _signatures_of(some, "own_signature"), _signatures_of(every, "signature")
            low, reps, part = (y & 0xFFFF).astype(np.uint16), every["rep"].to_pylist(), every["component"].to_pylist()
            parts, blobs = np.array(part, object), [np.frombuffer(b.as_buffer(), U64) for b in every["blob"].combine_chunks()]
            for row, rep, c, blob in zip(x, some["own_rep"].to_pylist(), some["own_component"].to_pylist(), some["own_blob"].combine_chunks(), strict=True):
                own = np.frombuffer(blob.as_buffer(), U64)
                for k in _alike_places(row, y, low, key[0].as_py()[0], depth, least, parts != c).tolist():
                    a, b = top(c), top(part[k])
                    if a != b and _alike(own, blobs[k], similarity):
                        above[a] = b
                        found.append((rep, reps[k]))
        return pa.table([pa.array([p[i] for p in found], every["rep"].type) for i in (0, 1)], ["x", "y"])

    some = rows.where("own").select(*(F.col(c).alias(f"own_{c}") for c in rows.columns))
    every = rows.where("NOT own")
    found = some.groupBy(*(f"own_{k}" for k in keys)).cogroup(every.groupBy(*keys)).applyInArrow(confirm, f"x {id_type}, y {id_type}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _places(ids: list, bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(str(i).encode()) for i in ids], U64).reshape(-1, 1)
    with np.errstate(over="ignore"):
        return (h + np.arange(4, dtype=U64) * ((h >> U64(32)) | U64(1))) & U64(bits - 1)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, most_mb: int = 64) -> DataFrame:
    """rep, blob: the sets of all documents in ``wanted`` (doc_id), and of a few more.

    A Bloom filter of the wanted ids (of ``most_mb`` at most; a fuller one only
    lets more through) goes to the tasks, so no text is shuffled.
    """
    spark = docs.sparkSession
    wanted = wanted.distinct()
    bits = min(most_mb << 23, 1 << max(13, (16 * wanted.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[_places(batch.column(0).to_pylist(), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())], ["bits"])

    table = np.zeros(bits // 8, np.uint8)
    for row in wanted.coalesce(16).mapInArrow(build, "bits binary").toLocalIterator():
        table |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_pylist(), bits).astype(np.int64)
            hit = ((shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1)
            batch = batch.filter(pa.array(hit))
            for s in K.slices(batch.column(1)):
                shingle, bounds = sets(s, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array([shingle[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["rep", "blob"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(shingled, f"rep {dict(docs.dtypes)['doc_id']}, blob binary")


def _alike(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two ascending sets are alike enough."""
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= similarity * (len(x) + len(y) - common)


def _linked(similarity: int) -> Column:
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([_alike(np.frombuffer(x, U64), np.frombuffer(y, U64), similarity) for x, y in pairs], pa.bool_())

    return linked(F.col("left"), F.col("right"))


def confirmed(pairs: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = pairs.join(full.select(F.col("rep").alias("a"), F.col("blob").alias("left")), "a")
    both = left.join(full.select(F.col("rep").alias("b"), F.col("blob").alias("right")), "b")
    return both.where(_linked(similarity)).select("a", "b")


def between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """a, b, alike, ca, cb: the pairs whose ends are in different components (ca, cb)."""
    at = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.select("a", "b", "alike").join(at("a"), "a", "left").join(at("b"), "b", "left")
    return both.select("a", "b", "alike", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``label`` after more links, which are followed between
    components instead of between documents."""
    over = between(links.select("a", "b", F.lit(0).alias("alike")), label).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    up = written(components(written(over, "links")), "labels")
    old = label.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(old.unionByName(up.join(label, "node", "left_anti").select("node", "component")), "labels")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, depth: int = 3, window: int = 4, least: int = 38) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs, words), "signatures")
    classes = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes")
    # ranges of about a million planted rows, and as many as shuffles have at least
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), TREES * classes.count() >> 20)
    shown = written(candidates(classes, depth, window, least, partitions), "neighbours")
    pairs = written(shown.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("alike").alias("alike")), "candidates")
    repeated = _repeats(signed)

    def sets_of(some: DataFrame) -> DataFrame:
        full = full_sets(docs, some.toDF("doc_id"), words)
        return written(full.dropDuplicates(["rep"]) if repeated else full, "sets")

    full = sets_of(pairs.select(F.explode(F.array("a", "b"))))

    ends = pairs.select("a", "b", "alike").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("alike", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    label = components(written(confirmed(best, full, similarity), "links"))
    left = between(pairs.join(best, ["a", "b"], "left_anti"), label)
    rest = written(confirmed(left.select("a", "b"), full, similarity), "links")
    if not rest.isEmpty():
        label = merged(label, rest)
    regions = written(shown.where("region IS NOT NULL").select("region").distinct(), "regions")
    if not regions.isEmpty():
        labelled = classes.select("rep", "n_shingles", "signature").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "n_shingles", "signature", F.coalesce("component", "rep").alias("component"))
        asked = written(crowded(labelled, regions, depth, least), "asked")
        if not asked.isEmpty():
            more = written(joining(asked, labelled, sets_of(asked.select("rep")), similarity, depth, least), "links")
            if not more.isEmpty():
                label = merged(label, more)
    named = classes.select("k1", "k2", "rep").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(signed: DataFrame) -> bool:
    return not signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a smaller doc_id represents; columns as given."""
    own = fresh(docs, "gone")
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
