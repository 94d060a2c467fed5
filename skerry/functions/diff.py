"""Three-way merge, block hashes and deltas."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OURS, MIDDLE, THEIRS = "<<<<<<< LOCAL\n", "=======\n", ">>>>>>> CLOUD\n"


def split_lines(text: str) -> list[str]:
    """Lines with their feeds, all written as ``\\n``; no text has no lines."""
    lines = re.split(r"\r\n|\r|\n", text) if text else []
    return [x + "\n" for x in lines[:-1]] + lines[-1:]


def _changes(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Parts of ``a`` that ``b`` replaces: (from, to, from in b, to in b); what
    stays are the longest common runs of lines."""
    return [where for kind, *where in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if kind != "equal"]


def merge3(base: str, ours: str, theirs: str) -> tuple[str, int]:
    """(text, conflicts): changes of both sides; a region that both changed
    differently is kept twice between markers.

    Changes that touch are one region, as neither side has an unchanged line
    between them.
    """
    lines = [split_lines(x) for x in (base, ours, theirs)]
    edits = sorted((*e, side) for side in (1, 2) for e in _changes(lines[0], lines[side]))
    out, conflicts, at, k = [], 0, 0, 0
    shift = [0, 0, 0]  # place in a side's lines minus place in the base
    while k < len(edits):
        lo, hi = edits[k][0], edits[k][1]
        group = []
        while k < len(edits) and (not group or edits[k][0] < hi or edits[k][0] == lo or edits[k][0] == hi and edits[k][0] == edits[k][1]):
            group.append(edits[k])
            hi = max(hi, edits[k][1])
            k += 1
        out += lines[0][at:lo]
        texts = []
        for side in (1, 2):
            start = lo + shift[side]
            own = [e for e in group if e[4] == side]
            if own:
                shift[side] = own[-1][3] - own[-1][1]
            texts.append(lines[side][start : hi + shift[side]] if own else None)
        mine, other = texts
        if mine is None or other is None or mine == other:
            out += mine if mine is not None else other
        else:
            conflicts += 1
            out += [OURS, *mine, MIDDLE, *other, THEIRS]
        at = hi
    return "".join(out + lines[0][at:]), conflicts


def merged(base: Column, ours: Column, theirs: Column) -> Column:
    """Struct column text, conflicts, has_conflicts."""

    @F.arrow_udf("struct<text:string,conflicts:int,has_conflicts:boolean>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        rows = [merge3(x or "", y or "", z or "") for x, y, z in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int32()), pa.array([n > 0 for _, n in rows])], ["text", "conflicts", "has_conflicts"])

    return run(base, ours, theirs)


def block_hashes(docs: DataFrame, key: str, text: str = "text", size: int = 4096) -> DataFrame:
    """key, block, offset, length, hash of consecutive blocks of ``size`` characters."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size)))
    rows = docs.select(key, text, F.posexplode(starts).alias("block", "offset"))
    piece = F.substr(F.col(text), F.col("offset") + 1, F.lit(size))
    return rows.select(key, "block", "offset", F.length(piece).alias("length"), F.md5(piece).alias("hash"))


def block_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, block, change (added, removed, changed) by position."""
    a, b = (x.select(key, "block", F.col("hash").alias(n)) for x, n in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, [key, "block"], "full").withColumn("change", change).where("change IS NOT NULL").select(key, "block", "change")


#: A copy is 00, place and length; an insertion is 01, length and bytes; numbers are little-endian.
COPY, INSERT = "00", "01"


def _number(n: Column) -> Column:
    """An unsigned 32-bit number, little-endian, in hexadecimal."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1)))


def delta(old: Column, new: Column, size: int = 4096) -> Column:
    """What turns ``old`` into ``new`` (binaries, null is empty): copies of equal
    blocks at equal places, else the new bytes."""
    old, new = (F.coalesce(x, F.lit(b"")) for x in (old, new))
    n = F.octet_length(new)

    def change(at: Column) -> Column:
        block = F.substring(new, at + 1, F.lit(size))
        same = F.substring(old, at + 1, F.lit(size)) == block
        return F.when(same, F.concat(F.lit(COPY), _number(at), _number(F.octet_length(block)))).otherwise(F.concat(F.lit(INSERT), _number(F.octet_length(block)), F.hex(block)))

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.unhex(F.array_join(F.transform(starts, change), ""))


def _read_number(data: Column, at: Column) -> Column:
    """The number at a place (from 0); null if the data ends before."""
    digits = F.hex(F.substring(data, at + 1, F.lit(4)))
    return F.when(F.length(digits) == 8, F.conv(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long"))


def patched(old: Column, change: Column) -> Column:
    """``old`` with a :func:`delta` applied; an error if the delta is damaged.

    The operations' places are found one after another, each from the length of
    the one before; their bytes are put together once.
    """
    old, change = (F.coalesce(x, F.lit(b"")) for x in (old, change))
    end, step = F.octet_length(change).cast("long"), F.lit(5)

    def length(at: Column) -> Column:
        kind, copied, added = F.hex(F.substring(change, at.cast("int") + 1, F.lit(1))), _read_number(change, at.cast("int") + 5), _read_number(change, at.cast("int") + 1)
        whole = F.when(kind == COPY, F.when(copied.isNotNull(), F.lit(9).cast("long"))).when(kind == INSERT, F.when(at + 5 + added <= end, added + 5))
        wrong = F.when(kind.isin(COPY, INSERT), F.lit("an operation is cut off")).otherwise(F.lit("unknown operation"))
        return F.coalesce(whole, F.raise_error(wrong).cast("long"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("places"))
    # an operation has five bytes at least; steps after the last do nothing
    steps = F.when(end > 0, F.sequence(F.lit(1).cast("long"), F.floor(end / step) + 1)).otherwise(F.array().cast("array<long>"))
    follow = lambda s, _: F.when(s["at"] >= end, s).otherwise(F.struct((s["at"] + length(s["at"])).alias("at"), F.concat(s["places"], F.array(s["at"])).alias("places")))
    places = F.aggregate(steps, empty, follow)["places"]

    def content(at: Column) -> Column:
        at = at.cast("int")
        start, n = _read_number(change, at + 1), _read_number(change, at + 5)
        copy = F.when(start + n <= F.octet_length(old), F.hex(F.substring(old, start.cast("int") + 1, n.cast("int")))).otherwise(F.raise_error(F.lit("a copy reaches beyond the old content")).cast("string"))
        return F.when(F.hex(F.substring(change, at + 1, F.lit(1))) == COPY, copy).otherwise(F.hex(F.substring(change, at + 6, start.cast("int"))))

    return F.unhex(F.array_join(F.transform(places, content), ""))
