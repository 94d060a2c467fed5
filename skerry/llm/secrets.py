"""Operator 9, secret scans: patterns plus password guess-cost dynamic programming.

Base spans come from three fixed patterns.  The method then looks at values in
a credential context (``pwd: ...``, ``login = ...`` and the like) that the
patterns don't take, and prices each by the cheapest way to guess it: a
minimum-cost segmentation into common words, dates, repeats, keyboard walks
and brute-force characters.  A value that costs at least
``10 ** min_log10`` guesses becomes a span of kind ``guess``.

Defined results: a null text is an empty text and has no spans; rows are
independent, so ties, repeats, null ids and extra columns have no effect.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K

KINDS = ("assign", "access", "hex", "guess")
BASE_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Further words that make the value after ``:`` or ``=`` a credential.
CONTEXT_KEYS = BASE_KEYS + (b"pwd", b"passphrase", b"passcode", b"credential", b"private_key", b"access_key", b"auth_key", b"login", b"bearer")
CONTEXT = re.compile(rb"""[a-z_]+["']?\x20*[:=]\x20*(?:"([^"\s]{8,})"|'([^'\s]{8,})'|([^\s"'<>,;]{8,}))""", re.I)

# Common password words, most frequent first.
COMMON_WORDS = (
    "password", "123456", "qwerty", "abc", "letmein", "monkey", "dragon", "iloveyou", "admin", "welcome", "login", "master", "hello", "freedom",
    "whatever", "secret", "token", "sunshine", "princess", "football", "baseball", "shadow", "superman", "batman", "trustno", "test", "pass", "user",
    "root", "guest", "default", "changeme", "example", "sample", "demo", "key", "api", "the", "and", "for", "you", "love", "summer", "winter",
    "spring", "autumn", "orange", "apple", "banana", "silver", "golden", "purple", "yellow", "green", "black", "white", "blue", "red", "house",
    "water", "light", "night", "angel", "tiger", "eagle", "horse", "mother", "father", "family", "friend", "happy", "lucky", "computer", "internet",
    "server", "system", "access", "private", "public", "service", "account", "company", "correct", "battery", "staple", "january", "february",
    "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday", "friday", "sunday", "none", "null",
    "true", "false", "string", "value", "your", "here", "redacted", "placeholder",
)
# Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d")
_NEXT = {a: {b for b in row[max(0, i - 1) : i + 2] if b != a} for row in KEYBOARD for i, a in enumerate(row)}


def guess_cost(value: str, words: dict[str, int], longest: int) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    Takes time in proportion to the length: words are looked up over at most
    ``longest`` characters, walks and repeats are extended one character at a
    time, and brute force costs a factor per character.  A segment may be any part
    of a walk or repeat, and is priced by what of it is past so far.
    """
    low, n = value.lower(), len(value)
    brute = math.log10(26 * (value != low) + 26 * any("a" <= c <= "z" for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value) or 10)
    best, run, walk, before_run, before_walk = [0.0] * (n + 1), 1, 1, 0.0, 0.0
    for j in range(1, n + 1):
        cost = best[j - 1] + brute
        for i in range(max(0, j - longest), j):
            rank = words.get(low[i:j])
            if rank is not None:
                case = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 0.3 * (j - i)
                cost = min(cost, best[i] + math.log10(rank + 1) + case + 0.3)
        for i in range(max(0, j - 10), j - 3):  # a date may begin and end anywhere
            if value[i].isdigit() and DATE.fullmatch(value, i, j):
                cost = min(cost, best[i] + 4.6)
        run = run + 1 if j > 1 and value[j - 1] == value[j - 2] else 1
        if run >= 3:
            before_run = best[j - 3] if run == 3 else min(before_run, best[j - 3])
            cost = min(cost, before_run + brute + math.log10(run))
        walk = walk + 1 if j > 1 and low[j - 1] in _NEXT.get(low[j - 2], ()) else 1
        if walk >= 4:
            before_walk = best[j - 4] if walk == 4 else min(before_walk, best[j - 4])
            cost = min(cost, before_walk + 1.7 + math.log10(walk) + 0.3)
        best[j] = cost
    return best[n]


def _positions(data: bytes, keys: tuple[bytes, ...]) -> list[int]:
    found: set[int] = set()
    for key in keys:
        at = data.find(key)
        while at >= 0:
            found.add(at)
            at = data.find(key, at + 1)
    return sorted(found)


def _sequence(pattern: re.Pattern, data: bytes, starts: list[int], ends: list[int], bounds: list[int]) -> list[tuple[int, re.Match]]:
    """Leftmost non-overlapping matches within each document, given every place
    where a match can start."""
    out, free, doc = [], 0, -1
    for at, d in zip(starts, ends, strict=True):
        if d != doc:
            doc, free = d, 0
        if at >= free and (m := pattern.match(data, at, bounds[d + 1])):
            out.append((d, m))
            free = m.end()
    return out


def _scan(column: pa.Array, words: dict[str, int], min_log10: float) -> pa.Array:
    empty, longest = hashlib.sha256(b"").hexdigest(), max(map(len, words), default=0)
    n = len(column)
    counts, digest, spans, costs = np.zeros((3, n), np.int64), [empty] * n, [""] * n, [None] * n
    hexes = np.zeros(256, bool)
    hexes[list(b"0123456789abcdef")] = True
    for s in K.slices(column):
        raw, bounds = s.data.tobytes(), s.offsets.tolist()
        low = raw.lower()

        def docs(starts: list[int], offsets: np.ndarray = s.offsets) -> list[int]:
            return (np.searchsorted(offsets, starts, side="right") - 1).tolist()

        found: list[tuple[int, int, int, int, float | None]] = []
        starts = _positions(low, BASE_KEYS)
        taken: dict[int, list[int]] = {}
        for d, m in _sequence(ASSIGN, raw, starts, docs(starts), bounds):
            if m.end(2) - m.start(2) >= 12:
                found.append((d, m.start(), 0, m.end(), guess_cost(m.group(2).decode(), words, longest)))
                taken.setdefault(d, []).extend(m.span())
        starts = _positions(raw, (b"AKIA",))
        for d, m in _sequence(ACCESS, raw, starts, docs(starts), bounds):
            if m.end() - m.start() >= 18:
                found.append((d, m.start(), 1, m.end(), None))
        w = K.spans(hexes[s.data], s.offsets)
        for k in np.flatnonzero(w.end - w.start >= 16):
            found.append((int(w.doc[k]), int(w.start[k]), 2, int(w.end[k]), None))
        starts = _positions(low, CONTEXT_KEYS)
        for d, m in _sequence(CONTEXT, raw, starts, docs(starts), bounds):
            begin, end = m.span(m.lastindex)
            if bisect_left(t := taken.get(d, []), end) - bisect_left(t, begin) or bisect_left(t, begin) % 2:
                continue  # a base span has it
            try:
                value = raw[begin:end].decode()
            except UnicodeDecodeError:
                continue
            if (cost := guess_cost(value, words, longest)) >= min_log10:
                found.append((d, begin, 3, end, cost))
        found.sort(key=lambda x: x[:3])
        k = 0
        while k < len(found):
            d, first = found[k][0], k
            while k < len(found) and found[k][0] == d:
                k += 1
            # code points before each byte
            before = np.concatenate([[0], np.cumsum((s.data[bounds[d] : bounds[d + 1]] & 0xC0) != 0x80)])
            own = [(kind, f"{KINDS[kind]}:{before[a - bounds[d]]}:{before[b - bounds[d]]}") for _, a, kind, b, _ in found[first:k]]
            row = s.lo + d
            for kind, _ in own:
                if kind < 3:
                    counts[kind, row] += 1
            digest[row] = hashlib.sha256(",".join(x for kind, x in own if kind < 3).encode()).hexdigest()
            spans[row] = ",".join(x for _, x in own)
            costs[row] = max((c for *_, c in found[first:k] if c is not None), default=None)
    return pa.StructArray.from_arrays(
        [*map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(costs, pa.float64())],
        ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "max_log10_guesses"],
    )


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_log10_guesses double"


def secrets(text: Column, words: tuple[str, ...] = COMMON_WORDS, min_log10: float = 10.0) -> Column:
    """Struct column with the spans of every secret in ``text``.

    Spans are ``kind:start:end`` in code points, end exclusive.
    """
    ranks = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}

    @F.arrow_udf(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _scan(batch, ranks, min_log10)

    return scan(text)


def scan_secrets(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its id, base counts and digest, all spans."""
    return docs.select("doc_id", secrets(F.col("text"), **options).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """The documents with every found span replaced by ``mask``; columns as given."""
    names = docs.columns

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            for a, b in sorted(((int(a), int(b)) for _, a, b in (x.split(":") for x in (found or "").split(",") if x)), reverse=True):
                text = text[:a] + mask + text[max(a, b) :]
            out.append(text)
        return pa.array(out, pa.string())

    found = secrets(F.col("text"), **options)["spans"]
    return docs.select(*(cut(F.col("text"), found).alias("text") if c == "text" else F.col(f"`{c}`") for c in names))
