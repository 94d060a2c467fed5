"""Hard negatives, lexical search and archives against plain versions, over edge cases too."""

import base64
import gzip
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import catalog, lexical, negatives, warc
from skerry.llm.negatives import hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int, rank int, other string"
ITEMS = "item_id long, text string, score int"
PAGES = "page_id long, url string, html string, record_id string, revisit int"


@pytest.mark.parametrize("name", ("op11_hard_negatives", "op12_lexical_search", "op13_warc"))
def test_against_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, tables).toPandas()[want.columns]
    assert len(want) and sorted(map(tuple, got.astype(object).where(got.notna(), None).astype(str).values)) == sorted(map(tuple, want.astype(object).where(want.notna(), None).astype(str).values))


# --- hard negatives -----------------------------------------------------------


def plain_negatives(rows, every):
    good = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    good, out = list(good), []
    dot = lambda a, b: max(-negatives.MOST, min(negatives.MOST, sum(x * y for x, y in zip(a, b))))
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted({(-dot(v, w), j, k == label) for j, k, w in good if j != i})
        for s, j, _ in [x for x in scored if x[2]][:5]:
            window = [(t, m) for t, m, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, n, m, -s, -t) for n, (t, m) in enumerate(window[:5], 1)]
    return sorted(out)


def vector_rows():
    rng = random.Random(11)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(400):
        c = centres[rng.randrange(4)]
        rows.append((i - 30, [x + rng.gauss(0, 0.2) for x in c], rng.randrange(4), 0, "x"))
    rows += [(1000 + i, list(centres[0]), i % 2, 0, "x") for i in range(60)]  # ties
    rows += [(1000, list(centres[0]), 0, 0, "x")] * 9  # repeats
    rows += [(None, list(centres[0]), 0, 0, "x"), (2000, None, 0, 0, "x"), (2010, [0.1, None], 0, 0, "x"), (2020, [math.nan] * 12, 0, 0, "x"), (2030, [math.inf] * 12, 0, 0, "x"), (2040, [0.5] * 12, None, 0, "x")]
    rows += [(2050, [], 0, None, None), (2060, [0.9, -0.3], 1, 1, "x"), (2070, [0.0] * 12, 2, 1, "x"), (2080, [-x for x in centres[0]], 0, 1, "x")]
    return rows


def test_negatives_by_brute_force(spark, monkeypatch):
    rows = vector_rows()
    want = plain_negatives(rows, 10)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == want and len(want) > 300
    monkeypatch.setattr(negatives, "CHUNK_BYTES", 4000)  # several chunks of anchors
    monkeypatch.setattr(negatives, "PAIRS", 300)  # many small pieces
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == want


def test_negatives_of_huge_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, 3e6, 2e30]) * rng.uniform(-1, 1) for _ in range(6)], i % 3, 0, "") for i in range(60)]
    got = hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 3)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 0, "")], VECTORS)
    assert hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0


def test_discarded_pairs_cannot_qualify():
    rng = np.random.default_rng(3)
    whole = np.floor(rng.normal(0, 40, (300, 16)) + np.linspace(90, 0, 16))
    turn, cuts = np.linalg.eigh(whole.T @ whole)[1][:, ::-1], [2, 4, 8]
    turned = whole @ turn
    rest = np.sqrt(np.column_stack([(turned[:, c:] ** 2).sum(axis=1) for c in [0, *cuts]]))
    x = negatives.Vectors(np.arange(300), np.zeros(300, np.int64), whole, turned, rest)
    low, high = np.full(300, 60_000.0), np.full(300, 90_000.0)
    i, j, score = negatives.survivors(x, x, cuts, np.ones((300, 300), bool), low, high)
    full = (whole @ whole.T).astype(np.int64)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero((full >= 60_000) & (full <= 90_000))))) and np.array_equal(score, full[i, j])


# --- lexical search -----------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)})) if text else []


def plain_search(docs, items, most=10):
    words = [(d, plain_terms(t)) for d, t in docs]
    big_n, big_l = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df, by = {}, {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for i, t in items:
        if i is not None:
            by.setdefault(i, set()).update(plain_terms(t))
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for i, terms in by.items():
        scored = []
        for d, w in words:
            m = 10 + (90 * len(w) * big_n) // big_l if w else 0
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, n, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def search_tables(edge_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "漢字", "naïve", "longerthaneightletters", "longerthaneightletterz", "prefixes1", "prefixes2"]
    text = lambda n: " ".join(vocabulary[min(rng.randrange(70), rng.randrange(len(vocabulary)))].replace("w1", "W1") for _ in range(n))
    docs = [(r[0], r[1]) for r in edge_rows] + [(500 + i, text(rng.randrange(1, 60))) for i in range(300)] + [(900 + i, "same text w3 w4") for i in range(40)]
    items = [(i, text(12)) for i in range(12)] + [(20, None), (21, "..."), (None, "w1 w2"), (22, "w3"), (22, "W4 w3"), (23, "nowhere"), (24, "the of w1"), (25, "longerthaneightletters"), (26, "É naïve 漢字")]
    return docs, items


def test_search_by_brute_force(spark, edge_rows):
    docs, items = search_tables(edge_rows)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, rank string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    want = plain_search(docs, items)
    for options in ({}, {"shard_bytes": 300}, {"block": 30}):
        got = lexical.search(d, b, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want, options
    assert sorted(map(tuple, lexical.search(d, b, most=1, shard_bytes=2000).collect()), key=str) == plain_search(docs, items, 1)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b", 0)], ITEMS)
    assert lexical.search(docs, items).count() == lexical.search(some[0], items).count() == lexical.search(docs, some[1]).count() == 0
    named = spark.createDataFrame([("x", "b")], "item_id string, text string")
    assert [tuple(r) for r in lexical.search(spark.createDataFrame([("k", "a b"), ("j", "c")], "doc_id string, text string"), named).select("item_id", "doc_id").collect()] == [("x", "k")]


def test_non_essential_lists_lose_nothing():
    rng = np.random.default_rng(8)
    n = rng.integers(5, 50, 400)
    doc, term = np.unique(np.column_stack([rng.integers(0, 400, 3000), (rng.integers(0, 30, 3000) * rng.random(3000)).astype(int)]), axis=0).T
    tf, weights = rng.integers(1, 4, len(doc)), rng.integers(0, 3000, 30)
    shard = lexical.Shard(n, doc, term, tf, weights, 400, int(n.sum()))
    terms, full = np.arange(0, 30, 2), np.zeros(400, np.int64)
    for t in terms:
        full[shard.docs[shard.first[t] : shard.first[t + 1]]] += shard.value[shard.first[t] : shard.first[t + 1]]
    for least in np.unique(full[full > 0])[::7]:
        docs, score = shard.best(terms, int(least))
        assert docs.tolist() == np.flatnonzero(full >= least).tolist() and score.tolist() == full[docs].tolist()


# --- archives -----------------------------------------------------------------

HTML = "<p>a payload that\nseveral pages have</p>"


def page_rows():
    odd = ["WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", "\n", "\r", "a\n", "\x00é漢\r\r\n", "z" * 300_000, "", "no end", "WARC/1.1"]
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(odd)] + [(100, None, None), (101, "http://x/ \r\nEvil: 1", "x\n\n"), (-5, "http://é/", HTML), (None, "u", "only one without an id"), (None, None, HTML)]
    rows += [(200 + i, f"http://b/{i}", HTML) for i in range(50)] + [(-5, "http://é/", HTML), (300, "", "tiny"), (301, "", "tiny")]
    return [(*r, "r", 1) for r in rows]


def plain_report(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= least and (h or "") in first and i != first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", (0, 5))
def test_archives_by_brute_force(spark, least):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    assert sorted(map(tuple, warc.archive_report(df, least).collect()), key=str) == plain_report(rows, least)


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = page_rows()
    assert sorted(map(tuple, warc.archive_report(spark.createDataFrame(rows, PAGES)).collect()), key=str) == plain_report(rows)


def test_archive_files_by_themselves(spark, tmp_path):
    rows = page_rows()
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), f"file://{tmp_path}/w", date="2024-01-02T03:04:05Z")
    found = []
    for f in Path(tmp_path, "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            h = dict(line.split(": ", 1) for line in lines[1:])
            n = int(h["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n" and h["WARC-Date"] == "2024-01-02T03:04:05Z" and "Evil" not in h
            found.append((h, rest[:n].partition(b"\r\n\r\n")[2]))
            data = rest[n + 4 :]
    assert len(found) == len(rows)
    ids = {h["WARC-Record-ID"] for h, _ in found if h["WARC-Type"] == "response"}
    for h, payload in found:
        if h["WARC-Type"] == "revisit":
            assert payload == b"" and h["WARC-Refers-To"] in ids and h["WARC-Profile"] == warc.PROFILE
        else:
            assert h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    back = warc.read_archives(spark, f"file://{tmp_path}/w", payloads=True)
    assert sorted(bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()) == sorted(p for h, p in found if h["WARC-Type"] == "response")


def test_damaged_archive(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\nshort"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_foreign_archive(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n\xff\xfe\nbinary\n"
    records = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + b"WARC/1.0\r\nwarc-type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(records[:60]) + gzip.compress(records[60:]))  # several members
    rows = warc.read_archives(spark, f"file://{tmp_path}", payloads=True).collect()
    assert [r["record_type"] for r in rows] == ["warcinfo", "response"] and bytes(rows[1]["payload"]) == b"\xff\xfe\nbinary\n" and rows[1]["page_id"] is None


def test_archives_of_nothing(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGES)).count() == 0
