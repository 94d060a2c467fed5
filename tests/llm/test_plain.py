"""Query results against plain versions that go text by text."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import features, fingerprints, kernels, lm, quality, queries, secrets, toxicity


def word_hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(kernels.hash_spans(data, kernels.Words(np.array([0]), np.array([len(word)]), np.array([0])))[0])


def mix(x: int) -> int:
    return int(kernels.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])


def split(text: str) -> list[bytes]:
    return [w for w in text.encode().translate(bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))).split(b" ") if w]


def plain_quality(text, weights, bias):
    half, down = 1 << 16, 64 - 16
    words = split(text)
    hashes = [word_hash(w) for w in words]
    buckets = [h >> down for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        buckets.append((0 if a == b else mix(a * 3 + b)) >> down)
    for k in (3, 4):
        for i in range(len(text) - k + 1):
            code = 0
            for c in text[i : i + k]:
                code = (code * 0x01000193 + ord(c)) & 0xFFFFFFFF
            code = ((code ^ code >> 15) * 0x9E3779B1) & 0xFFFFFFFF
            buckets.append(half + (code >> 16))
    return 1 / (1 + math.exp(-(bias + sum(float(weights[b]) for b in buckets) / max(1, len(buckets)))))


def test_quality_scores(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = quality.fit(docs.where(~quality.held_out(5, 0)), labels)
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, tables).collect()}
    for r in docs.where("length(text) < 2000").limit(40).collect():
        want = plain_quality(r["text"], weights, bias)
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9) and got[r["doc_id"]]["predicted"] == (want >= 0.3)


def plain_toxicity(text, weights, bias):
    low = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    count = {}
    for w in low.split(b" "):
        for k in (0, 4, 5, 6, 7, 8):
            if w and len(w) > k:
                b = mix(word_hash(w[:k] if k else w) + k) >> 46
                count[b] = count.get(b, 0) + 1
    return np.mean([1 / (1 + math.exp(-(o + sum(w[b] * math.log2(1 + n) for b, n in count.items())))) for w, o in zip(weights, bias, strict=True)])


def test_toxicity_scores(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.fit(docs.where(~toxicity.held_out(4, 2)), labels)
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, tables).collect()}
    for r in docs.where("length(text) < 4000").limit(40).collect():
        want = plain_toxicity(r["text"], weights, bias)
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9) and got[r["doc_id"]]["predicted"] == (want >= 0.3)


def plain_fingerprint(text: bytes) -> list[int]:
    space = b"\t\n\x0b\x0c\r "
    cuts = [0]
    for i in range(3, len(text)):
        a, b, c = text[i - 3 : i]
        h = ((a * 0x01000193 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
        if c in space and h >> 29 < 2:
            cuts.append(i)
    slots = {}
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        for k in range(a, b, fingerprints.MOST):
            piece, at, symbol = text[k : min(b, k + fingerprints.MOST)], 0, 0
            steps = len(piece) * fingerprints.STEPS_PER_BYTE
            for j in range(steps):
                symbol = (symbol * 0x01000193 + piece[at]) & 0xFFFFFFFF
                at = min(len(piece) - 1, at + int(fingerprints.WALK[j][piece[at]]))
                if j % fingerprints.BAND == fingerprints.BAND - 1:
                    h = ((symbol ^ (j * 0x27D4EB2F & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
                    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                    slots[h >> 25] = min(slots.get(h >> 25, 1 << 31), h & 0x1FFFFFF)
                    symbol = 0
            if 0 < steps < fingerprints.BAND:
                h = symbol * 0x9E3779B1 & 0xFFFFFFFF
                slots[h >> 25] = min(slots.get(h >> 25, 1 << 31), h & 0x1FFFFFF)
    return [slots[k] % 255 + 1 if k in slots else 0 for k in range(fingerprints.SLOTS)]


def test_fingerprints_and_likeness(spark, tables):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, tables).collect()}
    small = [i for i in order if len(texts[i]) < 3000 and len(texts[after[i]]) < 3000][:30]
    assert len(small) > 10
    for i in small:
        own, other = plain_fingerprint(texts[i]), plain_fingerprint(texts[after[i]])
        edited = plain_fingerprint(fingerprints.edited(texts[i], texts[after[i]])[1])
        assert bytes.fromhex(rows[i]["fingerprint"]) == bytes(own) and bytes.fromhex(rows[i]["edited_fingerprint"]) == bytes(edited)
        for name, x in (("near_edited", edited), ("near_next", other)):
            filled = [(a, b) for a, b in zip(own, x, strict=True) if a or b]
            assert rows[i][name] == pytest.approx(sum(a == b for a, b in filled) / len(filled) if filled else 1.0)


def test_text_ids_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "input_bytes", lambda docs: 12 << 22)
    texts = {f"id{k:03}": f"text number {k} with some words " * (k % 5 + 1) for k in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_with_next(docs).collect()}
    want = {i: hashlib.sha256(fingerprints.edited(texts[i].encode(), texts[j].encode())[1]).hexdigest() for i, j in zip(order, order[1:] + order[:1], strict=True)}
    assert rows == want


def plain_cost(value, words):
    low, n = value.lower(), len(value)
    brute = math.log10(26 * (value != low) + 26 * any("a" <= c <= "z" for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value) or 10)
    dates = {(a, b) for a in range(n) for b in range(a + 4, min(n, a + 10) + 1) if secrets.DATE.fullmatch(value[a:b])}
    best = [0.0] + [math.inf] * n
    row = lambda a, b: any(abs(r.find(a) - r.find(b)) == 1 for r in secrets.KEYBOARD if a in r and b in r)
    for j in range(1, n + 1):
        same = max(k for k in range(1, j + 1) if len(set(value[j - k : j])) == 1)
        walk = max(k for k in range(1, j + 1) if all(row(a, b) for a, b in zip(low[j - k : j], low[j - k + 1 : j])))
        for i in range(j):
            piece, cost = value[i:j], math.inf
            if j - i == 1:
                cost = brute
            if low[i:j] in words:
                case = 0.0 if piece == low[i:j] else 0.3 if piece.istitle() or piece.isupper() else 0.3 * (j - i)
                cost = min(cost, math.log10(words[low[i:j]] + 1) + case + 0.3)
            if (i, j) in dates:
                cost = min(cost, 4.6)
            if 3 <= j - i <= same:
                cost = min(cost, brute + math.log10(same))
            if 4 <= j - i <= walk:
                cost = min(cost, 1.7 + math.log10(walk) + 0.3)
            best[j] = min(best[j], best[i] + cost)
    return best[n]


def test_guess_costs():
    rng = random.Random(7)
    ranks = {w: i + 1 for i, w in enumerate(secrets.COMMON_WORDS)}
    parts = [*secrets.COMMON_WORDS[:40], "qwerty", "asdf", "0987", "aaaa", "111", "1999", "2024-01-31", "Zx9", "#", "PassWord", "DRAGON", "kM"]
    for _ in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        assert secrets.guess_cost(value, ranks, max(map(len, ranks))) == pytest.approx(plain_cost(value, ranks)), value


def test_dates_that_overlap():
    rng, ranks = random.Random(20), {"may": 0}
    values = ["08220240131196802027", "120220240101", "2024-01-012024"] + ["".join(rng.choice("0123129-") for _ in range(20)) for _ in range(400)]
    for value in values:
        assert secrets.guess_cost(value, ranks, 3) == pytest.approx(plain_cost(value, ranks)), value
    assert secrets.guess_cost(values[0], ranks, 3) < 13.3


def test_lm_of_unusual_texts(spark):
    """Slices without a heavy pair, and a null id beside the id "None" with the same text."""
    rows = [("a", "the cat sat on the mat"), ("b", "the cat sat on the mat"), ("c", "zzz"), (None, "the cat"), ("None", "the cat"), ("", "the cat")]
    for parts in (1, 3, 6):
        got = lm.scores(spark.createDataFrame(rows, "doc_id string, text string").repartition(parts)).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or "") for r in got) == sorted((d is None, d or "") for d, _ in rows)
        assert all(r["score"] < 0 for r in got)


def test_lm_sends_few_bytes(spark):
    """No shuffle moves more than 8 bytes for a token of the texts."""
    context = spark.sparkContext
    before = {k for k, _ in _shuffled(context)}
    tokens = sum(r["n_tokens"] for r in lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect())
    assert 0 < max(size for k, size in _shuffled(context) if k not in before) < 8 * tokens


def _shuffled(context):
    """Every stage so far, and the bytes that it wrote for a shuffle."""
    jvm = context._gateway.jvm
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]


def test_lm_pairs_and_places(spark, edge, monkeypatch):
    """Buckets hold the training counts of pairs, documents find their own tokens, whatever a flush holds."""
    hot = np.unique(lm.tokens(next(kernels.slices(pa.array(["the of"])))).word)
    want, whole = Counter(), []
    docs = edge.select("doc_id", "text")
    for r in docs.select("doc_id", "text", (~lm.held_out(7, 2)).alias("train")).collect():
        t = lm.tokens(next(kernels.slices(pa.array([r["text"] or ""]))))
        pairs = list(zip(t.word.tolist(), t.context.tolist(), strict=True))
        want.update({p: r["train"] * n for p, n in Counter(pairs).items()})
        whole.append((str(r["doc_id"]), sorted(pairs)))
    for flush in (lm.FLUSH, 50):
        monkeypatch.setattr(lm, "FLUSH", flush)
        rows = lm.pair_rows(docs, hot, 4).collect()
        got, sent, found = Counter(), {}, []
        for r in sorted((r for r in rows if r["place"] >= 0), key=lambda r: r["place"]):
            words, many, contexts, place, n = lm._unpack(r["data"])
            pairs = list(zip(np.repeat(np.cumsum(words.view(np.uint64)), many).tolist(), np.cumsum(contexts)[place].tolist(), strict=True))
            assert pairs == sorted(set(pairs)) and not set(pairs) & set(got)
            got.update(dict(zip(pairs, n.tolist(), strict=True)))
            flushes, sizes, steps = lm._unpack(r["sent"])
            ends = np.cumsum(sizes)
            for k, a, b in zip(flushes.tolist(), ends - sizes, ends, strict=True):
                sent.setdefault(k, []).extend(pairs[i] for i in np.cumsum(steps[a:b]))
        for r in rows:
            if r["place"] < 0:
                steps, sizes, _ = lm._unpack(r["data"])
                ends = np.cumsum(sizes)
                found += [(str(i), sorted(sent[r["flush"]][k] for k in np.cumsum(steps[a:b]))) for i, a, b in zip(r["ids"], ends - sizes, ends, strict=True)]
        assert got == want and set(got) == set(want) and sorted(found) == sorted(whole)


def test_guess_spans(spark):
    """Spans of kind guess are the credential values of the contexts that cost enough."""
    values = ["Xk9#mQ2$vL7!", "password123", "correcthorse", "Tr0ub4dor&3xQz", "aaaaaaaaaaaa", "qwertyuiop12"]
    texts = [f"note {k}: login = {v} end" for k, v in enumerate(values)]
    ranks = {w: i + 1 for i, w in enumerate(secrets.COMMON_WORDS)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(docs).collect():
        v = values[r["doc_id"]]
        at = texts[r["doc_id"]].index(v)
        want = f"guess:{at}:{at + len(v)}" if plain_cost(v, ranks) >= 10 else ""
        assert r["spans"] == want


def test_language_model_ties_and_whole_scores(spark):
    """Equal texts score alike, a text's score is not above 0, and likelier texts score better per token."""
    docs = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "the dog sat on the rug") for i in range(60)] + [(100 + i, "zq xv jk wq pz") for i in range(7)], "doc_id long, text string")
    rows = lm.scores(docs).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert len({round(score[i], 9) for i in range(0, 60, 2)}) == 1 and max(score.values()) <= 0
    assert score[0] > max(score[100 + i] for i in range(7))


def test_pipeline_edges(spark, edge, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    bench = spark.createDataFrame([(1, "the quick brown fox"), (2, None)], "item_id long, text string")
    for name, docs in (("some", edge), ("none", edge.where(F.lit(False)))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        now = docs
        for stage, f in pipeline.STAGES[:-1]:
            out = f(spark, now, folder)
            assert out.columns == docs.columns, stage
            now = spark.createDataFrame(out.collect(), docs.schema)
        rows = pipeline.run(spark, folder).collect()
        assert (len(rows) > 10) == (name == "some")


def test_feature_rows_of_empty_texts():
    s = next(kernels.slices(__import__("pyarrow").array(["", "é", ""])))
    row, bucket = features.subwords(s)
    assert set(row.tolist()) == {1} and len(bucket) == 1
