"""Every operator over nulls, empty and long texts, repeats, extra columns, and empty tables."""

import pytest
from pyspark.sql import functions as F

from skerry.llm import decontamination, fingerprints, langid, linededup, lm, neardup, packing, quality, secrets, toxicity

BENCH = "item_id long, text string, extra int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox", 0), (None, "no id", 0), (2, None, 0), (3, "...", 0), (1, "the quick brown fox", 0), (4, "two words", 1)], BENCH)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(100, 120)] + [(None, 1, 1), (6, None, None), (7, 1, None), (999, 1, 1), (100, 0, 1)]
    return spark.createDataFrame(rows, LABELS)


def operators(bench, labels):
    return {
        "op1": lambda d: langid.identify(d, sample=50),
        "op2": lambda d: linededup.line_report(d),
        "op3": lambda d: decontamination.contamination(d, bench),
        "op4": lambda d: toxicity.score_toxicity(d, labels),
        "op5": lambda d: quality.score_quality(d, labels),
        "op6": lambda d: lm.scores(d),
        "op7": lambda d: neardup.near_duplicates(d),
        "op8": lambda d: fingerprints.compare_with_next(d),
        "op9": lambda d: secrets.scan_secrets(d),
    }


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 10)])
def test_one_row_each(name, edge, edge_rows, bench, labels):
    rows = operators(bench, labels)[name](edge).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -99 for r in rows) == sorted(-99 if r[0] is None else r[0] for r in edge_rows)
    repeated = [tuple(r) for r in rows if r["doc_id"] == 6]
    assert name == "op8" or repeated[0] == repeated[1]


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 10)])
def test_empty_table(name, empty, spark, edge):
    none = spark.createDataFrame([], BENCH), spark.createDataFrame([], LABELS)
    assert operators(*none)[name](empty).count() == 0
    if name in ("op3", "op4", "op5"):
        assert operators(*none)[name](edge).count() == edge.count()


def test_packing_edges(edge, edge_rows, empty):
    rows = packing.pack(edge).collect()
    assert packing.pack(empty).count() == 0
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert len([r for r in rows if r["piece"] == 0]) == len(edge_rows)


def test_filters_keep_columns(edge, empty, bench):
    for f in (lambda d: linededup.dedup_lines(d), lambda d: decontamination.decontaminate(d, bench), lambda d: neardup.drop_near_duplicates(d), lambda d: langid.keep_identified(d, sample=50), lambda d: secrets.redact(d)):
        assert f(edge).columns == edge.columns
        assert f(empty).count() == 0


def test_decisions(edge, bench):
    langs = {r["doc_id"]: r for r in langid.identify(edge, sample=50).collect() if r["doc_id"] is not None}
    assert langs[1]["lang_pred"] == langs[2]["lang_pred"] == langs[10]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in langs.values())
    near = {r["doc_id"]: r for r in neardup.near_duplicates(edge).collect()}
    assert near[7]["component_id"] == near[8]["component_id"] == 6 and near[1]["kept"] and near[2]["n_shingles"] == 0
    assert near[None]["component_id"] is None and near[None]["kept"]
    found = {r["doc_id"]: r for r in decontamination.contamination(edge, bench).collect()}
    assert found[-3]["contaminated"] and found[-3]["n_hit"] == 2 and found[1]["n_words"] == 0


def test_redaction(spark):
    d = spark.createDataFrame([(1, "é token = \"0123456789abcdef01\" x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert secrets.redact(d).select("text").first()[0].startswith("é ")
    assert "0123" not in secrets.redact(d).select("text").first()[0]
    assert secrets.scan_secrets(d).select(F.col("n_assign") + F.col("n_hex")).first()[0] == 2
