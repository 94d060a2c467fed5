"""Semantics of stored tables and reports that the query tables don't reach."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skerry.functions import convert, names
from skerry.operators import reports, store
from skerry.streaming import feed


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_a_collapsed_listing_is_refused(spark):
    stored, live = spark.range(10).select(F.col("id").cast("string").alias("path")), spark.range(4).select(F.col("id").cast("string").alias("path"))
    with pytest.raises(ValueError, match="live listing of 4 rows against 10"):
        store.replace_listing(stored, live)
    assert store.replace_listing(stored.limit(8), live).count() == 4
    with pytest.raises(ValueError):
        store.replace_listing(stored.limit(0), live.limit(0))


def test_unconverted_content_is_an_error(spark):
    assert one(spark, reports.checked_markdown(F.lit("# a"))) == "# a"
    assert one(spark, reports.checked_markdown(F.lit('{"a":1}'), "json")) == '{"a":1}'
    for raw in ('  {"a":1}', "<?xml v?>"):
        with pytest.raises(PySparkException, match="unconverted"):
            one(spark, reports.checked_markdown(F.lit(raw)))


def test_seed_only_an_empty_baseline(spark):
    notes = spark.createDataFrame([("1", "a.note", "d", 5, 5, 0, False, False), ("2", None, None, 5, 5, 0, False, False), ("3", "x", "d", 5, 5, 0, True, False)], "id string, title string, parent_id string, modified long, created long, domain int, deleted boolean, is_dir boolean")
    paths = spark.createDataFrame([("d", "dir")], "id string, path string")
    base = spark.createDataFrame([("p",)], "path string")
    assert {r["path"] for r in store.seed(base.limit(0), notes, paths).collect()} == {"dir/a.md", ".md"}
    assert store.seed(base, notes, paths).count() == 0


def test_versions_of_a_folder(spark, tmp_path):
    for name, size in (("1", 5), ("2", 9), ("10", 9), ("3.index", 50), ("x", 70)):
        (tmp_path / name).write_bytes(b"a" * size)
    rows = store.versions(spark, str(tmp_path))
    assert sorted((r["version"], r["size"]) for r in rows.collect()) == [(1, 5), (2, 9), (10, 9)]
    assert tuple(store.richest(rows).first()) == (2, 9)
    assert store.richest(rows.limit(0)).count() == 0


def test_watched_changes_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a.md",), (".git/b.md",), ("c.db",), ("d.conflict.md",), ("e.note",)], "path string").write.json(str(source))
    stream = feed.watched(spark.readStream.schema("path string").json(str(source)))
    q = stream.writeStream.format("memory").queryName("watched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r["path"] for r in spark.table("watched").collect()} == {"a.md", "e.note"}


def test_html_of_open_and_nested_elements():
    to = convert.html_to_markdown
    assert to("<p>a<p>b</p>c") == "ab\nc"
    assert to("<b>x <i>y</b> z") == "**x y** z"
    assert to("<div>a<div>b</div>c</div>") == "ab\nc"
    assert to("<td>loose</td>") == "loose" and to("") == "" and to("a &unknown; &#xD800; b") == "a &unknown; &#xD800; b"
    assert to("<table><tbody><tr><td>1</td></tr></tbody></table>") == "| 1 |"


def test_names(spark):
    assert one(spark, names.stem_date(F.lit("2024年1月2日"))) == "2024-01-02" and one(spark, names.stem_date(F.lit("2024年1月2日.md"))) is None
    assert one(spark, names.without_stem_blanks(F.lit("a b/c  .md"))) == "a b/c.md" and one(spark, names.without_stem_blanks(F.lit("c  "))) == "c"
    assert one(spark, names.cached_name(F.lit("a\\b.md"), F.lit(0))) == "b.note"
    assert [one(spark, names.milliseconds(F.lit(x))) for x in (0.5, 12.34, 2500.0)] == ["500µs", "12.3ms", "2.50s"]


def test_conversions_are_dealt_to_tasks(spark, tables, tmp_path):
    """A table in one part of a file isn't converted by one task."""
    from skerry.plans import stored
    from skerry.sources.workload import spread

    for query in (stored.html_built, stored.xml_to_md):
        assert query(spark, tables).rdd.getNumPartitions() >= 4
    rows = spread(spark.range(0, 1000, 1, 1), "id", 50)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.rdd.getNumPartitions() == 20 and max(r["count"] for r in sizes) < 120 and rows.count() == 1000


def test_charts_are_dealt_once(spark, tables):
    """No step of a conversion has fewer tasks than the charts were dealt to, or moves them again."""
    import re

    from skerry.plans import stored

    plan = stored.mermaid_to_puml(spark, tables)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert moved and all(re.match(r"p_partkey#\d+L?, \d+", m) for m in moved) and "REPARTITION_BY_NUM" in plan
    assert "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan
