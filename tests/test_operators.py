"""Semantics that the query tables don't reach."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from skerry.functions import convert, diagrams, diff, names, richtext, text
from skerry.operators import dedup, health, moves, notes, reconcile, state, trees
from skerry.plans.catalog import QUERIES
from skerry.sources import readers
from skerry.streaming import feed

REMOTE = "path string, id string, parent_id string, name string, mtime long, ctime long, domain int, cloud_hash string"
LOCAL = "path string, mtime long, size long, local_hash string"
BASE = "path string, file_id string, cloud_mtime long, local_mtime long, content_hash string, cloud_content_hash string, last_sync_at long, parent_id string, domain int, create_time long"


def sides(spark, r=(), l=(), b=()):  # noqa: E741
    return spark.createDataFrame(list(r), REMOTE), spark.createDataFrame(list(l), LOCAL), spark.createDataFrame(list(b), BASE)


def test_every_condition_has_one_rule(spark):
    """All 216 vectors of three two-valued and three three-valued conditions."""
    vectors = list(itertools.product(*[(True, False)] * 3, *[(True, False, None)] * 3))
    df = spark.createDataFrame(vectors, ", ".join(f"{c} boolean" for c in reconcile.CONDITIONS))
    rows = reconcile.matches(reconcile.classify(df)).collect()
    assert len(rows) == 216 and {r["matches"] for r in rows} == {1}
    assert [tuple(r[k] for k in ("bits", "hashes")) for r in spark.range(1000, 1001).select(text.bloom_sizes("id", 0.01).alias("s")).select("s.*").collect()] == [text.bloom_size(1000, 0.01)]


@pytest.mark.parametrize(("base", "state_"), [(("p", "F", 1000, 1000, "h", "h", 900, "d", 1, 800), "synced"), (("p", "F", 999, 1000, "h", "h", 900, "d", 1, 800), "cloudModifiedContent"), (("p", "F", 1000, 1000, "x", "h", 900, "d", 1, 800), "localModified"), (("p", "F", 0, 1000, "x", "h", 900, "d", 1, 800), "conflict"), (("p", "", 0, 0, "", None, 0, None, 0, 0), "synced"), (("p", "F", -1, 0, "x", None, 5, None, 0, 0), "cloudModifiedContent")])
def test_classify_both_sides(spark, base, state_):
    r, l, b = sides(spark, [("p", "F", "d", "p", 1000, 500, 1, "h")], [("p", 1000, 5, "h")], [base])  # noqa: E741
    assert reconcile.classify_all(r, l, b).first()["state"] == state_


def test_refine_and_directions(spark):
    r, l, b = sides(spark, [("p", "F", "d", "p", 2000, 500, 1, "h2")], [("p", 1000, 5, "h2")], [("p", "F", 1000, 1000, "h1", "h1", 900, "d", 1, 800)])  # noqa: E741
    df = reconcile.refine(reconcile.classify_all(r, l, b))
    assert df.first()["state"] == "bothModifiedConverged"
    gone = spark.createDataFrame([("localDeleted",), ("cloudNew",), ("localNew",), ("conflict",)], "state string")
    planned = {d: [x["action"] for x in reconcile.plan(gone, d, True).collect()] for d in ("pull", "push", "both")}
    assert planned == {"pull": ["deleteCloud", "download", "skip", "conflict"], "push": ["deleteCloud", "skip", "upload", "skip"], "both": ["deleteCloud", "download", "upload", "conflict"]}


def test_guardrails(spark):
    base = [(f"f{i}.md", f"F{i}", 100, 100, "h", "h", 100, "d", 1, 1) for i in range(10)]
    remote = [(f"f{i}.md", f"F{i}", "d", "n", 100, 1, 1, "h") for i in range(10)]
    r, l, b = sides(spark, remote, [], base)  # noqa: E741
    assert reconcile.guardrails(reconcile.plan(reconcile.classify_all(r, l, b), propagate_deletes=True), r, l, b).first()["status"] == "suspended"
    r, l, b = sides(spark, [], [("x.md", 1, 1, "h")], base)  # noqa: E741
    assert reconcile.guardrails(reconcile.plan(reconcile.classify_all(r, l, b)), r, l, b).first()["status"] == "aborted"


def test_upsert_keeps_what_is_better(spark):
    _, _, b = sides(spark, b=[("p", "F", 1, 1, "h", "c", 9, "d", 1, 8)])
    _, _, delta = sides(spark, b=[("p", "G", 2, 3, None, None, 0, None, None, 0), ("q", "Q", 1, 1, None, None, 0, None, None, 0)])
    rows = {r["path"]: r for r in state.upsert(b, delta).collect()}
    assert tuple(rows["p"]) == ("p", "G", 2, 3, "h", "c", 9, "d", 1, 8) and rows["q"]["domain"] == 1


def test_rename_collision_and_refs(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    ren = spark.createDataFrame([("a", "b"), ("c", "d")], "path string, new_path string")
    assert sorted(map(tuple, state.rename(t, ren).collect())) == [("b", 2), ("d", 3)]
    refs = spark.createDataFrame([("s", "x"), ("t", "y")], "source_path string, ref_path string")
    new = spark.createDataFrame([("s", "z"), ("s", "z")], "source_path string, ref_path string")
    assert sorted(map(tuple, state.replace_refs(refs, new).collect())) == [("s", "z"), ("t", "y")]
    log = spark.createDataFrame([(i, i * 10, "p") for i in range(5)], "id long, timestamp long, path string")
    assert state.log_tail(log).count() == 5 and state.log_after(log, 20).count() == 3


def test_moves(spark):
    schema = "path string, file_id string, hash string"
    old = spark.createDataFrame([("a/x.md", "1", ""), ("a/b/note.md", "", "h"), ("a/readme.md", "", ""), ("a/c/plan.md", "9", "")], schema)
    new = spark.createDataFrame([("z/x2.md", "1", ""), ("q/else.md", "", "h"), ("b/readme.md", "", ""), ("a/d/plan.md", "", "")], schema)
    found = {r["old_path"]: (r["new_path"], r["stage"]) for r in moves.cascade(old, new).collect()}
    assert found == {"a/x.md": ("z/x2.md", "id"), "a/b/note.md": ("q/else.md", "hash"), "a/c/plan.md": ("a/d/plan.md", "name")}
    classified = spark.createDataFrame([("a/x.md", "cloudDeleted"), ("z/x2.md", "cloudNew")], "path string, state string")
    applied = {r["path"]: (r["state"], r["old_path"]) for r in moves.apply_moves(classified, moves.by_id(old, new)).collect()}
    assert applied == {"a/x.md": ("gone", None), "z/x2.md": ("moved", "a/x.md")}


def test_dedup_assets(spark):
    files = spark.createDataFrame([("a.png", "h", 5, "1", 3), ("b/c.png", "h", 5, "2", 1), ("x.md", "k", 5, "3", 1), ("y/x.md", "k", 5, "", 1)], "path string, hash string, size long, file_id string, create_time long")
    refs = spark.createDataFrame([("a.png",)], "path string")
    got = {r["path"]: (r["remove"], r["reason"]) for r in dedup.actions(files, refs).collect()}
    assert got == {"a.png": (False, "assets"), "b/c.png": (True, "assets"), "x.md": (False, "mixed"), "y/x.md": (True, "mixed")}


def test_health(spark):
    r, l, b = sides(spark, [("p", "F", "d", "p", 50, 5, 1, "h")], [("p", 40, 5, "h")], [("p", "F", 0, 40, None, None, 0, "d", 1, 8), ("q", "", 1, 1, None, None, 0, None, 0, 0)])  # noqa: E741
    assert health.calibrate(r, l, b).first()["calibrated"] == 2
    assert [tuple(x) for x in health.drift(l, b).orderBy("path").collect()] == [("p", "hash"), ("q", "orphan")]


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_names(spark):
    v = lambda c: value(spark, c)
    assert v(names.sanitize(F.lit(' a<b>:"c"  d .md'))) == "a_bc d.md"
    assert [v(names.map_remote_name(F.lit(x))) for x in ("a.note", "b.clip", "c", "d.md", "e.PNG")] == ["a.md", "b.md", "c.md", "d.md", "e.PNG"]
    assert v(names.ancestor_depth(F.lit("a/b/c.md"), F.lit("a/x/c.md"))) == 1 and v(names.ancestor_depth(F.lit("c.md"), F.lit("a/c.md"))) == 0
    for pattern, path, hit in (("*.md", "a/b.md", True), ("src/*", "x/src/a/b", True), ("[!a].md", "b.md", True), ("[!a].md", "a.md", False), ("?.md", "ab.md", False)):
        assert v(names.allowed(F.lit(path), include=[pattern])) is hit
    assert [v(names.file_size(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert [v(names.file_size(F.lit(n), even)) for n in (1280, 1792, 1281) for even in (False, True)] == ["1.3 KB", "1.2 KB", "1.8 KB", "1.8 KB", "1.3 KB", "1.3 KB"]


def test_text(spark):
    v = lambda c: value(spark, c)
    same = ["* a\n\n>  \n| x |  y |\n|:--|---|\n", "- a\n|x|y|\n|---|---|"]
    assert len({v(text.normalize_markdown(F.lit(x))) for x in same}) == 1
    assert v(text.xxh(F.lit(""))) == health.EMPTY_HASH
    assert v(text.has_table(F.lit("a\n| x | y |\n|---|---|"))) and not v(text.has_table(F.lit("| x |")))
    assert text.bloom_size(1000, 0.01) == (9585, 6)
    assert tuple(value(spark, text.bloom_sizes(F.lit(618_496_000), 0.01))) == (5_928_320_266, 6)


def test_levelled_texts_without_words(spark, tmp_path):
    """As the query's SQL: an item without words is a dash, a null text has no item."""
    spark.createDataFrame([(0, "1 2"), (1, None), (2, "a b")], "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    rest = lambda w: ["---", "---", "---fence---", f"|{w}|x|", "|---|---|", f"12. {w}", w, f"> - {w}", f"a * [{w}] c https://x.y/{w}"]
    want = {0: ["-", *rest("none")], 1: rest("none"), 2: ["- a b", *rest("a")]}
    got = {r["doc_id"]: r["md5"] for r in QUERIES["md_normalize"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5("\n".join(v).encode()).hexdigest() for k, v in want.items()}


def test_html():
    html = "<h2>T</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><script>no</script>&amp;lt; &#65; &#x110000;"
    out = convert.html_to_markdown(html)
    assert "## T" in out and "**b**" in out and "[l](u)" in out and "- x" in out and "| A | B |\n| --- | --- |\n| 1 | 2 |" in out and "no" not in out and "< A &#x110000;" in out


def test_notes(spark):
    md = "# Title\n\n- one\n  - two\n\n1. n\n\n> quote **b**\n\n```py\nx = 1\n```\n\n| a | b |\n| -- | -- |\n| 1 | 2 |\n\n![](u)\n\nplain *i* and [l](h)"

    def back(text):
        made = richtext.markdown_to_notes(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t")
        return made.select(richtext.note_to_markdown("note")).first()[0]

    once = back(md)
    assert back(once) == once and back(None) is None and back("") == ""
    for piece in ("# Title", "- one\n  - two", "1. n", "> quote **b**", "```py\nx = 1\n```", "| 1 | 2 |", "![](u)", "plain *i* and ", "[l](h)"):
        assert piece in once
    notes_ = richtext.markdown_to_notes(spark.createDataFrame([(1, md)], "k long, t string"), "k", "t")
    counts = notes.table_counts(notes_, "key", "note").first()
    assert counts["tables"] == 1 and counts["rows"] == 2 and counts["shape"] == "native-table"
    texts = ["no json", '{"5":1}', '[{"5":[]}]', '{"5":[{"6":"h","4":{"l":"h0"},"5":[{"7":[{"8":"a"}]}]},{"6":"l","4":{"ll":"3"},"5":[{"7":[{"8":"b","9":[{"2":"b"},{"2":"i"}]}]}]},{"6":"t","5":[{"5":[{}]},{"5":[]}]},3]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, n string").select("k", richtext.note_to_markdown("n").alias("m"))
    assert [r["m"] for r in rows.orderBy("k").collect()] == ["", "", "", "# a\n\n    - ***b***\n\n|   |\n|\n|\n"]


def test_blocks_of_lines(spark):
    """Fences that open, close, or can only close; quotes; tables that begin within a run of rows."""
    lines = ["``` no opener", "a", "```py", "> code", "``` odd end", "> q", ">r", "| x |", "|a|", "|-|", "|1|", "", "```", "open"]
    got = richtext.line_blocks(spark.createDataFrame([(1, "\n".join(lines))], "k long, t string"), "k", "t").orderBy("n")
    assert [(r["kind"], r["block"]) for r in got.collect()] == [("single", 0), ("single", 1), ("code", 2), ("code", 2), ("code", 2), ("quote", 5), ("quote", 5), ("single", 7), ("table", 8), ("table", 8), ("table", 8), ("single", 11), ("code", 12), ("code", 12)]


def test_xml():
    xml = '<note xmlns="n"><head><list id="1" type="ordered"/></head><body><para><text>p</text></para><heading level="2"><text>h</text></heading><list-item list-id="1"><text>i</text></list-item><code><text>x</text><language>c</language></code></body></note>'
    assert convert.xml_to_markdown(xml) == "p\n\n## h\n\n1. i\n\n```c\nx```"


def test_flowcharts(spark):
    codes = ['graph LR\nA["Start"] --> B["End"]\nB -.-> C\nstyle A fill:#f00,color:#fff', "sequenceDiagram\nA->>B: x", 'flowchart BT\nA-->B\nB -->|why not| C\nC -- so --- D\nD(("x")) ==> E{"y"}\nbroken -->\nE', ""]
    out = diagrams.mermaid_to_plantuml(spark.createDataFrame(list(enumerate(codes)), "k long, c string"), "k", "c")
    puml = [r["plantuml"] for r in out.orderBy("k").collect()]
    assert 'rectangle "Start" as A #f00;text:fff' in puml[0] and "B ..> C" in puml[0] and "left to right direction" in puml[0]
    assert puml[1] == codes[1] and puml[3] == ""
    assert puml[2].split("\n")[2:] == [f'rectangle "{t}" as {n}' for n, t in (("A", "A"), ("B", "B"), ("C", "C"), ("D", "D"), ("E", "y"))] + ["A --> B", "B --> C : why not", "C -- D : so", "D ==> E", "@enduml"]
    back = out.select("k", diagrams.plantuml_to_mermaid("plantuml").alias("m")).orderBy("k").collect()
    assert back[0]["m"].split("\n") == ["graph LR", '    A["Start"]', '    B["End"]', '    C["C"]', "    A --> B", "    B -.-> C", "    style A fill:#f00,color:#fff"] and back[1]["m"] == codes[1]



@pytest.mark.parametrize(("base", "ours", "theirs", "text_", "n"), [
    ("a\nb\nc\n", "a\nb\nc\n", "a\nX\nc\n", "a\nX\nc\n", 0), ("a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n", "A\nb\nC\n", 0), ("a\nb\nc\n", "a\nX\nc\n", "a\nX\nc\n", "a\nX\nc\n", 0),
    ("a\nb\nc\n", "a\nX\nc\n", "a\nY\nc\n", "a\n<<<<<<< LOCAL\nX\n=======\nY\n>>>>>>> CLOUD\nc\n", 1), ("", "a\n", "", "a\n", 0), ("a\nb\n", "b\n", "a\nb\nc\n", "b\nc\n", 0),
])
def test_merge(base, ours, theirs, text_, n):
    assert diff.merge3(base, ours, theirs) == (text_, n)


def test_delta(spark):
    base = bytes(range(256)) * 40
    pairs = [(base, base + b"tail"), (base, b""), (b"", base), (base, base[:4096] + b"X" + base[4097:]), (base, base[1:]), (None, b"a"), (b"a", None), (b"abc", b"abc")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a binary, b binary").withColumn("d", diff.delta(F.col("a"), F.col("b")))
    got = rows.select("i", "d", diff.patched(F.col("a"), F.col("d")).alias("p")).orderBy("i").collect()
    assert [bytes(r["p"]) for r in got] == [b or b"" for _, b in pairs]
    assert len(got[0]["d"]) == 9 + 9 + 5 + len(base) - 8192 + 4 and bytes(got[7]["d"]) == bytes([0, 0, 0, 0, 0, 3, 0, 0, 0]) and bytes(got[5]["d"]) == b"\x01\x01\0\0\0a"
    for old, change, error in ((b"", bytes([0, 0, 0, 0, 0, 3, 0, 0, 0]), "beyond"), (b"abc", b"\x01\x09\0\0\0a", "cut off"), (b"abc", b"\0\0", "cut off"), (b"abc", b"\x07abcdefgh", "unknown")):
        with pytest.raises(Exception, match=error):
            spark.createDataFrame([(old, change)], "a binary, d binary").select(diff.patched(F.col("a"), F.col("d"))).collect()


def test_64_bit_hash_with_any_seed(spark):
    import xxhash

    texts = ["", "a", "é漢", "x" * 31, "y" * 32, "z" * 1000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "i int, t string")
    for seed in (0, 1, 42, text.SECOND_SEED, (1 << 64) - 1):
        got = [r["h"] for r in rows.select("i", text.xxh64("t", seed).alias("h")).orderBy("i").collect()]
        assert got == [xxhash.xxh64_hexdigest(t.encode(), seed=seed) for t in texts] + [None]


def test_trees(spark):
    nodes = spark.createDataFrame([("1", None, "r"), ("2", "1", "a"), ("3", "2", "b"), ("4", "5", "x"), ("5", "4", "y")], "id string, parent_id string, name string")
    assert {r["id"]: r["path"] for r in trees.tree_paths(nodes).collect()} == {"1": "r", "2": "r/a", "3": "r/a/b"}
    a = spark.createDataFrame([("x/1", "h"), ("x/2", None), ("y/1", "h")], "path string, hash string")
    b = spark.createDataFrame([("x/1", "h"), ("x/2", "n"), ("y/1", "h")], "path string, hash string")
    assert {r["dir"] for r in trees.merkle_diff(trees.merkle(a, 1), trees.merkle(b, 1)).collect()} == {"x", ""}
    assert trees.merkle_diff(trees.merkle(a, 1), trees.merkle(a, 1)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a" / "images").mkdir(parents=True)
    for name in ("a/x.md", "a/images/p.png", ".hidden", "a/y.conflict.md"):
        (tmp_path / name).write_text("x")
    assert [r["path"] for r in readers.local_files(spark, str(tmp_path)).collect()] == ["a/x.md"]
    pages = spark.createDataFrame([([(("i", "n.note", "p", False, 0, 5, 6),), ((("i"), "n.note", "p", False, 0, 5, 6),), (("j", ".x", "p", False, 0, 5, 6),)],)], "entries array<struct<fileEntry:struct<id:string,name:string,parentId:string,dir:boolean,domain:int,modifyTimeForSort:long,createTimeForSort:long>>>")
    assert [r["path"] for r in readers.listing_rows(pages, "base").collect()] == ["base/n.md"]
    profile = tmp_path / "p.json"
    profile.write_text('{"nodes":[{"id":1,"callFrame":{"functionName":"f","url":"u","lineNumber":1}},{"id":2,"callFrame":{"functionName":"g","url":"u","lineNumber":2}}],"samples":[1,1,2,1],"timeDeltas":[100,100,100,100]}')
    assert {r["function"]: r["self_time"] for r in readers.cpu_profile(spark, str(profile)).collect()} == {"f": 300, "g": 100}


def test_feed(spark):
    rows = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 6, "z")], "id string, version long, name string")
    stored = spark.createDataFrame([("a", "old"), ("c", "keep")], "id string, name string")
    assert {r["id"]: r["name"] for r in feed.apply_feed(stored, rows, 5).collect()} == {"a": "y", "b": "z", "c": "keep"}
    assert feed.coverage(rows, 5).first()["overflow"] is False and feed.coverage(rows, 1).first()["overflow"] is True
    assert feed.is_usable(5, 10) and not feed.is_usable(4, 10) and feed.needs_full_scan(0, 0, 0)


def test_streaming(spark, tmp_path):
    from datetime import datetime

    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    source = str(tmp_path / "in")
    spark.createDataFrame([("r", "a", at(1)), ("r", "a", at(3)), ("r", "b", at(4)), ("r", "c", at(30))], "root string, path string, ts timestamp").write.parquet(source)
    seen = []
    stream = spark.readStream.schema("root string, path string, ts timestamp").parquet(source)
    feed.follow(stream, lambda df, i: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "check"), once=True).awaitTermination(60)
    assert sorted(seen) == ["a", "a", "b", "c"]
    q = feed.debounced(stream, late="0 seconds").writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("debounced").first()["paths"]) == ["a", "b"]


def test_tree_paths_send_no_table_to_the_driver(spark, monkeypatch):
    """A table has a row for each folder, so none of a walk's joins is broadcast."""
    from skerry.operators import trees

    plans, written = [], trees.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(trees, "written", watched)
    i = F.col("id")
    nodes = spark.range(300).select("id", F.when(i % 100 == 0, None).otherwise(i - 1).alias("parent_id"), F.concat(F.lit("n"), i).alias("name"))
    out = trees.tree_paths(nodes, None)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
    assert out.count() == 300 and out.agg(F.max("depth")).first()[0] == 99


def test_lines_are_dealt_and_sorted_once(spark):
    docs = spark.createDataFrame([(1, "a\n|b|\n|-|\n|x|\n﷐ c"), (2, "```Mermaid\ngraph LR\nA --> B\n```\nz"), (3, None)], "k long, t string").repartition(3, "k")
    plan = richtext.line_blocks(docs, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1
    notes_ = richtext.markdown_to_notes(docs, "k", "t")
    back = {r["key"]: r["m"] for r in notes_.select("key", richtext.note_to_markdown("note").alias("m")).collect()}
    assert back[1] == "a\n\n| b |\n| -- |\n| x |\n\n\n﷐ c" and back[3] is None
    assert back[2] == "```mermaid\ngraph LR\n    A[\"A\"]\n    B[\"B\"]\n    A --> B\n```\n\nz"


def test_notes_are_not_broadcast(spark, tmp_path):
    """A small file of short texts makes far larger notes; texts without a key, without lines or null keep their note."""
    texts = [(1, "# a\n\nb"), (2, None), (3, ""), (None, "c")]
    docs = spark.createDataFrame(texts, "k long, t string")
    docs.write.parquet(str(tmp_path / "docs"))
    notes_ = richtext.markdown_to_notes(spark.read.parquet(str(tmp_path / "docs")), "k", "t")
    found = {r["key"]: r["note"] for r in notes_.collect()}
    final = notes_._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "Join" not in final
    assert '{"8":"a"}' in found[1] and '{"8":"b"}' in found[1] and found[2] is None and '"5":[],' in found[3] and '{"8":"c"}' in found[None]
