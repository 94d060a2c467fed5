"""Queries over stored tables, notes, names and reports: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import convert, diagrams, names, richtext, text
from skerry.operators import health, hydrate, notes, reconcile, reports, state, store, trees
from skerry.plans.queries import _refined, _tree, query
from skerry.sources import readers
from skerry.sources.staging import scratch
from skerry.sources.workload import SYNCED_AT, epoch, paths, snapshots, spread, table
from skerry.streaming import feed

NOW = SYNCED_AT + 1000


def _i() -> Column:
    return F.col("doc_id")


def _dirs(spark, sf) -> DataFrame:
    return paths(spark, sf).select(F.col("dir").alias("path"), F.concat(F.lit("D"), F.col("dir")).alias("dir_id"), F.lit("root").alias("parent_id")).distinct()


# --- stored tables -----------------------------------------------------------------


@query
def cached_listing(spark, sf):
    s = snapshots(spark, sf)
    copies = s.base.withColumn("path", F.when(F.col("cloud_mtime") % 7 == 0, F.concat("path", F.lit(".conflict.md"))).otherwise(F.col("path")))
    return store.cached_listing(copies, _dirs(spark, sf)).select("path", "id", "name", "is_dir")


@query
def scan_phase(spark, sf):
    """What a sync works on when no full scan is due, under a filter."""
    s = snapshots(spark, sf)
    return store.scan_phase(s.remote.withColumn("is_dir", F.lit(False)), s.base, _dirs(spark, sf), full=False, allowed=names.allowed("path", exclude=["src1/*"])).select("path", "is_dir")


@query
def live_listing(spark, sf):
    s = snapshots(spark, sf)
    return store.replace_listing(s.base.select("path"), s.remote).select("path", "id")


@query
def dirs_upsert(spark, sf):
    d = _dirs(spark, sf)
    delta = d.select("path", F.when(F.col("path").startswith("src1/"), "").otherwise(F.concat(F.lit("N"), "path")).alias("dir_id"), F.lit("other").alias("parent_id")).where("path LIKE '%/en' OR path LIKE 'src1/%'")
    return store.set_dirs(d, delta)


@query
def dirs_calibrate(spark, sf):
    return store.new_dirs(_dirs(spark, sf).where("path NOT LIKE '%/en'"), _dirs(spark, sf))


@query
def base_contents(spark, sf):
    d = paths(spark, sf)
    stored = d.where(_i() % 3 != 0).select("path", F.col("text").alias("content"), F.md5("text").alias("content_hash"))
    delta = d.where(_i() % 5 == 0).select("path", F.lit("new").alias("content"), F.md5(F.lit("new")).alias("content_hash"))
    return store.base_content(store.save_base(stored, delta), d.select("path")).select("path", "content_hash")


def _done(spark, sf) -> DataFrame:
    s = snapshots(spark, sf)
    return s.remote.where("mtime % 2 = 0").select("path", F.col("id").alias("file_id"), F.col("mtime").alias("cloud_mtime"), F.col("mtime").alias("local_mtime"), F.col("cloud_hash").alias("content_hash"), F.col("cloud_hash").alias("cloud_content_hash"), "parent_id", "domain", F.col("ctime").alias("create_time"), F.when(F.col("mtime") % 4 == 0, "download").alias("action"), F.lit("pull").alias("direction"), F.lit(None).cast("string").alias("old_hash"))


@query
def sync_recorded(spark, sf):
    return store.record_sync(snapshots(spark, sf).base, _done(spark, sf), NOW)[0].select("path", "file_id", "cloud_mtime", "last_sync_at", "content_hash")


@query
def sync_recorded_log(spark, sf):
    return store.record_sync(snapshots(spark, sf).base, _done(spark, sf), NOW)[1].select("timestamp", "path", "action", "direction", "new_hash", "cloud_id")


def _scan_parts(spark, sf):
    s = snapshots(spark, sf)
    dirs = _dirs(spark, sf)
    folders = dirs.select("path", F.col("dir_id").alias("id"), "parent_id", F.col("path").alias("name"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("ctime"), F.lit(1).alias("domain"), F.lit(None).cast("string").alias("cloud_hash"), F.lit(True).alias("is_dir"))
    known = spark.createDataFrame([("cloud_version", "3"), ("other", "x")], "key string, value string")
    return s.base, dirs.where("path LIKE '%/en'").withColumn("dir_id", F.lit("old")), known, s.remote.withColumn("is_dir", F.lit(False)).unionByName(folders)


def _scan(spark, sf):
    return store.save_scan(*_scan_parts(spark, sf), 77, NOW)


@query
def scan_saved_files(spark, sf):
    return _scan(spark, sf)[0].select("path", "file_id", "cloud_mtime")


@query
def scan_saved_dirs(spark, sf):
    return _scan(spark, sf)[1]


@query
def scan_saved_state(spark, sf):
    return _scan(spark, sf)[2]


@query
def point_updates(spark, sf):
    base = snapshots(spark, sf).base
    delta = base.where("cloud_mtime % 3 = 0").select("path", F.lit(NOW).cast("long").alias("last_sync_at"), F.lit("c").alias("cloud_content_hash"), F.lit(9).cast("long").alias("local_mtime"))
    return store.set_fields(base, delta, "last_sync_at", "cloud_content_hash", "local_mtime").select("path", "last_sync_at", "cloud_content_hash", "local_mtime", "content_hash")


@query
def original_domains(spark, sf):
    base = snapshots(spark, sf).base
    stored = base.select("path", F.when(F.col("cloud_mtime") % 2 == 0, 7).alias("original_domain"))
    return store.original_domain(stored, base.select("path", F.col("domain").alias("original_domain")))


@query
def hash_cache_version(spark, sf):
    cache = snapshots(spark, sf).local.select("path", "local_hash")
    return store.current_cache(cache, "2", "2").unionByName(store.current_cache(cache, "1", "2"))


@query
def hash_cache_upsert(spark, sf):
    cache = snapshots(spark, sf).local.select("path", "mtime", F.col("local_hash").alias("cached"))
    return state.last_writer_wins(cache, cache.where("mtime % 2 = 0").select("path", (F.col("mtime") + 1).alias("mtime"), F.lit("new").alias("cached")), "path")


@query
def refs_replaced(spark, sf):
    refs = paths(spark, sf).select(F.col("path").alias("source_path"), F.concat(F.lit("img/"), _i() % 5).alias("ref_path"))
    return state.replace_refs(refs, refs.where("ref_path = 'img/3'").select("source_path", F.lit("img/new").alias("ref_path")))


@query
def refs_cache(spark, sf):
    local = snapshots(spark, sf).local
    cache = local.where("size % 3 <> 0").select("path", F.when(F.col("mtime") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return store.cached_refs(local, cache)


@query
def linked_twins(spark, sf):
    return store.linked_twin(snapshots(spark, sf).base)


@query
def wanted_merged(spark, sf):
    s = snapshots(spark, sf)
    later = s.remote.select("path", F.when(F.col("mtime") % 4 == 0, F.concat(F.lit("N"), "id")).otherwise(F.col("id")).alias("id"), "name", (F.col("mtime") + F.col("mtime") % 3 - 1).alias("mtime"))
    return store.merge_wanted(s.remote.where("mtime % 10 <> 0"), later, s.local).select("path", "id")


@query
def fallback_deletes(spark, sf):
    d = paths(spark, sf)
    failed = d.select(F.col("path").alias("old_path"), F.concat(F.lit("new/"), "path").alias("new_path"), F.concat(F.lit("F"), _i()).alias("file_id"))
    return store.fallback_deletes(failed, d.where(_i() % 3 == 0).select(F.concat(F.lit("new/"), "path").alias("path")))


@query
def merge_retries(spark, sf):
    d = paths(spark, sf)
    return store.retries(d.select("path", (_i() % 4 != 0).alias("uploaded"), F.lit("before").alias("previous_hash"), F.md5("text").alias("merged_hash")))


@query
def local_collisions(spark, sf):
    d = paths(spark, sf)
    ext = lambda e: d.select(F.col("dir").alias("folder"), F.concat(F.lit("n"), _i(), F.lit(e)).alias("name"), _i().alias("mtime"), F.length("text").alias("size"))
    return store.local_collisions(ext(".note").unionByName(ext(".md").where("mtime % 3 = 0")).unionByName(ext(".clip").where("mtime % 2 = 0"))).select("path", "name", "mtime")


def _books(spark, sf):
    return _tree(spark, sf).select("id", "parent_id"), trees.tree_paths(_tree(spark, sf)).select("id", "path")


@query
def imported_folders(spark, sf):
    return store.import_folders(*_books(spark, sf))


@query
def imported_notes(spark, sf):
    notes = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), (F.col("s_suppkey") + 1_700_000_000_000).alias("modified"), F.col("s_suppkey").cast("long").alias("created"), F.lit(0).alias("domain"), (F.col("s_suppkey") % 5 == 0).alias("deleted"), F.lit(False).alias("is_dir"))
    return store.seed(snapshots(spark, sf).base.where("false"), notes, _books(spark, sf)[1]).select("path", "file_id", "cloud_mtime", "create_time")


@query
def richest_versions(spark, sf):
    return store.richest(table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), (F.col("event_id") % 7).alias("size")), "user_id")


@query
def live_mtimes(spark, sf):
    s = snapshots(spark, sf)
    recent = s.remote.where("mtime % 3 = 0").select("id", (F.col("mtime") + 500).alias("mtime"))
    return hydrate.overlay_mtimes(s.remote, recent).select("path", "mtime")


@query
def listing_pages(spark, sf):
    """Rows of two overlapping pages of a nested listing, each id once."""
    d = paths(spark, sf)
    entry = F.struct(F.struct(F.concat(F.lit("F"), _i()).alias("id"), F.concat(F.when(_i() % 9 == 0, F.lit(".")).otherwise(""), F.lit("n"), _i(), F.lit(".note")).alias("name"), F.col("dir").alias("parentId"), F.lit(False).alias("dir"), _i().alias("modifyTimeForSort"), _i().alias("createTimeForSort"), F.lit(0).alias("domain")).alias("fileEntry"))
    return readers.listing_rows(d.select(F.array(entry, entry).alias("entries")), "base").select("id", "path", "parent_id")


@query
def usable_listings(spark, sf):
    """Whether a shrunken listing is trusted, for each folder."""
    n = paths(spark, sf).groupBy("dir").agg(F.count("*").alias("prior"), F.count_if(_i() % 2 == 0).alias("live"))
    return n.select("dir", feed.usable("live", "prior").alias("usable"))


@query
def download_tasks(spark, sf):
    """Files of a tree, without the folders above them."""
    nodes = trees.tree_paths(_tree(spark, sf))
    return nodes.join(_tree(spark, sf).select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti").select("id", "path")


@query
def refinement_changes(spark, sf):
    before = reconcile.classify_all(*snapshots(spark, sf)).select("path", "state")
    after = _refined(spark, sf).select("path", F.col("state").alias("refined"))
    return before.join(after, "path").where("state <> refined").select("path", "state", "refined")


# --- names and values ------------------------------------------------------------------


@query
def name_rules(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, (".note", ".clip", "", ".md", ".PNG"))), (k % 5 + 1).cast("int"))
    name = F.concat(F.lit("n"), k, ext)
    path = F.concat(F.when(k % 3 == 0, F.lit("a\\b/")).otherwise(""), name)
    return p.select("p_partkey", names.domain_of_name(name).alias("domain"), names.cached_name(path, k % 2).alias("cached"), names.official_name(name).alias("sibling"), names.without_stem_blanks(F.concat(F.lit("d/x "), ext)).alias("trimmed"), names.media_dir(F.concat(name, F.lit(".AUDIO"))).alias("media"), names.mapped_path(F.lit("f"), name).alias("mapped"), names.is_watched(name).alias("watched"), names.mime(name).alias("mime"), names.is_conflict(F.concat(name, F.when(k % 4 == 0, F.lit(".conflict.md")).otherwise(""))).alias("conflict"), names.is_root_level(path).alias("root"), names.normalize_separators(path).alias("separators"), names.short_location(F.concat(F.lit("file:///x/y/"), name), k).alias("location"))


@query
def diary_names(spark, sf):
    stem = F.concat((2000 + _i() % 30).cast("string"), F.lit("年"), (_i() % 12 + 1).cast("string"), F.lit("月"), (_i() % 28 + 1).cast("string"), F.when(_i() % 7 == 0, F.lit("x")).otherwise("日"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (_i() % 60).cast("int"))
    return paths(spark, sf).select("doc_id", names.is_diary_name(F.concat(stem, F.lit(".md"))).alias("diary"), names.stem_date(stem).alias("day"), names.trash_path("path", day).alias("trash"), names.dated(F.lit("mark"), day).alias("marker"))


@query
def value_formats(spark, sf):
    ms = _i() * 10
    return paths(spark, sf).select("doc_id", names.milliseconds(ms).alias("ms"), names.microseconds(_i() * 10_000).alias("us"), names.percent(_i(), _i() % 5).alias("share"), names.number(F.when(_i() % 3 == 0, F.lit("x")).otherwise(_i().cast("string")), -1).alias("number"), names.seconds(F.when(_i() % 2 == 0, _i() + 1_700_000_000_000).otherwise(_i())).alias("seconds"), names.listed_time((_i() % 7) * 1_000_000).alias("listed"), names.template(F.lit("/{a}/x/{b}/{a}"), {"a": _i().cast("string"), "b": F.lit("z")}).alias("url"))


@query
def commit_messages(spark, sf):
    c = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    counts = {"downloaded": k % 2, "uploaded": k % 3, "conflicts": k % 5, "dedup_deleted": F.lit(0)}
    return c.select("n_nationkey", names.commit_message(F.lit("2024-05-06 07:08:09").cast("timestamp"), counts, F.when(k == 7, F.lit("own"))).alias("message"))


@query
def clip_names(spark, sf):
    start = F.element_at(F.array(*(F.lit(x) for x in ("4F676753", "49443303", "FFF150", "00"))), (_i() % 4 + 1).cast("int"))
    ext = names.clip_extension(F.unhex(start))
    name = names.clip_name(_i() % 1200, F.lit("rec"), ext)
    return paths(spark, sf).select("doc_id", name.alias("name"), names.is_clip_of(name, F.lit("rec")).alias("own"))


@query
def denied_commands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.is_denied("p_name", r"\b(a|b)[a-z]+").alias("denied"))


@query
def markdown_tables(spark, sf):
    body = F.when(_i() % 3 == 0, F.concat("text", F.lit("\n| a | b |\n|---|:-:|\n"))).when(_i() % 3 == 1, F.concat("text", F.lit("\n| a | b |\n"))).otherwise(F.concat(F.lit("x|y\n| -- |\n"), "text"))
    return paths(spark, sf).select("doc_id", text.has_table(body).alias("table"))


@query
def bloom_sizes(spark, sf):
    """The filter that the documents of each source, and of each language, would need."""
    d = table(spark, sf, "documents")
    counts = d.groupBy(F.coalesce("source", F.lit("none")).alias("of")).agg(F.count("*").alias("n")).unionByName(d.groupBy(F.coalesce("lang", F.lit("none")).alias("of")).agg((1000 * F.count("*")).alias("n")))
    return counts.select("of", "n", text.bloom_sizes("n", 0.01).alias("s")).select("of", "n", "s.*")


# --- notes and conversions -------------------------------------------------------------


def _note(style: Column) -> Column:
    """A rich note with a table, two paragraphs, or a table typed as text, by document."""
    line = lambda t: F.concat(F.lit('{"3":"","5":[{"2":"2","3":"","7":[{"8":"'), t, F.lit('"},{"8":"!"}]}]}'))
    grid = F.lit('{"3":"","4":{"version":1,"cw":[120]},"5":[],"6":"t"}')
    first = F.when(style == 0, grid).when(style == 1, line(F.lit("| a |"))).otherwise(line(F.concat(F.lit("p"), _i())))
    typed = F.when(style == 1, F.lit('{"3":"","5":[{"2":"2","3":"","7":[{"8":"| a |"}]}]}')).otherwise(first)
    return F.concat(F.lit('{"2":"1","3":"","4":{"version":1},"5":['), typed, F.lit(","), line(F.concat(F.lit("q"), _i())), F.lit('],"title":"t'), (_i() % 4).cast("string"), F.lit('"}'))


@query
def note_contents(spark, sf):
    note = _note(_i() % 3)
    rows = paths(spark, sf).select("doc_id", note.alias("note"))
    texts = notes.note_texts(rows, "doc_id", "note").select(F.col("key").alias("doc_id"), F.array_join("texts", "/").alias("texts"))
    return rows.join(texts, "doc_id").select("doc_id", "texts", F.array_join(reports.paragraph_texts("note"), "/").alias("paragraphs"), F.array_join(reports.missing_table_attributes("note"), ",").alias("missing"), reports.table_shape("note").alias("shape"))


@query
def note_comparison(spark, sf):
    pairs = paths(spark, sf).select("doc_id", _note(_i() % 3).alias("a"), F.when(_i() % 2 == 0, _note(_i() % 3)).otherwise(F.replace(_note(_i() % 3), F.lit('"title":"t'), F.lit('"title":"u'))).alias("b"))
    return reports.compare_notes(pairs, "doc_id", "a", "b").select("doc_id", "same", "shapes", "attributes")


def _inspected(spark, sf) -> DataFrame:
    notes = paths(spark, sf).select(F.concat(F.lit("F"), _i()).alias("file_id"), F.when(_i() % 5 == 0, "{").otherwise(_note(_i() % 3)).alias("json"))
    return reports.inspect_tables(paths(spark, sf).select("path"), snapshots(spark, sf).base, notes)


@query
def note_tables(spark, sf):
    return _inspected(spark, sf)


@query
def notes_verified(spark, sf):
    return reports.verified_notes(_inspected(spark, sf), reconcile.plan(_refined(spark, sf), "push"))


@query
def note_table_candidates(spark, sf):
    local = paths(spark, sf).select("path", F.when(_i() % 3 == 0, F.concat("text", F.lit("\n| a |\n|---|\n"))).otherwise(F.col("text")).alias("text"))
    return reports.table_candidates(snapshots(spark, sf).base, local, "src")


@query
def note_table_targets(spark, sf):
    """The first ten notes with a table typed as text, as people sort names."""
    return _inspected(spark, sf).where("shape = 'pipe-text'").select("path").orderBy(F.collate("path", "UNICODE"), "path").limit(10)


@query
def xml_to_md(spark, sf):
    k = F.col("p_partkey")
    xml = F.concat(F.lit('<note xmlns="n"><head><list id="1" type="ordered"/></head><body><para><text>'), "p_name", F.lit('</text></para><heading level="2"><text>h'), k, F.lit('</text></heading><list-item list-id="1"><text>i</text></list-item><todo><text>t</text></todo><horizontal-line/><image><source>u</source><text>s</text></image><table><content>{"widths":[1,1],"cells":[{"value":"a_b"},{"value":"c#d"},{"value":"x"},{"value":" "}]}</content></table></body></note>'))
    return spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", convert.converted(xml, convert.xml_to_markdown).alias("markdown"))


def _chart(k):
    return F.concat(F.lit('graph LR\nA["'), "p_name", F.lit('"] --> B["E'), k, F.lit('"]\nB -.-> C\nC -- yes --> A\nC ~~~ D\nD ==> A\nstyle A fill:#f00,color:#fff'))


@query
def mermaid_to_puml(spark, sf):
    return diagrams.mermaid_to_plantuml(spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", _chart(F.col("p_partkey")).alias("code")), "p_partkey", "code")


@query
def puml_to_mermaid(spark, sf):
    return mermaid_to_puml(spark, sf).select("p_partkey", diagrams.plantuml_to_mermaid("plantuml").alias("mermaid"))


@query
def html_built(spark, sf):
    """Markdown of pages built from names: every kind of element once."""
    html = F.concat(F.lit("<html><head><style>x</style></head><body><h2>"), "p_name", F.lit("</h2><p>a <b>b</b> <i>c</i> <del>d</del> <code>e</code> <a href='u?x=1&amp;y'>l</a><br/>z</p><ul><li>one</li><li>two</li></ul><blockquote>q\nr</blockquote><pre><code>k</code></pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>"), "p_partkey", F.lit("</td></tr></table><img alt='t' src='s'><hr>&lt;&#65;&#x42;</body></html>"))
    return spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", convert.converted(html, convert.html_to_markdown).alias("markdown"))


@query
def note_json_built(spark, sf):
    md = F.concat(F.lit("# "), "p_name", F.lit("\n- **b** x\n\n> q\n\n```py\nc\n```\n[l](u)"))
    return richtext.markdown_to_notes(table(spark, sf, "part").select("p_partkey", md.alias("md")), "p_partkey", "md").withColumnRenamed("key", "p_partkey")


@query
def any_to_markdown(spark, sf):
    """Documents of several kinds, each recognised and converted; never raw JSON or XML."""
    d = paths(spark, sf)
    body = F.when(_i() % 4 == 0, F.concat(F.lit("<html><p>h"), _i(), F.lit("</p>"))).when(_i() % 4 == 1, _note(_i() * 0 + 2)).when(_i() % 4 == 2, F.concat(F.lit('<?xml version="1.0"?><note><head/><body><para><text>x'), _i(), F.lit("</text></para></body></note>"))).otherwise(F.concat(F.lit("# "), _i().cast("string")))
    md = convert.to_markdown("body", "path")
    return d.select("doc_id", body.alias("body"), "path").select("doc_id", md.alias("m")).select("doc_id", reports.checked_markdown("m").alias("markdown"))


@query
def content_anomalies(spark, sf):
    both = table(spark, sf, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")).unionByName(paths(spark, sf).select(F.lit("d").alias("kind"), _i().alias("id"), F.when(_i() % 5 == 0, F.concat(F.lit('\n {"a":'), "text")).when(_i() % 5 == 1, F.concat(F.lit("<?xml"), "text")).otherwise(F.col("text")).alias("text")))
    return both.select("kind", "id", reports.content_anomaly("text").alias("anomaly")).where("anomaly IS NOT NULL")


@query
def content_hashes_by_kind(spark, sf):
    """Text files without byte-order mark and carriage returns, others as they are."""
    ext = F.element_at(F.array(*map(F.lit, ("java", "org", "png", "json"))), (_i() % 4 + 1).cast("int"))
    body = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return paths(spark, sf).select("doc_id", text.content_hash(body, F.concat(F.lit("x."), ext)).alias("hash"))


# --- reports ------------------------------------------------------------------------------


@query
def line_differences(spark, sf):
    pairs = paths(spark, sf).select("doc_id", F.col("text").alias("a"), F.concat(F.when(_i() % 2 == 0, F.lit("top\n")).otherwise(""), "text", F.when(_i() % 3 == 0, F.lit("\nend")).otherwise("")).alias("b"))
    return reports.line_differences(pairs, "doc_id", "a", "b", 3)


@query
def timing_report(spark, sf):
    return reports.timing_report(table(spark, sf, "events").select(F.col("event_type").alias("phase"), (F.col("event_id") % 100).alias("ms")))


@query
def hash_repairs(spark, sf):
    s = snapshots(spark, sf)
    return reports.hash_repairs(s.base, s.local, "src")


@query
def hash_repair_counts(spark, sf):
    s = snapshots(spark, sf)
    return reports.repair_counts(reports.hash_repairs(s.base, s.local), dry_run=True)


@query
def listing_summary(spark, sf):
    files = paths(spark, sf).select(F.lit(False).alias("is_dir"), F.length("text").cast("long").alias("size"))
    return reports.listing_summary(files.unionByName(_dirs(spark, sf).select(F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))))


@query
def task_counts(spark, sf):
    return reports.task_counts(paths(spark, sf).select((_i() % 9 != 0).alias("ok")))


@query
def action_counters(spark, sf):
    planned = reconcile.plan(_refined(spark, sf), propagate_deletes=True)
    return reports.action_counters(planned.select("action", (~F.col("path").endswith("3.md")).alias("ok")))


@query
def recovery_verdicts(spark, sf):
    d = paths(spark, sf)
    return reports.recovery_verdict(d.select("name"), d.where(_i() % 2 == 0).select("name"), d.where(_i() % 4 == 0).select("name"))


@query
def empty_groups(spark, sf):
    return reports.skip_empty(paths(spark, sf).select("path", F.concat(F.lit("h"), _i() % 11).alias("hash"), F.when(_i() % 3 == 0, 0).otherwise(_i()).alias("size")))


@query
def log_retention(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), epoch("ts").alias("timestamp"), F.col("event_type").alias("action"))
    return state.log_after(log, 1_704_067_200 + 86_400 * 3).groupBy("action").agg(F.count("*").alias("n"))


# --- logs, removals, pages, reports ---------------------------------------------------------


@query
def stored_dirs(spark, sf):
    return _dirs(spark, sf).where("dir_id <> ''").select("path", "dir_id")


@query
def log_appended(spark, sf):
    log = table(spark, sf, "events").where("event_id % 4 = 0").select(F.col("event_id").alias("id"), epoch("ts").alias("timestamp"), F.lit("p").alias("path"), F.lit("old").alias("action"))
    rows = paths(spark, sf).select(F.lit(NOW).cast("long").alias("timestamp"), "path", F.lit("new").alias("action"))
    return store.append_log(log, rows).where("action = 'new'").select("id", "path")


@query
def rows_removed(spark, sf):
    s = snapshots(spark, sf)
    return store.remove(s.base, s.local).select("path")


def _rewritten(spark, sf):
    d = paths(spark, sf)
    odd = d.select(F.when(_i() % 3 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path")).alias("path"), _i().alias("v"))
    return store.rewrite_paths(odd.unionByName(d.where(_i() % 6 == 0).select("path", (-_i()).alias("v"))), names.normalize_separators("path"))


@query
def paths_rewritten(spark, sf):
    return _rewritten(spark, sf)[0]


@query
def paths_rewritten_counts(spark, sf):
    return _rewritten(spark, sf)[1]


@query
def listing_filtered(spark, sf):
    d = paths(spark, sf)
    rows = d.select(F.when(_i() % 7 == 0, F.concat("path", F.lit(".conflict.md"))).otherwise(F.col("path")).alias("path"), F.lit(False).alias("is_dir")).unionByName(_dirs(spark, sf).select("path", F.lit(True).alias("is_dir")))
    return store.filter_listing(rows, names.allowed("path", include=["*.md"], exclude=["src1/*"]))


@query
def parents_confirmed(spark, sf):
    tree = _books(spark, sf)[1]
    wanted = table(spark, sf, "customer").select(F.col("c_name").alias("path"), F.concat(F.lit("n"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))).alias("parent_id"), F.concat(F.lit("n"), "c_nationkey").alias("id"))
    at = wanted.join(tree, "id").select(wanted["path"], "parent_id", tree["path"].alias("parent"))
    return store.confirmed_parents(at, tree)


@query
def dedup_inputs(spark, sf):
    s = snapshots(spark, sf)
    return store.dedup_inputs(s.local, s.local.where("mtime % 2 = 0").select("path", F.col("local_hash").alias("hash")), s.base)


@query
def recent_page(spark, sf):
    return feed.recent(table(spark, sf, "events").select(F.col("event_id").alias("version"), "user_id"))


@query
def scans_due(spark, sf):
    state_ = table(spark, sf, "events").select(F.col("event_id").alias("key"), (F.col("event_id") % 5).alias("version"), (F.col("event_id") % 3 - 1).alias("empty_ids"), (F.col("event_id") * 7).alias("age"), (F.col("event_id") % 2).alias("synced"))
    return feed.scan_due(state_)


@query
def gc_removed(spark, sf):
    s = snapshots(spark, sf)
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), epoch("ts").alias("timestamp"))
    refs = s.base.select(F.col("path").alias("source_path"), F.concat("path", F.lit(".png")).alias("ref_path"))
    return health.gc_rows(s.base, s.local, log, refs, now=1_706_600_000 + 60 * 86_400)


@query
def top_extensions(spark, sf):
    name = F.concat(F.lit("n."), (F.col("p_partkey") % 13).cast("string"))
    return reports.extension_counts(table(spark, sf, "part"), name, 10)


@query
def duplicate_summary(spark, sf):
    d = paths(spark, sf).select(F.concat(F.lit("g"), _i() % 40).alias("name"), (_i() % 40).alias("k"))
    groups = d.groupBy("name", "k").agg(F.count("*").alias("n")).withColumn("category", F.when(F.col("k") % 3 == 0, "identical").when(F.col("k") % 3 == 1, "crlf_only").otherwise("real_diff"))
    return reports.duplicate_summary(groups.select("name", "n", "category"), 5)


@query
def dry_run_report(spark, sf):
    return reports.dry_run_lines(reconcile.plan(_refined(spark, sf), propagate_deletes=True))


@query
def audio_notes(spark, sf):
    note = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), (_i() % 3 * 100).cast("int")), F.lit('","recordList":[{"id":'), _i(), F.when(_i() % 5 == 0, F.lit("")).otherwise("}]}"))
    return paths(spark, sf).select("doc_id", F.coalesce(reports.is_audio_note(note), F.lit(False)).alias("audio"))


@query
def watched_changes(spark, sf):
    change = F.concat(F.when(_i() % 4 == 0, F.lit(".git/")).otherwise(""), "name", F.element_at(F.array(*map(F.lit, ("", ".conflict.md", ".db"))), (_i() % 3 + 1).cast("int")))
    return feed.watched(paths(spark, sf).select("doc_id", change.alias("path"))).select("doc_id")


# --- files --------------------------------------------------------------------------------


@query
def local_files(spark, sf):
    """Documents written as text files in a folder for each language, then scanned."""
    folder = scratch(spark, "files")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    files = readers.local_files(spark, folder)
    return files.groupBy(names.dirname("path").alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("content").cast("long")).alias("read"))


@query
def cpu_profile(spark, sf):
    """Profiles in JSON, written and analysed together."""
    folder = scratch(spark, "profile")
    k = F.col("p_partkey")
    frame = F.struct(F.col("p_name").alias("functionName"), F.lit("u").alias("url"), F.lit(1).alias("lineNumber"))
    p = table(spark, sf, "part").groupBy(F.expr("p_partkey div 1000").alias("file"))  # a profile of 1,000 nodes in each file
    lists = p.agg(F.collect_list(F.struct(k.alias("id"), frame.alias("callFrame"))).alias("nodes"), F.collect_list(F.struct(k.alias("id"), (k % 50).alias("d"))).alias("s"))
    lists.select("file", "nodes", F.col("s.id").alias("samples"), F.col("s.d").alias("timeDeltas")).repartition("file").write.partitionBy("file").json(folder)
    return readers.cpu_profile(spark, folder).select("id", "function", "self_time", "pct")
