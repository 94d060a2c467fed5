"""Listings, feeds, the watcher, stores, trees: rules one by one, failures and restarts."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import dedup, moves, trees
from skerry.plans import durable, live
from skerry.sources import listing, versions
from skerry.sources.commit import Conflict, Store
from skerry.streaming.watcher import triggers

# --- listings -----------------------------------------------------------------


def put(folder, dir_id, start, entries, total=1000, text=None):
    page = folder / f"dir={dir_id}" / f"start={start}"
    page.mkdir(parents=True)
    body = json.dumps({"count": total, "entries": [{"fileEntry": {"id": e, "name": f"n{e}.md"} if not isinstance(e, dict) else e} for e in entries]})
    (page / "part-0.txt").write_text(text if text is not None else body)


def told(spark, folder, **options):
    pages = listing.read_pages(spark, f"file://{folder}", pagesize=3, rangepages=2, mostpages=6, **options)
    out = {}
    for r in listing.listed(pages, 3).collect():
        out.setdefault(r["dir_id"], []).append(r["id"])
    return {k: sorted(v) for k, v in out.items()}


def test_stop_rules(spark, tmp_path):
    put(tmp_path, "short", 0, ["a", "b", "c"]), put(tmp_path, "short", 3, ["d"]), put(tmp_path, "short", 6, ["never"])
    put(tmp_path, "empty", 0, ["a", "b", "c"]), put(tmp_path, "empty", 3, []), put(tmp_path, "empty", 6, ["x", "y", "z"])
    for start in (0, 3, 6):
        put(tmp_path, "again", start, ["a", "b", "c"])
    put(tmp_path, "again", 9, ["x", "y", "z"])
    put(tmp_path, "total", 0, ["a", "b", "c"], 4), put(tmp_path, "total", 3, ["d", "a", "b"], 4), put(tmp_path, "total", 6, ["x", "y", "z"], 4)
    put(tmp_path, "whole", 0, ["a", "b", "c"], 6), put(tmp_path, "whole", 3, ["d", "a", "b"], 6), put(tmp_path, "whole", 6, ["c", "e", "f"], 6), put(tmp_path, "whole", 9, ["x"], 6)
    for start in range(0, 30, 3):
        put(tmp_path, "most", start, [f"{start + k}" for k in range(3)])
    put(tmp_path, "odd", 0, [{"id": 7}, {"id": None, "name": "x"}, {"id": ""}]), put(tmp_path, "odd", 3, [{"id": True}, "z", {"name": "y"}]), put(tmp_path, "odd", 6, ["x", "y", "z"])
    put(tmp_path, "null", 0, [], text='{"entries": null}'), put(tmp_path, "none", 0, ["a", "b", "c"], "many"), put(tmp_path, "none", 3, ["d"])
    got = told(spark, tmp_path)
    assert got == {"short": list("abcd"), "empty": list("abc"), "again": list("abc"), "total": list("abcd"), "whole": list("abcdef"), "most": sorted(map(str, range(18))), "odd": ["7", "x", "y", "z"], "none": list("abc")}


def test_failing_folders(spark, tmp_path):
    put(tmp_path, "good", 0, ["a"]), put(tmp_path, "late", 0, ["a", "b", "c"]), put(tmp_path, "late", 3, [], text="{no"), put(tmp_path, "past", 0, ["a"]), put(tmp_path, "past", 6, [], text="{no")
    assert told(spark, tmp_path) == {"good": ["a"], "past": ["a"]}
    pages = listing.read_pages(spark, f"file://{tmp_path}", pagesize=3, rangepages=2, mostpages=6)
    assert {r["dir_id"] for r in listing.failures(pages).collect()} == {"late", "past"}
    for options in ({"mode": "FAILFAST"}, {"root": "late"}):
        with pytest.raises(Exception, match="JSONDecodeError"):
            told(spark, tmp_path, **options)
    assert told(spark, tmp_path, mode="FAILFAST", dirs='["good"]') == {"good": ["a"]}
    only = listing.read_pages(spark, f"file://{tmp_path}", mode="FAILFAST", pagesize=3).where("dir_id = 'good'")
    assert {r["dir_id"] for r in only.collect()} == {"good"}  # pushed down: the broken folders aren't fetched
    with pytest.raises(ValueError, match="root"):
        listing.scan(spark, f"file://{tmp_path}", "")


def test_requests_do_not_grow_with_the_most_pages(tmp_path):
    for start in range(0, 39, 3):
        put(tmp_path, "long", start, [f"{start + k}" for k in range(3)])
        put(tmp_path, "again", start, ["a", "b", "c"])
    put(tmp_path, "small", 0, ["a"])
    told = []
    for most in (100, 1_000_000):
        reader = listing.ListingReader({"path": f"file://{tmp_path}", "pagesize": "3", "rangepages": "2", "mostpages": str(most), "tasks": "4"})
        parts = reader.partitions()
        assert sum(len(dirs) for p in parts for _, dirs in p.lanes) == 3 * 5
        told.append(sorted((r["dir_id"], r["page"]) for p in parts for b in reader.read(p) for r in b.to_pylist()))
    assert told[0] == told[1] and {p for d, p in told[0] if d == "long"} >= set(range(13)) and len(told[0]) < 50


def test_short_broken_folder(spark, tmp_path):
    """A folder with one page has that one unreadable."""
    spark.range(82).selectExpr("id AS doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["dir_id"]: (r["n"], r["error"]) for r in live.listing_broken(spark, str(tmp_path)).collect()}["d4"] == (0, "JSONDecodeError")


def test_scan_with_visited_folders(spark, tmp_path):
    folder = lambda i, name: {"id": i, "name": name, "dir": True}
    put(tmp_path, "top", 0, [folder("x", "a"), folder("top", "loop"), {"id": "f", "name": "n.note"}])
    put(tmp_path, "x", 0, [folder("y", "b"), folder(".z", ".hidden")]), put(tmp_path, "y", 0, [folder("x", "back"), {"id": "g", "name": "deep.md"}])
    put(tmp_path, ".z", 0, ["below-hidden"]), put(tmp_path, "lost", 0, ["unreachable"])
    got = {r["path"]: r["id"] for r in listing.scan(spark, f"file://{tmp_path}", "top", pagesize=3, mostpages=2).collect()}
    assert got["a/b/deep.md"] == "g" and got["n.md"] == "f" and not any("hidden" in p or "loop" in p for p in got) and "lost" not in got.values()


def test_versions_are_listed_by_tasks(spark, tmp_path):
    for path in ("F1/1", "F1/12", "F1/2.index", "F2/3", "_x/1", ".y/1", "F3/a"):
        (tmp_path / path).parent.mkdir(exist_ok=True), (tmp_path / path).write_bytes(b"x" * len(path))
    found = versions.list_versions(spark, f"file://{tmp_path}")
    assert found.inputFiles() == []  # no list of files in the driver
    assert {(r["file_id"], r["version"], r["size"]) for r in found.collect()} == {("F1", 1, 4), ("F1", 12, 5), ("F2", 3, 4)}
    assert all(r["path"].endswith(f"{r['file_id']}/{r['version']}") and r["path"].startswith("file:") for r in found.collect())


# --- stores -------------------------------------------------------------------


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_commit_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "a long")
    assert store.commit({"one": frame(1), "two": frame(2)}) == 1
    broken = frame(5).select((F.col("a") + F.raise_error(F.lit("no disk")).cast("long")).alias("a"))
    with pytest.raises(Exception, match="no disk"):
        store.commit({"one": frame(3)}, {"two": broken})
    assert rows(store.read("one")) == [(1,)] and rows(store.read("two")) == [(2,)] and store.manifest()["version"] == 1
    assert store.commit({"one": frame(3)}, {"two": frame(4)}) == 2
    assert rows(store.read("one")) == [(3,)] and rows(store.read("two")) == [(2,), (4,)]
    assert rows(store.read("one", 1)) == [(1,)] and rows(store.read("two", 1)) == [(2,)]
    assert store.vacuum(keep=1, older_than=0) == 3 and rows(store.read("two")) == [(2,), (4,)]  # a replaced folder and two abandoned ones
    with pytest.raises(ValueError, match="no version"):
        store.read("one", 1)


def test_repeated_batches_and_conflicts(spark, tmp_path):
    store, frame = Store(spark, f"file://{tmp_path}/s"), spark.createDataFrame([(1,)], "a long")
    for batch in (0, 0, 1, 1, 0):
        store.commit(append={"log": frame}, writer="w", batch=batch)
    assert store.read("log").count() == 2 and store.manifest()["batches"] == {"w": 1}

    class Slow(Store):
        """Another writer commits while this one stages its tables."""

        def _staged(self, name, df):
            store.commit({"other": frame})
            return super()._staged(name, df)

    with pytest.raises(Conflict):
        Slow(spark, f"file://{tmp_path}/s").commit({"log": frame})
    assert store.read("log").count() == 2
    (tmp_path / "s/_ledger" / f"{99:020d}.json").write_text('{"version": 99, "tab')  # a writer that died
    assert "other" in store.names() and store.commit({"new": frame}) == 100 and "new" in store.names()
    empty = store.commit({"none": frame.limit(0)})
    assert store.read("none", empty).columns == ["a"] and store.read("none").count() == 0


# --- feeds --------------------------------------------------------------------


def test_feed_restarts_and_gaps(spark, tmp_path):
    feed, place = f"file://{tmp_path}/feed", f"file://{tmp_path}/place"
    put = lambda *v: spark.createDataFrame([(f"k{x % 4}", x, f"name{x}") for x in v], "id string, version long, name string").coalesce(1).write.mode("append").parquet(feed)
    newest = lambda n: {f"k{x % 4}": f"name{x}" for x in range(1, n + 1)}
    scans = []

    def rescan(version):
        scans.append(version)
        return spark.createDataFrame([(k, version, v) for k, v in newest(version).items()], "id string, version long, name string")

    class Failing(Store):
        failing = False

        def _publish(self, entry):
            if self.failing:
                raise OSError("lost")
            super()._publish(entry)

    store = Failing(spark, f"file://{tmp_path}/store")
    run = lambda: durable.follow_feed(store, feed, rescan, place, reach=10)
    held = lambda: {r["id"]: r["name"] for r in store.read("listing").collect()}
    put(*range(1, 9)), run()
    assert scans == [8] and held() == newest(8)
    run()
    assert scans == [8] and durable.state_value(store, "version") == 8
    put(9, 10), put(11)
    store.failing = True
    with pytest.raises(Exception, match="lost"):
        run()
    assert held() == newest(8) and durable.state_value(store, "version") == 8
    store.failing = False
    put(12), run()  # repeats the batch that failed, then takes the new row
    assert held() == newest(12) and scans == [8] and durable.state_value(store, "version") == 12
    put(*range(13, 22)), run()
    assert scans == [8] and held() == newest(21)  # nine of ten rows are new: no gap
    put(*range(22, 33)), run()
    assert scans == [8, 32] and held() == newest(32) and durable.state_value(store, "reloads") == 2


# --- watcher ------------------------------------------------------------------

SECOND = 1_000_000


def plain_triggers(events, silence, busy):
    out, run = [], {}

    def trigger(root, kind, a, b, n, p):
        free = run.get(root, b) <= b
        if free:
            run[root] = b + busy
        out.append((root, kind, a, b, n, p, free))

    for root in sorted({e[0] for e in events}):
        burst = []
        for _, t, path in sorted((e for e in events if e[0] == root), key=lambda e: (e[1], e[2] is None, e[2] or "")):
            if burst and t - burst[-1][0] >= silence:
                trigger(root, "changes", burst[0][0], burst[-1][0] + silence, len(burst), len({p for _, p in burst}))
                burst = []
            if path is None:
                trigger(root, "poll", t, t, 0, 0)
            else:
                burst.append((t, path))
        if burst:
            trigger(root, "changes", burst[0][0], burst[-1][0] + silence, len(burst), len({p for _, p in burst}))
    return sorted(out)


def test_watcher_over_late_parts_and_restarts(spark, tmp_path):
    rng = random.Random(6)
    events = sorted((f"r{rng.randrange(3)}", rng.randrange(0, 900 * SECOND), rng.choice([None, "a.md", "b.md", "b.md", "c.note"]) if rng.random() < 0.9 else "x.tmp") for _ in range(260))
    schema, source = "root string, us long, path string", f"file://{tmp_path}/in"
    parts = [[] for _ in range(10)]
    for e in events:
        parts[(e[1] + rng.randrange(40 * SECOND)) // (100 * SECOND)].append(e)  # up to 40 seconds late
    out, place = f"file://{tmp_path}/out", f"file://{tmp_path}/place"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).select("root", F.timestamp_micros("us").alias("ts"), "path")
        triggers(stream, "20 seconds", "45 seconds", "2 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()

    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if k in (3, 6):
            run()
    for day in (1, 2):
        spark.createDataFrame([("end", day * 86_400 * SECOND, "end.md")], schema).coalesce(1).write.mode("append").parquet(source)
        run()
    got = spark.read.parquet(out).where("root <> 'end'").select("root", "kind", F.unix_micros("started"), F.unix_micros("ended"), "changes", "paths", "accepted")
    want = plain_triggers([e for e in events if e[2] != "x.tmp"], 20 * SECOND, 45 * SECOND)
    assert rows(got) == want and {w[6] for w in want} == {True, False}


def test_watcher_parts_of_many_files(spark, tables, tmp_path):
    """The watermark of some files of a part doesn't drop the rest of it."""
    events = spark.read.parquet(f"{tables}/events.parquet")
    events.repartition(16, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = rows(live.watcher_runs(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = [(f"u{r['user_id']}", r["us"], None if r["event_type"] == "error" else f"p{r['event_id'] % 7}.md") for r in events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).collect() if r["event_type"] == "error" or r["event_id"] % 5]
    assert got == plain_triggers(plain, 1800 * SECOND, 7200 * SECOND)


# --- trees and folders ----------------------------------------------------------


def test_tree_with_cycles_and_depth(spark):
    n = 700
    nodes = [(0, None, "r")] + [(i, i - 1, f"n{i}") for i in range(1, n)]
    nodes += [(1001, 1002, "a"), (1002, 1003, "b"), (1003, 1001, "c"), (1004, 1001, "below a cycle"), (1005, 1005, "itself"), (1006, 4242, "no parent"), (1007, 1006, "below"), (1008, 5, "leaf"), (1008, 6, "leaf")]
    frame = spark.createDataFrame(nodes, "id long, parent_id long, name string")
    got = {r["id"]: r for r in trees.tree_paths(frame, None).collect()}
    assert set(got) == set(range(n)) | {1008} and got[n - 1]["depth"] == n - 1 and got[n - 1]["path"] == "/".join(["r", *(f"n{i}" for i in range(1, n))])
    assert got[1008]["path"].endswith("n5/leaf")
    assert {r["id"] for r in trees.tree_paths(frame, 50).collect()} == set(range(51)) | {1008}
    assert trees.tree_paths(frame.limit(0)).count() == 0


def test_digest_order(spark):
    files = [("d/a/x", "1"), ("d/a.md", "2"), ("d/B", "3"), ("d/b", "4"), ("d/a b", "5"), ("d/é", None), ("d/f", "")]
    got = {r["dir"]: r["tree_hash"] for r in trees.merkle(spark.createDataFrame(files, "path string, hash string"), 2).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    a = md5("x:1")
    assert got["d/a"] == a and got["d"] == md5(f"a:{a}|a b:5|a.md:2|b:4|B:3|é:unknown|f:unknown") and got[""] == md5(f"d:{got['d']}")


def test_equal_folders_make_one_class(spark):
    rng = random.Random(2)
    same = [(f"s{d}/f{h}", f"h{h}") for d in range(300) for h in range(10)]
    mixed = [(f"m{d}/f{k}", f"x{min(rng.randrange(40), rng.randrange(40))}") for d in range(60) for k in range(rng.randrange(2, 9))]
    links, members = dedup.directory_links(spark.createDataFrame(same + mixed, "path string, hash string"), 3)
    assert links.where("class_a = class_b AND shared = 10").count() == 1
    sets = {}
    for path, h in mixed:
        sets.setdefault(path.split("/")[0], set()).add(h)
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 3}
    got = dedup.directory_pairs(spark.createDataFrame(mixed, "path string, hash string"), 3)
    assert {tuple(r) for r in got.collect()} == want and want


def plain_by_name(old, new):
    """The pass in order of paths, one name after another."""
    base = lambda p: p.split("/")[-1].lower()
    out = []
    for k in sorted({base(p) for p, *_ in old}):
        left = sorted((p, h) for p, h in new if base(p) == k)
        if len(left) > moves.MAX_CANDIDATES:
            continue
        for path, hash_, linked in sorted(r for r in old if base(r[0]) == k):
            if not left:
                break
            here = path.split("/")[:-1]
            shared = [next((n for n, (x, y) in enumerate(zip(here, p.split("/")[:-1])) if x != y), min(len(here), p.count("/"))) for p, _ in left]
            at = shared.index(max(shared))
            near = shared[at] > 0 or (len(left) == 1 and not (here and "/" in left[at][0]))
            if near and (not hash_ or not left[at][1] or hash_ == left[at][1] or linked):
                out.append((path, left.pop(at)[0]))
    return sorted(out)


def test_pairing_by_name(spark):
    rng = random.Random(9)
    path = lambda: "/".join([rng.choice("pqr") for _ in range(rng.randrange(4))] + [rng.choice(["one.md", "two.md", "Three.md", "three.md"])])
    old = sorted({path(): (rng.choice(["", "h1", "h2", "h3"]), rng.random() < 0.3) for _ in range(150)}.items())
    new = sorted({"q/" * rng.randrange(2) + path(): rng.choice(["", "h1", "h2"]) for _ in range(40)}.items())
    new = [n for n in new if n[0].lower().endswith("two.md")][:14] + [n for n in new if not n[0].lower().endswith("two.md")][:12]
    old += [(f"deep/p/q/{i:04d}/one.md", ("h9", False)) for i in range(400)]  # a very common name
    o = spark.createDataFrame([(p, h, "F" if linked else "") for p, (h, linked) in old], "path string, hash string, file_id string")
    n = spark.createDataFrame(new, "path string, hash string")
    assert rows(moves.by_name(o, n)) == plain_by_name([(p, h, linked) for p, (h, linked) in old], new)
