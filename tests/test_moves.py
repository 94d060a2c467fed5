"""Move detection against a plain sequential version, and the entry without the text operators."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from skerry.operators import moves
from skerry.sources.staging import numbered

SIDE = "path string, file_id string, hash string"


def test_two_rows_of_one_key_pair_twice(spark):
    old = spark.createDataFrame([("a", "1", ""), ("b", "1", "")], SIDE)
    new = spark.createDataFrame([("x", "1", ""), ("y", "1", "")], SIDE)
    assert sorted(map(tuple, moves.by_id(old, new).collect())) == [("a", "x"), ("b", "y")]


def test_different_contents_pair_by_name_only_with_an_id(spark):
    new = spark.createDataFrame([("d/x/note.md", "", "h2"), ("d/x/plan.md", "", "h2")], SIDE)
    old = spark.createDataFrame([("d/note.md", "", "h1"), ("d/plan.md", "7", "h1")], SIDE)
    assert [tuple(r) for r in moves.by_name(old, new).collect()] == [("d/plan.md", "d/x/plan.md")]


def test_second_hash_of_a_deleted_path(spark):
    old = spark.createDataFrame([("a", ["h1", "h2"]), ("b", ["h1"])], "path string, hashes array<string>")
    new = spark.createDataFrame([("x", "", "h2"), ("y", "", "h1")], SIDE)
    assert sorted(map(tuple, moves.by_hash(old, new).collect())) == [("a", "y")]
    old = spark.createDataFrame([("a", ["h0", "h2"]), ("b", ["h1"])], "path string, hashes array<string>")
    assert sorted(map(tuple, moves.by_hash(old, new).collect())) == [("a", "x"), ("b", "y")]


def test_names_choose_in_order(spark):
    rng = random.Random(5)
    folder = lambda: "/".join(rng.choices("pq", k=rng.randrange(4)))
    name = lambda k: f"n{rng.randrange(12)}.md"
    make = lambda side, n: sorted({f"{folder()}/{side}{k % 3}/{name(k)}".lstrip("/") if rng.random() < 0.8 else name(k) for k in range(n)})
    old, new = make("o", 150), [p for p in make("w", 60)]
    old = [p for p in old if p not in new]
    rows = lambda ps: [(p, rng.choice(["", "F"]), rng.choice(["", "h1", "h2"])) for p in ps]
    a, b = rows(old), rows(new)
    want, used = [], set()
    for path, file_id, h in a:
        same = [x for x in b if x[0].split("/")[-1] == path.split("/")[-1]]
        free = [x for x in same if x[0] not in used]
        if len(same) > 10 or not free:
            continue

        def depth(x, path=path):
            k = 0
            for s, t in zip(path.split("/")[:-1], x[0].split("/")[:-1], strict=False):
                if s != t:
                    break
                k += 1
            return k

        best = max(free, key=depth)
        if depth(best) < 1 and not (len(free) == 1 and ("/" not in path or "/" not in best[0])):
            continue
        if h and best[2] and h != best[2] and not file_id:
            continue
        want.append((path, best[0]))
        used.add(best[0])
    got = moves.by_name(spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("most", (0, 1000))
def test_numbered_across_ranges(spark, most):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(50)]
    got = {(r["k"], r["v"]): r["n"] for r in numbered(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], most=most).collect()}
    want = {}
    for k, v in sorted(rows):
        want[k, v] = 1 + sum(1 for x in want if x[0] == k)
    assert got == want


def test_entry_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "skerry", tmp_path / "skerry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / f).exists():
            shutil.copy(root / f, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recon_action_plan' in q and 'pipeline' not in q, sorted(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_stages_take_nothing_away_twice(spark, monkeypatch):
    seen = []

    def by_id(old, new):
        seen.append(old._jdf.queryExecution().analyzed().toString().count("LeftAnti"))
        return moves.by_id(old, new)

    monkeypatch.setitem(moves.STAGES, "seen", by_id)
    rows = spark.createDataFrame([("a", "old", "1", ""), ("b", "new", "1", ""), ("c", "old", "2", ""), ("d", "new", "3", "")], "path string, state string, file_id string, hash string")
    found = moves.run_stages(rows, [("id", "old", "new"), ("seen", "old", "new"), ("seen", "old", "new")])
    assert [tuple(r) for r in found.collect()] == [("a", "b", "id")] and seen == [0, 0]
