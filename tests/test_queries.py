"""Every query against its SQL on the smallest tables."""

import re
from pathlib import Path

import pytest

from skerry.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    show = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(show, r)) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, tables, con, name):
    got, want = catalog.queries()[name](spark, tables).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE)))
def test_rows_only(spark, tables, name):
    assert catalog.queries()[name](spark, tables).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"path", "state", "action", "phase"} and df.count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_operators_stay_apart():
    root = Path(__file__).resolve().parents[1] / "skerry"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bskerry\.llm\b", f.read_text()), f
