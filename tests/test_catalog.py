from __future__ import annotations

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from seekframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("seekframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    package = importlib.import_module("seekframe")
    monkeypatch.delattr(package, "llm", raising=False)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("seekframe.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
    for p in (Path(catalog.__file__).parent.parent).rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
