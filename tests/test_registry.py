import importlib
import sys
from pathlib import Path

import duckdb
import pytest

from strandline.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(DATA))
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert comparable(df.collect(), df.columns) == comparable(found.fetchall(), names)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    hidden = [m for m in sys.modules if m.startswith("strandline.llm") or m == "corpus_pipeline"]
    for m in [*hidden, "strandline.llm", "strandline.llm.queries", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, m, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import strandline

    monkeypatch.delattr(strandline, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
