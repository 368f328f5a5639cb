import duckdb
import pytest

import __spark_entry__ as entry
from sparkward.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    order = [expected.columns.index(x) for x in columns]
    assert sorted(str([value(v) for v in r]) for r in got.select(columns).collect()) == sorted(str([value(r[i]) for i in order]) for r in expected.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 125


def test_without_text_operators():
    """Where the subpackage, or what it needs, can't be imported, the other queries stay."""
    import importlib.util
    import os
    import subprocess
    import sys

    there = importlib.util.find_spec("sparkward.llm") is not None
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for missing in ("sparkward.llm", "xxhash", "corpus_pipeline"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(sorted(e.queries())); e.oracle_sql()"
        told = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout
        assert "'scan_sources'" in told and "'report_json'" in told and "'pipeline'" not in told and ("'op1_toxicity'" in told) == (there and missing == "corpus_pipeline")
