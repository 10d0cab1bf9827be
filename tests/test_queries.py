"""Every registered query on the smallest data, against its SQL where there is one."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from assayer.plans.registry import TABLES
from check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return base


def test_entry_has_a_stable_schema(spark):
    first = entry.entry(spark)
    assert first.columns == entry.entry(spark).columns and first.count() > 0


def test_every_check_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_other_queries_stay_where_a_dependency_is_missing():
    code = "import sys; sys.modules['{0}'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), [n for n in e.queries() if n == 'pipeline' or n[:2] == 'op'])"
    own = [n for n in QUERIES if n != "pipeline" and not n.startswith("op")]
    for hidden in ("assayer.llm", "corpus_pipeline", "pyarrow.missing"):
        out = subprocess.run([sys.executable, "-c", code.format(hidden)], capture_output=True, text=True, check=True).stdout.split(" ", 1)
        assert int(out[0]) == (len(QUERIES) if hidden == "pyarrow.missing" else len(own))
        assert (out[1].strip() == "[]") == (hidden != "pyarrow.missing" or len(own) == len(QUERIES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    result = QUERIES[name](spark, FOLDER)
    mine = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if name in ORACLES:
        cursor = engine.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(result.columns) == sorted(columns)
        assert mine == rows_of(columns, cursor.fetchall())
