"""The entry module, and every query with SQL against DuckDB on the smallest tables."""
import math
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from vistalake.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "conversations")


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(plans.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*columns).collect()) == plain(con.sql(f"select {quoted} from want").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_llm_folder():
    import subprocess

    code = "import sys; sys.modules['vistalake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 50 and len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
