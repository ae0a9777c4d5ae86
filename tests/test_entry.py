"""The driver contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def library():
    from scrubline.plans import catalog_queries

    return catalog_queries


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/scrubline", tmp_path / "scrubline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_entry_imports_where_a_package_is_missing(tmp_path):
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ROOT})


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/scrubline"):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "scrubline.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def rows(d):
    cols = sorted(d.columns)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return cols, sorted(repr(tuple(plain(x) for x in r)) for r in d[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(library().ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert rows(library().QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(library().ORACLES[name]).df())
