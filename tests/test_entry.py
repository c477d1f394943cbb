import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = ("op", "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(frame, columns):
    def plain(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith(SLOW)))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    out = entry.entry(spark).toPandas()
    assert len(out) and not math.isnan(out.chars.sum())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, pipeline_too):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *["corpus_pipeline.py"] * pipeline_too))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not [n for n in q if n.startswith(('op1', 'op6', 'pipeline'))], sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
