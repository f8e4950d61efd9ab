"""The entry's queries against their SQL on the smallest tables, and without the optional subpackage."""
import os
import shutil
import subprocess
import sys
import textwrap

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import DATA, ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SKIP = ("op", "pipeline")  # tested beside their subpackage
SLOW = ("monte_carlo", "conditional_monte_carlo", "ignition_model")  # at production settings; their operators have tests of their own


def frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if c == "day" or kind.startswith("datetime"):
            df[c] = df[c].astype(str).str[:10]
        elif kind in ("bool", "boolean", "object"):
            df[c] = [("~" if v is None or v != v else str(v)) for v in df[c]]
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(SKIP)])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    got = frame(entry.queries()[name](spark, f"{DATA}/sf0.001").toPandas())
    want = frame(c.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(SKIP) and n not in SLOW])
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, f"{DATA}/sf0.001").count() >= 0


def test_imports_without_the_optional_subpackage(tmp_path):
    """A copy without the folders of the subpackage and without the pipeline still imports."""
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "emberlake"), tmp_path / "emberlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = """
        import __spark_entry__ as e
        assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
        assert set(e.oracle_sql()) <= set(e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_a_broken_pipeline_is_an_error(tmp_path):
    for name in ("__spark_entry__.py",):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "emberlake"), tmp_path / "emberlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_anywhere")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode and b"no_such_module_anywhere" in done.stderr
