"""The driver's entry points, and queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"


def values(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def test_names():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 35


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert values(entry_points.queries()[name](spark, SF).toPandas()) == values(duck.sql(entry_points.oracle_sql()[name]).df())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r.lang for r in rows} == {"de", "en", "es", "fr"} and all(r.chunks >= r.documents for r in rows)


def test_library_works_without_the_llm_folder(tmp_path):
    """A copy without the folder, its tests and the pipeline still imports, and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_points.__file__).parent
    shutil.copytree(root / "passagelab", tmp_path / "passagelab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) >= 30, said.stderr
