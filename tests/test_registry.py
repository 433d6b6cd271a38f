"""Every registered query at the smallest scale, against DuckDB where it has a SQL twin."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as reg
import check_queries as cq

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = reg.queries(), reg.oracle_sql()
ROOT = pathlib.Path(reg.__file__).parent

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test data not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in cq.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert cq.compare(got, duck.execute(ORACLES[name]).df()) == ""


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """A copy without the optional part still imports and registers its own queries."""
    for part in ("castwise", "__spark_entry__.py"):
        source = ROOT / part
        copy = shutil.copytree if source.is_dir() else shutil.copy
        copy(source, tmp_path / part)
    shutil.rmtree(tmp_path / "castwise" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    assert reg.entry(spark).count() > 0


def test_no_shortcuts_in_the_library():
    banned = re.compile(r"localCheckpoint|crossJoin|\.rdd\b|toPandas|collect_list\(\"")
    for path in (ROOT / "castwise").rglob("*.py"):
        assert not banned.search(path.read_text()), path
