"""Every query with SQL gives what an independent engine gives on the same tables."""

import datetime
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, ".")
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.core.QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.core.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(cols).collect())
    if name not in entry.core.ORACLE:
        assert got
        return
    cur = duck.execute(entry.core.ORACLE[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


CORE_ONLY = """
import sys
import __spark_entry__ as entry
assert not [m for m in sys.modules if m.startswith(("tidemill.llm", "corpus_pipeline"))]
assert set(entry.queries()) == set(entry.core.QUERIES) and entry.core.QUERIES
assert set(entry.oracle_sql()) == set(entry.core.ORACLE)
"""


@pytest.mark.parametrize("broken", [False, True])
def test_core_works_without_the_optional_parts(tmp_path, broken):
    """In a copy without the folders, and in one whose optional package cannot be imported."""
    root = Path(entry.__file__).parent
    for name in ("tidemill", "__spark_entry__.py"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemill" / "llm", ignore_errors=True)
    if broken:
        (tmp_path / "tidemill" / "llm").mkdir()
        (tmp_path / "tidemill" / "llm" / "__init__.py").write_text("import no_such_module_anywhere")
    subprocess.run([sys.executable, "-c", CORE_ONLY], cwd=tmp_path, check=True, timeout=120)
