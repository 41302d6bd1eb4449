"""The named queries against their SQL, on the smallest tables; and what must hold without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tabloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark")


def _rows(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _rows(df.select(columns).collect())
    if name not in catalog.ORACLES:
        assert got and name in {"q18_fuzzy_metrics", "q23_legacy_fuzzy"}
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == columns
        assert got == _rows(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_the_rest_works_without_the_optional_folders(tmp_path):
    root = Path(__file__).parent.parent
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    for part in ("tabloom", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(root / part) if part.endswith(".py") else _copy(root / part, tmp_path / part)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def _copy(source: Path, target: Path) -> None:
    import shutil

    shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
