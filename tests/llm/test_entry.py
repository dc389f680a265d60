"""The registration of this package's queries, and their SQL on small tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from lakesync.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(E.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(E.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy())) == sorted(map(tuple, want.astype(str).to_numpy()))


def test_nothing_else_imports_this_package():
    """Without the package and the pipeline, the entry imports and the other queries are there."""
    root = Path(E.__file__).parent
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('lakesync.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name=name)\n"
            "import importlib.util as u\n"
            "real = u.find_spec\n"
            "u.find_spec = lambda n, p=None: None if n.startswith(('lakesync.llm', 'corpus_pipeline')) else real(n, p)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as E\n"
            "q = E.queries(); assert len(q) >= 34 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; E.oracle_sql()\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
