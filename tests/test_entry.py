import os
import sys

import pytest

import __spark_entry__ as e
from strandloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.oracles()) <= set(registry.queries())


def test_core_does_not_import_the_training_part():
    import subprocess

    code = "import sys, strandloom.plans.registry as r; r.queries(); assert not [m for m in sys.modules if m.startswith('strandloom.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(e.__file__)).returncode == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p1_found", "p1_item_counts", "kminmer_counts", "mdbg_edges", "gfa_text"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("minspace", "nodes", "edges"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = e.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))
