"""The registered queries against their SQL, and the entry without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkward.plans import registry

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, tables, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), tables.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_reachability_tells_patterns_from_calls(spark):
    from sparkward.operators.suppress import INERT

    got = {r.filter_reason: r.n for r in registry.QUERIES["reachability"](spark, SF).collect()}
    assert set(got) == {INERT, ""}


def test_entry_without_the_optional_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'sparkward.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline'], q.keys(); assert e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
