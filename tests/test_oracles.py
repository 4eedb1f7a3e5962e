"""Every query of the engine's own operators against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from scholia import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


#: Many small jobs each: run with SCHOLIA_ALL_TESTS=1; the driver's own check runs them as well.
SLOW = {n for n in ORACLE if n.startswith(("grf", "rel", "top4", "vec4", "vec5", "agg13", "top2"))} - {"grf2_components", "rel1_relations"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - (set() if os.environ.get("SCHOLIA_ALL_TESTS") else SLOW)))
def test_query(spark, duck, name, tmp_path):
    QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TABLE mine AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE[name]}")
    columns = lambda t: sorted(r[0] for r in duck.execute(f"DESCRIBE {t}").fetchall())
    assert columns("mine") == columns("want")
    names = ", ".join(f'"{c}"' for c in columns("mine"))
    for a, b in (("mine", "want"), ("want", "mine")):
        assert duck.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []
