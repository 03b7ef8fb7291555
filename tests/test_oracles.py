"""Every query with SQL of its own, against DuckDB on the same tables."""

import pytest

from leafmill.plans import registry
from tests import oracle
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, con):
    assert oracle.differences(registry.QUERIES[name](spark, SF_DIR), registry.ORACLES[name], con) == ""


def test_whole_tables_are_read(spark, con):
    """No query reads a subset of ids, and results that were made of one grow with their tables."""
    count = lambda sql: con.execute(sql).fetchone()[0]
    for name in ("j_range", "a_unpivot", *(f"s_{kind}{every}" for kind in ("union", "intersect", "except") for every in ("", "_all"))):
        for suffix in ("", "_whole"):
            sql = registry.ORACLES[name + suffix]
            assert "key <" not in sql and count(f"SELECT count(*) FROM ({sql})") > 0, name
    rows = {n: count(f"SELECT count(*) FROM {n}") for n in ("customer", "supplier", "lineitem")}
    assert registry.QUERIES["s_union_all"](spark, SF_DIR).count() == rows["customer"] + rows["supplier"]
    assert registry.QUERIES["a_unpivot"](spark, SF_DIR).count() == 3 * rows["lineitem"]


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_approximations_are_near(spark):
    from pyspark.sql import functions as F

    got = {r["l_returnflag"]: r for r in registry.QUERIES["a_approximate"](spark, SF_DIR).collect()}
    exact = registry.table(spark, SF_DIR, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.median("l_extendedprice").alias("m"))
    for r in exact.collect():
        assert abs(got[r["l_returnflag"]]["n_parts"] / r["n"] - 1) < 0.1
        assert abs(got[r["l_returnflag"]]["median_price"] / r["m"] - 1) < 0.01
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"a_approximate"}


def test_entry_without_the_llm_subpackage():
    """The registry stands on its own where the subpackage is absent."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['leafmill.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
