"""Every registered query of the engine against its oracle, and the rest for rows."""

import pytest

from codeloom.plans import queries

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    assert oracle.spark_rows(queries.QUERIES[name](spark, SF)) == oracle.duck_rows(con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_indirect_dependents_count(spark):
    """On the dense graph dependents and tests are counted; on the sparse one all four levels occur and scores vary."""
    got = queries.QUERIES["impact_blast_radius"](spark, SF).collect()
    assert sum(r["indirect"] for r in got) > 0 and sum(r["tests"] for r in got) > 0
    got += queries.QUERIES["blast_radius_of_orders"](spark, SF).collect()
    assert {r["level"] for r in got} == {"LOW", "MEDIUM", "HIGH", "CRITICAL"} and len({r["score"] for r in got}) > 20


def test_walks_start_from_every_symbol(spark):
    chain = queries.QUERIES["depends_chain"](spark, SF)
    symbols = spark.read.parquet(f"{SF}/part.parquet").count()
    assert chain.where("depth = 0").count() == symbols
    assert queries.QUERIES["impact_blast_radius"](spark, SF).where("target_id % 50 > 0").count() > symbols // 2
