"""Every query of the core that has an oracle agrees with it; the others don't depend on partitioning."""

import os

import pytest

from paperloom.plans import registry
from tests.checks import connect, rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_same_rows_however_partitioned(spark, name):
    """Queries without an oracle, whose operators have tests of their own, give rows, and the same ones of another partitioning."""
    got = rows(registry.QUERIES[name](spark, FOLDER).toPandas())
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = rows(registry.QUERIES[name](spark, FOLDER).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    if name == "q_topics":  # the library's online LDA draws its batches by partition
        got, again = sorted(r.split(", ")[0] for r in got), sorted(r.split(", ")[0] for r in again)
    # At this scale nobody bursts and no two documents are near.
    assert got == again and (got or name in ("q_bursts", "q_near_documents"))
