"""Every registered query against the SQL that states the same result, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
# Their SQL states the case of a wide cross-section, which the smallest tables do not have.
WIDE_SF = "/root/testdata/sf0.01"
WIDE = {"constraint_sequence", "constraint_statuses", "quantile_summary"}
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return {sf: connect(sf) for sf in (SF, WIDE_SF)}


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    sf = WIDE_SF if name in WIDE else SF
    status, _, _, note = compare(spark, con[sf], name, queries()[name], ORACLES.get(name), sf)
    assert status in ("ok", "rows-only"), note
