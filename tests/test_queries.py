"""Every registered query with an oracle gives the oracle's rows; the others give rows."""

from pathlib import Path

import pytest

from larkspar.registry import QUERIES, SQL
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        # tests of their operators hold these against plain loops; here they give rows without gaps in their keys
        assert len(got) and not got.iloc[:, 0].isna().any()
        return
    want = oracle(SQL[name], SF)
    assert rows(got) == rows(want)
