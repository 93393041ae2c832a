"""Every registered query of the package against its SQL twin, on a folder of small tables."""

import pytest

from citeloom.llm.catalogue import ORACLES, QUERIES
from tests.comparing import differences, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), duck(folder), ORACLES[name]) == []
