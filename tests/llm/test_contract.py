"""Contract queries against DuckDB where SQL can say it."""

import pytest

from tarnlight.llm.oracles import ORACLES
from tarnlight.llm.queries import QUERIES
from tools.compare import compare, duck


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    said = compare(spark, duck(sf), QUERIES[name], ORACLES.get(name), sf)
    assert said.startswith(("ok", "rows only")), said


def test_pii_is_native(spark, sf):
    plan = QUERIES["op3_pii"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Exchange" not in plan
