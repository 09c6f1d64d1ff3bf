from __future__ import annotations

import pytest

from lorekeep.conformance import Runner, by_guarantee, run_cases
from tests.cases import CASES


@pytest.mark.parametrize("case", CASES, ids=lambda c: c["case"])
def test_case(spark, case):
    assert Runner(spark, case).run().failures == []


def test_cases_are_complete(spark):
    assert len(CASES) >= 20 and len({c["guarantee"] for c in CASES}) >= 15
    with pytest.raises(ValueError, match="guarantee"):
        Runner(spark, {"title": "x", "steps": [1]})


def test_summary(spark):
    outcomes = run_cases(spark, [c for c in CASES if c["case"] == "schema-validation"])
    assert by_guarantee(spark, outcomes) == [{"guarantee": "schema-validation", "passed": 1, "cases": 1}]
