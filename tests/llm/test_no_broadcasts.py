"""Where no side is small enough to be broadcast, and single lines are hot, results are the same."""

import pytest

from claimspark.llm import decontam, linededup, neardup, pack, quality, queries, secrets

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "module"), [("op4_secrets", secrets), ("op5_line_dedup", linededup), ("op6_decontamination", decontam), ("op7_quality_rules", quality), ("op8_near_duplicates", neardup), ("op10_best_fit_packing", pack)])
def test_results_are_the_same(spark, monkeypatch, name, module):
    result = lambda: sorted(map(str, queries.queries()[name](spark, DATA).collect()))
    expected = result()
    monkeypatch.setattr(module, "small_side", lambda df, *args, **more: df)
    monkeypatch.setattr(linededup, "HOT", 300)
    assert result() == expected and expected
