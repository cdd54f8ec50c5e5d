"""Operators that go round until nothing changes say so when rounds run out."""

import pytest

from sightline.operators import graph
from sightline.operators.references import Link, orphan_cascade


def test_rounds_that_run_out_raise(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 7)], "id long, up long")
    direct = spark.createDataFrame([("t", 0)], "tbl string, id long")
    link = [Link("t", "t", chain, "id", "up")]
    with pytest.raises(RuntimeError):
        orphan_cascade(direct, link, max_rounds=3)
    assert orphan_cascade(direct, link, max_rounds=7).count() == 7
    with pytest.raises(RuntimeError):
        graph.components(chain, "id", "up", max_rounds=1, finish_links=0)
