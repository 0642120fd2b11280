"""A facet answer with too many buckets is refused, not cut."""

import pytest

from quarry.errors import IllegalArgument
from quarry.operators import aggs
from quarry.operators.search import Index, search


def test_too_many_buckets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(aggs, "MOST_BUCKETS", 3)
    rows = Index.of_table("rows", spark.range(4).selectExpr("id", "cast(id as string) AS k"), "id")

    def found(size):
        return search(rows, {"size": 0, "aggs": {"by": {"terms": {"field": "k", "size": size}}}})

    assert found(10).table("by").count() == 4
    with pytest.raises(IllegalArgument):
        found(10).response()
    assert len(found(3).response()["aggregations"]["by"]["buckets"]) == 3
