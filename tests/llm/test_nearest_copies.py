"""Nearest neighbours among rows that repeat."""

import pytest
from pyspark.sql import functions as F

from gleanery.llm import ann as A

from .test_corpus_operators import vectors


@pytest.mark.parametrize("times", [1, 2, 21])
def test_repeated_rows_push_no_copy_out(spark, times):
    """A query among 40 equal vectors gets the 20 smallest other ids, however often each row stands."""
    equal = [(i, [1.0, 0.0, 0.0], "c") for i in range(40)] * times
    others = [(100 + i, [0.5, float(i + 1) / 100, 0.1], "c") for i in range(100)]
    got = A.nearest(vectors(spark, [], equal + others), F.col("vec_id") % 13 == 0, k=20).collect()
    for q in (0, 13, 26, 39):
        found = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert found == [(i, 1.0) for i in range(40) if i != q][:20]
