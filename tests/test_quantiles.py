"""Exact quantiles without a group that meets in one task."""

import numpy as np
import pytest

from earmark.operators import evaluation


@pytest.mark.parametrize("n", [1, 2, 777])
def test_quantiles_are_those_of_numpy(spark, n):
    r = np.random.default_rng(n)
    rows = [(k, float(x)) for k in ("a", "b", None) for x in np.round(r.exponential(5, n), 1)]
    df = spark.createDataFrame([*rows, ("a", None), ("c", None)], "k string, x double")
    got = {x.k: x for x in evaluation.latency(df, "k", "x").collect()}
    for k in ("a", "b", None):
        v = np.array([x for g, x in rows if g == k])
        assert got[k].n == n and np.allclose([got[k].p50, got[k].p95, got[k].max], [*np.quantile(v, [0.5, 0.95]), v.max()], atol=1e-4)
    assert got["c"].n == 0 and got["c"].p50 is None


def test_no_group_is_collected_for_its_percentile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double")
    assert "percentile" not in evaluation.latency(df, "k", "x")._jdf.queryExecution().executedPlan().toString()
