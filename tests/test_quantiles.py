"""Exact bounded-memory quantiles equal brute force (numpy linear interpolation)."""

import numpy as np
import pytest

from prioscope.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("kind", ["dupes", "hot", "wide", "extreme", "tiny", "single"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "dupes":
        x = np.round(rng.normal(40, 30, 4001), 1)
    elif kind == "hot":       # one value holds a third of all rows
        x = np.concatenate([np.full(2000, 24.0), rng.exponential(30, 4000)])
    elif kind == "wide":
        x = np.concatenate([rng.uniform(-1e300, 1e300, 500), [1e-300, -1e-300, 0.0]])
    elif kind == "extreme":
        x = np.array([-1.7e308, 1.7e308, 0.0, 1.0, 5e-324])
    elif kind == "tiny":
        x = np.array([3.0, 1.0])
    else:
        x = np.array([5.0])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "h double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, "h", probs, bins=16)
    srt = np.sort(x)
    for p in probs:
        pos = p * (len(x) - 1)
        lo, hi = int(np.floor(pos)), int(np.ceil(pos))
        want = srt[lo] + (srt[hi] - srt[lo]) * (pos - lo)
        assert got[p] == want


def test_wide_range_and_nan(spark):
    from prioscope.operators.clean import time_baseline
    x = [4096.0 ** k for k in range(-80, 80)] + [-(4096.0 ** k) for k in range(-80, 80, 3)] + [0.0]
    df = spark.createDataFrame([(v,) for v in x] + [(float("nan"),), (None,)], "h double")
    srt = sorted(x)
    got = exact_quantiles(df, "h", [0.0, 0.5, 1.0])
    mid = (len(srt) - 1) / 2
    want = srt[int(mid)] + (srt[int(np.ceil(mid))] - srt[int(mid)]) * (mid - int(mid))
    assert got == {0.0: srt[0], 0.5: want, 1.0: srt[-1]}
    hours = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "resolution_hours double")
    assert time_baseline(hours).first().hours_median == 2.0


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "h double")
    assert exact_quantiles(df, "h", [0.5]) == {0.5: None}


def test_describe_equals_pandas(spark):
    """count, mean, sample std, min, quartiles, max over non-null values (pandas rules)."""
    import pandas as pd
    from prioscope.operators.reports import describe
    rng = np.random.default_rng(11)
    x = np.concatenate([np.round(rng.exponential(30, 3001), 1), np.full(700, 24.0)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "h double").repartition(7)
    got = describe(df, "h").first().asDict()
    want = pd.Series(x).describe()
    assert got["count"] == int(want["count"])
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                         ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert got[ours] == pytest.approx(want[theirs], rel=1e-12), ours
