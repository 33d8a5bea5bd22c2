"""Reports over more than one month count dates, not days of the month."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from topiclake.operators import scaling, temporal


@pytest.fixture(scope="module")
def two_months(spark):
    start = dt.datetime(2025, 1, 6, 9)
    rows = [(start + dt.timedelta(days=i),) for i in range(56)]
    return spark.createDataFrame(rows, "ts timestamp")


def test_days_of_different_months_stay_apart(two_months):
    assert temporal.posts_per_day(two_months, "ts").count() == 56
    assert temporal.posts_per_day_and_hour(two_months, "ts").filter("posts = 1").count() == 56


def test_means_over_dates(two_months):
    hours = temporal.hour_means(two_months, "ts").collect()
    assert [(r.HORA, r.groups, r.mean_posts) for r in hours] == [(9, 56, 1.0)]
    week = temporal.weekday_means(two_months, "ts").collect()
    assert [(r.weekday, r.groups, r.mean_posts) for r in week] == [(i, 8, 1.0) for i in range(7)]


@pytest.mark.parametrize("value", [float("nan"), float("inf")])
def test_scaling_refuses_what_is_not_finite(spark, value):
    df = spark.createDataFrame([([1.0, 2.0],), ([value, 3.0],), ([2.0, 4.0],)], "v array<double>")
    for scale in (scaling.min_max_scale, scaling.robust_scale):
        with pytest.raises(ValueError, match="not finite"):
            scale(df, "v")


def test_bootstrap_interval(spark):
    """Equal to numpy with the same weights; a group with one date and null values included."""
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3}", f"2024-01-{i % 28 + 1:02d}", float(rng.integers(0, 50))) for i in range(60)]
    rows += [("one", "2024-02-01", 7.0), ("g0", "2024-02-02", None), (None, None, 5.0), (None, "2024-02-03", 9.0)]
    df = spark.createDataFrame(rows, "g string, day string, x double").repartition(5)
    got = {r.g: r for r in temporal.bootstrap_interval(df, ["g"], "day", "x", 200, 11).collect()}
    assert set(got) == {"g0", "g1", "g2", "one", None}
    for g, found in got.items():
        own = [(d or "", x) for h, d, x in rows if h == g and x is not None]
        means = []
        for r in range(1, 201):
            u = [int(hashlib.md5(f"11:{d}:{r}".encode()).hexdigest()[:13], 16) / 2**52 for d, _ in own]
            w = np.searchsorted(temporal.POISSON, u, side="right")
            if w.sum():
                means.append((w * [x for _, x in own]).sum() / w.sum())
        assert np.isclose(found["mean"], np.mean([x for _, x in own]))
        np.testing.assert_allclose([found.low, found.high], np.quantile(means, temporal.LIMITS))
