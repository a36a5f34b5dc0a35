"""Radix selection against sorting, on every kind of double."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.operators import metrics, selection
from test_metrics import CFG, skewed
from test_plans import plan

INF = float("inf")


def groups():
    rng = random.Random(1)
    tiny = 5e-324
    yield "normal", [rng.gauss(0, 1) for _ in range(501)]
    yield "one value", [7.25] * 300
    yield "two values", [1.0] * 100 + [2.0] * 100
    yield "half of them equal", [3.0] * 250 + [rng.random() for _ in range(250)]
    yield "magnitudes", [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)]
    yield "outlier", [rng.random() for _ in range(300)] + [1e308, -1e308]
    yield "infinite", [rng.random() for _ in range(200)] + [INF, INF, -INF]
    yield "subnormal", [tiny * rng.randint(0, 40) for _ in range(300)] + [-tiny * rng.randint(0, 9) for _ in range(60)]
    yield "neighbours", list(np.nextafter(1.0, 2.0) + np.arange(300) * 2.220446049250313e-16)
    yield "whole numbers", [float(rng.randint(-50, 50)) for _ in range(333)]
    yield "zeros", [0.0, -0.0] * 20
    yield "single", [4.0]


@pytest.mark.parametrize("few", [1, 50])
def test_values_of_ranks(spark, few):
    data = dict(groups())
    values = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "k string, v double").repartition(5).cache()
    wanted = [(g, r) for g, vs in data.items() for r in {1, 2, len(vs) // 3, (len(vs) + 1) // 2, len(vs) // 2 + 1, len(vs)} if 1 <= r <= len(vs)]
    got = selection.values_of_ranks(values, spark.createDataFrame(wanted, "k string, _rank bigint"), ["k"], "v", few).collect()
    assert sorted((r.k, r._rank) for r in got) == sorted(wanted)
    for r in got:
        assert r.v == sorted(data[r.k])[r._rank - 1], (r.k, r._rank)


def test_rounds_are_few(spark, monkeypatch):
    turns = []
    real = selection.digit
    monkeypatch.setattr(selection, "digit", lambda v, lo, hi, turn: turns.append(turn) or real(v, lo, hi, turn))
    rows = [(g, float(v)) for g, vs in groups() for v in vs]
    sizes = spark.createDataFrame([(g, len(vs)) for g, vs in groups()], "k string, n bigint")
    got = selection.medians(spark.createDataFrame(rows, "k string, v double"), sizes, ["k"], "v", 1).collect()
    for r in got:
        v = sorted(dict(groups())[r.k])
        assert r.median == 0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2]
    assert len(got) == len(dict(groups())) and max(turns) <= 6


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_plans_hold_no_list_of_values(spark, hot_rows):
    df = metrics.metric_summary(skewed(spark), CFG.with_(hot_rows=hot_rows))
    assert not re.search("percentile|RangePartitioning|rangepartitioning|collect_list|ObjectHashAggregate", plan(df), re.IGNORECASE)


def test_one_group_with_half_of_all_rows(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.lognormal(3, 2, 20_000), 3)
    rows = [("A" if i % 2 else f"S{i % 300}", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ProjectID string, `MS1.TIC` double").withColumns({
        "DateTime": F.lit(None).cast("timestamp_ntz"), "FileType": F.lit("Sample"), "RawFileName": F.lit("x"), "Date": F.lit(None).cast("date"), "Error": F.lit(None).cast("string")})
    whole = {r.ProjectID: (r.n, r.median) for r in metrics.metric_summary(df, CFG, ["tic"]).collect()}
    split = {r.ProjectID: (r.n, r.median) for r in metrics.metric_summary(df, CFG.with_(hot_rows=100), ["tic"]).collect()}
    assert whole == split
    for p in ("A", "S0", "S2"):
        assert whole[p][1] == np.median([v for q, v in rows if q == p])
