"""Quantiles by selection and dense numbers, against sorted lists."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest

from passagekit.operators import metrics
from passagekit.operators.ordering import numbered
from passagekit.operators.quantiles import nearest_rank


def plain(rows, share):
    groups: dict = {}
    for key, v in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(key, []).append(v)
    return {k: sorted(vs)[max(1, math.ceil(Decimal(share) * len(vs))) - 1] for k, vs in groups.items()}


@pytest.mark.parametrize("share", ["0.95", "0.001"])
def test_selection_in_several_passes(spark, share):
    rng = random.Random(3)
    rows = [("uniform", rng.random()) for _ in range(700)] + [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 307)) for _ in range(700)]
    rows += [("equal", 5.0)] * 400 + [("two", float(rng.random() < 0.5)) for _ in range(300)] + [(None, rng.gauss(0, 1)) for _ in range(100)]
    rows += [("steep", 2.0**-i) for i in range(300)] + [("one", 7.0), ("none", None), ("none", float("nan")), ("two", float("inf")), ("one", None)]
    rows += [("far", -1.7e308), ("far", 1.7e308)] * 30
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantile for r in nearest_rank(df, "v", share, "g", few=10).collect()}
    assert got == plain(rows, share)


def test_whole_tables_and_empty_ones(spark):
    df = spark.range(1000).selectExpr("cast(id AS double) AS v")
    assert [tuple(r) for r in nearest_rank(df, "v", "0.95", few=4).collect()] == [(949.0,)]
    assert nearest_rank(df.limit(0), "v", "0.95").collect() == []


def test_latency_has_no_percentile_and_no_group_in_one_task(spark):
    rows = [(i, "a" if i % 3 else None, float(i % 97)) for i in range(500)]
    df = spark.createDataFrame(rows, "o int, g string, v double")
    out = metrics.latency(df, "v", "o", "g")
    got = {r.g: (r.n, r.first, r.p95) for r in out.collect()}
    want = plain([(g, v) for _, g, v in rows], "0.95")
    assert got == {"a": (333, 1.0, want["a"]), None: (167, 0.0, want[None])}
    assert "percentile" not in out._jdf.queryExecution().toString()


def test_dense_numbers(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", f"{rng.random()}"]), i, 9) for i in range(2000)]
    df = spark.createDataFrame(rows, "path string, id int, index int").repartition(9)
    got = sorted((r["index"], r.path, r.id) for r in numbered(df, "path", "id").collect())
    want = sorted(((p, i) for p, i, _ in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == [(n, p, i) for n, (p, i) in enumerate(want)]
    assert {r.place for r in numbered(df, "path", name="place", first=1).collect()} == set(range(1, 2001))
    assert numbered(df.limit(0), "path").collect() == []


def test_dense_numbers_need_no_single_task(spark):
    plan = numbered(spark.range(100).selectExpr("id * 7 % 100 AS x"), "x")._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
