"""Ranks, quantiles and samples against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import harness, order_stats, stats


def test_ranks_and_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(int(g), int(i), None if i % 50 == 7 else float(np.round(r.normal(), 1))) for i, g in enumerate(r.choice(4, 3000, p=[0.9, 0.05, 0.04, 0.01]))]
    df = spark.createDataFrame(rows, "g long, i long, x double").repartition(7)
    at = {"least": 0.0, "q": 0.25, "m": 0.5, "p": 0.95, "most": 1.0}
    got = {r.g: r for r in order_stats.quantiles(df, "x", at, "g").collect()}
    ranks = {r.i: r["rank"] for r in order_stats.mean_ranks(df, "x", "g").collect()}
    for g in range(4):
        own = [(i, x) for h, i, x in rows if h == g and x is not None]
        x = np.array([x for _, x in own])
        assert all(abs(got[g][k] - np.quantile(x, q)) < 1e-9 for k, q in at.items())
        assert all(ranks[i] == (x < y).sum() + ((x == y).sum() + 1) / 2 for i, y in own)
    whole = order_stats.quantiles(df, "x", at).first()
    every = np.array([x for *_, x in rows if x is not None])
    assert all(abs(whole[k] - np.quantile(every, q)) < 1e-9 for k, q in at.items())
    assert order_stats.quantiles(df.where("false"), "x", at, "g").count() == 0


def test_no_window_over_a_query_and_no_single_task(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("qid"), F.col("id").alias("doc_id"), F.rand(3).alias("score"))
    plan = stats.spearman(df, df)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition" in x]
    assert windows and all("part" in x for x in windows)
    assert "SinglePartition" not in stats.medians(df, "score", "qid")._jdf.queryExecution().executedPlan().toString()
    assert stats.spearman(df, df).where("rho < 0.999999").count() == 0


@pytest.mark.parametrize("n", [1, 40, 4000, 99_999])
def test_samples_are_exact_and_even(spark, n):
    got = [r.id for r in harness.sample(spark.range(100_000), "id", n).collect()]
    assert len(got) == len({*got}) == n
    assert sorted(got) == sorted(r.id for r in harness.sample(spark.range(100_000).repartition(5), "id", n).collect())
    if n == 4000:
        assert abs(np.mean(got) - 50_000) < 5 * 100_000 / np.sqrt(12 * n)
        by = np.bincount(np.array(got) % 10, minlength=10)
        assert ((by - 400) ** 2 / 400).sum() < 40
        other = {r.id for r in harness.sample(spark.range(100_000), "id", n, seed=1).collect()}
        assert len(other & {*got}) < 300


def test_a_scope_frees_what_it_stored(spark):
    import os

    from tessera.sources import stages

    outer = stages.cut_lineage(spark.range(3))
    with pytest.raises(KeyError), stages.scope(spark):
        inner = stages.cut_lineage(spark.range(5))
        with stages.scope(spark):
            nested = stages.cut_lineage(spark.range(7)).inputFiles()
        kept = stages.keep(spark, ("test",), lambda: stages.cut_lineage(spark.range(9)))
        files = inner.inputFiles()
        assert inner.count() == 5 and not any(os.path.exists(f.removeprefix("file://")) for f in nested)
        raise KeyError
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert outer.count() == 3 and kept.count() == 9 and stages.keep(spark, ("test",), list) is kept
