"""Shaping of benchmark reports: speedups, Pareto lists, frontiers, sweeps and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_probe(report: DataFrame, nprobe: int, labels: list[str]) -> DataFrame:
    """label, avg, recall at one nprobe, first row per label, in the given order of labels (``place``)."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int")
    first = Window.partitionBy("dataset", "label").orderBy("avg")
    rows = report.where((F.col("ivf_nprobe") == nprobe) & F.col("label").isin(labels)).withColumn("rn", F.row_number().over(first))
    return rows.where("rn = 1").select("dataset", place.alias("place"), "label", "avg", "recall")


def speedup(report: DataFrame, baseline="Brute-force") -> DataFrame:
    """Each row's speedup over the baseline with the same data set and nprobe; none without a baseline."""
    base = report.where(F.col("label") == baseline).select("dataset", "ivf_nprobe", F.col("avg").alias("base"))
    rows = report.where(F.col("label") != baseline).join(base, ["dataset", "ivf_nprobe"])
    return rows.select("dataset", "ivf_nprobe", "label", (F.col("base") / F.col("avg")).alias("speedup")).where("speedup IS NOT NULL")


def speedup_summary(report: DataFrame, baseline="Brute-force") -> DataFrame:
    return speedup(report, baseline).groupBy("label").agg(F.max("speedup").alias("peak"), F.median("speedup").alias("median"))


def pareto(report: DataFrame, least=0.9) -> DataFrame:
    """dataset, label, recall, avg of rows that reach a recall, by recall."""
    return report.where(F.col("recall") >= least).select("dataset", "label", "recall", "avg").orderBy("dataset", "label", "recall")


def datasets(report: DataFrame) -> DataFrame:
    return report.where(F.col("dataset").isNotNull()).select("dataset").distinct()


def verdict(value: Column, passes: float, marginal: float, rising=True) -> Column:
    """PASS, MARGINAL or FAIL against two thresholds; rising: more is better."""
    reach = (lambda t: value >= t) if rising else (lambda t: value < t)
    return F.when(reach(passes), "PASS").when(reach(marginal), "MARGINAL").otherwise("FAIL")


def gain_verdict(gain: Column, least=10.0) -> Column:
    return F.when(gain >= least, "PASS").otherwise("FAIL")


def recall_verdict(gain: Column, cost: Column, least=5.0, most=1.15) -> Column:
    """PASS for enough gain at acceptable cost, COSTLY for enough gain alone, else FAIL."""
    return F.when((gain >= least) & (cost <= most), "PASS").when(gain >= least, "COSTLY").otherwise("FAIL")


def pivot_shares(rows: DataFrame, key: str, column: str, values: list, value: str) -> DataFrame:
    """One row a key, one column a value."""
    return rows.groupBy(key).pivot(column, values).agg(F.first(value))


def frontier_mean(points: DataFrame) -> DataFrame:
    """arm, shrink and mean recall and work over data sets."""
    return points.groupBy("arm", "shrink").agg(F.avg("recall").alias("recall"), F.avg("work").alias("work"))


def over_best(points: DataFrame, arm: str, others: list[str]) -> DataFrame:
    """k, fraction and how far an arm's recall lies above the best of the others."""
    best = F.array_max(F.array(*(F.max(F.when(F.col("arm") == o, F.col("recall"))) for o in others)))
    return points.groupBy("k", "fraction").agg((F.max(F.when(F.col("arm") == arm, F.col("recall"))) - best).alias("gain"))


def sweep_points(grid: list[int], most: int) -> list[int]:
    """The grid's points up to ``most``, and ``most`` itself."""
    inside = [g for g in grid if g <= most]
    return inside if most in inside else [*inside, most]
