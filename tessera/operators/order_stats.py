"""Ranks and exact quantiles from counts that run over ranges of values: no group and no column meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scoring import small
from tessera.sources.stages import cut_lineage


def running_counts(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """group, value, n (its rows) and before (the group's rows with a smaller value); null values don't count.

    Equal values are counted first. Ranges of (group, value) are then numbered by themselves and shifted by the
    group's rows in the ranges before, of which there are as many as partitions.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    ranges = cut_lineage(counted.repartitionByRange(*group, value).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part", *group).agg(F.sum("n").alias("held"))
    starts = sizes.select("part", *group, F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    numbered = ranges.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(starts, ["part", *group])
    return numbered.select(*group, value, "n", (F.col("start") + F.col("own")).alias("before"))


def mean_ranks(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """rows with ``rank``: from 1 by rising value within the group, ties getting their mean."""
    counts = running_counts(rows, value, *group)
    return rows.join(counts.select(*group, value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank")), [*group, value])


def quantiles(rows: DataFrame, value: str, at: dict[str, float], *group: str) -> DataFrame:
    """group and a column for each share in ``at``: the value there, between two neighbours in proportion."""
    counts = cut_lineage(running_counts(rows, value, *group))
    totals = small(counts.groupBy(*group).agg(F.sum("n").alias("total")))
    rows = counts.join(totals, list(group)) if group else counts.crossJoin(totals)  # one row
    place = lambda q: (F.col("total") - 1) * F.lit(float(q))
    held = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col(value)))
    picks = [x for k, q in at.items() for x in (held(F.floor(place(q))).alias(f"{k}_low"), held(F.ceil(place(q))).alias(f"{k}_high"), F.max(place(q) - F.floor(place(q))).alias(f"{k}_share"))]
    found = rows.groupBy(*group).agg(*picks)
    between = lambda k: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.col(f"{k}_share")
    return found.select(*group, *(between(k).alias(k) for k in at))
