"""Measuring and running: repeated timings, resumable steps, released tables."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tokens import exists


def timings(df_of, repeats=5, warm=1) -> dict[str, float]:
    """Least and median seconds of running a query to its end, after warm-up runs."""
    taken = []
    for i in range(warm + repeats):
        began = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        if i >= warm:
            taken.append(time.perf_counter() - began)
    return {"min": min(taken), "median": statistics.median(taken)}


def step(spark: SparkSession, path: str, make, rerun=False) -> DataFrame:
    """The table at path, made if it is missing (or always, with rerun): a step that later runs skip."""
    if rerun or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sample(rows: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """Exactly n rows (all, if fewer) without replacement: those with the smallest MD5 of key and seed.

    The digest is uniform, so all but about sqrt(n) of the rows are known by their digest alone; only those
    around the n-th are put in order. Independent of how rows are dealt.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    total = rows.count()
    if n >= total:
        return rows
    around = 8 * (n / total / total) ** 0.5 + 8 / total
    low, high = max(0.0, n / total - around), min(1.0, n / total + around)
    sure, most = rows.agg(F.count(F.when(share < low, 1)), F.count(F.when(share < high, 1))).first()
    if not sure <= n <= most:
        low, high, sure = 0.0, 1.0, 0
    edge = rows.where((share >= low) & (share < high)).orderBy(digest, key).limit(n - sure)
    return rows.where(share < low).unionByName(edge)
