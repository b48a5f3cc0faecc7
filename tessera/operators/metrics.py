"""Retrieval quality of a run (qid, doc_id, rank) against judgements (qid, doc_id, rel).

Every judged query counts: one without hits scores zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hits(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k).join(qrels.where("rel > 0"), ["qid", "doc_id"]).select("qid", "rank", "rel")


def _per_query(qrels: DataFrame, found: DataFrame, value: str) -> DataFrame:
    asked = qrels.select("qid").distinct()
    return asked.join(found, "qid", "left").select("qid", F.coalesce(value, F.lit(0.0)).alias(value))


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("rel > 0").groupBy("qid").agg(F.count("*").alias("n"))


def recall_at(run, qrels, k) -> DataFrame:
    found = _hits(run, qrels, k).groupBy("qid").agg(F.count("*").alias("hits")).join(_relevant(qrels), "qid")
    return _per_query(qrels, found.select("qid", (F.col("hits") / F.col("n")).alias("recall")), "recall")


def ndcg_at(run, qrels, k) -> DataFrame:
    """Linear gains, over the ideal order of the judgements."""
    gain = lambda r: F.sum(F.col("rel") / F.log2(F.col(r) + 1))
    got = _hits(run, qrels, k).groupBy("qid").agg(gain("rank").alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.where("rel > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("qid").agg(gain("place").alias("ideal"))
    return _per_query(qrels, got.join(ideal, "qid").select("qid", (F.col("dcg") / F.col("ideal")).alias("ndcg")), "ndcg")


def map_at(run, qrels, k) -> DataFrame:
    so_far = F.count("*").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    found = _hits(run, qrels, k).withColumn("p", so_far / F.col("rank")).groupBy("qid").agg(F.sum("p").alias("p")).join(_relevant(qrels), "qid")
    return _per_query(qrels, found.select("qid", (F.col("p") / F.col("n")).alias("map")), "map")


def mrr_at(run, qrels, k) -> DataFrame:
    found = _hits(run, qrels, k).groupBy("qid").agg((1 / F.min("rank")).alias("mrr"))
    return _per_query(qrels, found, "mrr")


def evaluate(run: DataFrame, qrels: DataFrame, cuts=(10, 100)) -> DataFrame:
    """One row: ndcg and recall at each cut, map and mrr at the first. Run and judgements meet once."""
    first = cuts[0]
    by_gain = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    judged = qrels.withColumn("place", F.when(F.col("rel") > 0, F.row_number().over(by_gain)))
    gain = lambda at, k: F.coalesce(F.sum(F.when(F.col(at) <= k, F.col("rel") / F.log2(F.col(at) + 1))), F.lit(0.0))
    ideal = judged.groupBy("qid").agg(F.count("place").alias("n"), *(gain("place", k).alias(f"ideal_{k}") for k in cuts))
    so_far = F.count("*").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = _hits(run, qrels, max(cuts)).withColumn("precision", so_far / F.col("rank"))
    found = hits.groupBy("qid").agg(
        *(gain("rank", k).alias(f"dcg_{k}") for k in cuts),
        *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}") for k in cuts),
        F.sum(F.when(F.col("rank") <= first, F.col("precision"))).alias("map"),
        F.min(F.when(F.col("rank") <= first, F.col("rank"))).alias("best"),
    )
    both = ideal.join(found, "qid", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    each = [x for k in cuts for x in (mean(over(f"dcg_{k}", f"ideal_{k}")).alias(f"ndcg_{k}"), mean(over(f"hits_{k}", "n")).alias(f"recall_{k}"))]
    return both.agg(*each, mean(over("map", "n")).alias(f"map_{first}"), mean(1 / F.col("best")).alias(f"mrr_{first}"))


def ms_per_query(seconds: float, queries: int) -> float:
    return seconds / queries * 1000
