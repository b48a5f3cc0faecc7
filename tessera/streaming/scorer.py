"""Micro-batch search: queries arrive as a stream and are scored against a packed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import scoring


def score_stream(queries: DataFrame, packed: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's top k to path/batch=<n>; a batch that is run again replaces its own folder.

    queries: a stream of qid, qtok, vec in which a query's tokens arrive in one batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        found = scoring.topk(scoring.rounded(scoring.maxsim_blocks(packed, rows, k=k)), k)
        found.withColumn("n", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
