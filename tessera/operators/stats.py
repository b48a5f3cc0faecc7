"""Statistics of vectors and orders of their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.order_stats import mean_ranks, quantiles
from tessera.sources.stages import cut_lineage


def by_dimension(tokens: DataFrame, *keys: str, vector="vec") -> DataFrame:
    """Long form: keys, dim (from 0) and x. Also the dimension-major layout when partitioned by dim."""
    return tokens.select(*keys, F.posexplode(vector).alias("dim", "x"))


def variances(tokens: DataFrame) -> DataFrame:
    return by_dimension(tokens).groupBy("dim").agg(F.var_pop("x").alias("variance"))


def means(tokens: DataFrame) -> DataFrame:
    return by_dimension(tokens).groupBy("dim").agg(F.avg("x").alias("mean"))


def ranked(importance: DataFrame, value: str, *keys: str, digits=9) -> DataFrame:
    """keys, pos (from 0) and dim, by falling value and rising dim; values are rounded before ranking."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(value, digits)), "dim") if keys else Window.orderBy(F.desc(F.round(value, digits)), "dim")
    return importance.withColumn("pos", F.row_number().over(order) - 1)


def cumulative_variance(tokens: DataFrame, digits=9) -> DataFrame:
    """dim, pos and the share of variance in the dimensions up to it (one row a dimension, so one task will do)."""
    rows = ranked(variances(tokens), "variance", digits=digits)
    so_far = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return rows.select("pos", "dim", "variance", (F.sum("variance").over(so_far) / F.sum("variance").over(everything)).alias("share"))


def variance_at(tokens: DataFrame, budgets: list[int], width: int) -> DataFrame:
    """k and the variance share of the k leading dimensions, k cut at the width."""
    rows = cumulative_variance(tokens).select((F.col("pos") + 1).alias("k"), "share")
    wanted = sorted({min(b, width) for b in budgets})
    return rows.where(F.col("k").isin(wanted))


def query_importance(queries: DataFrame) -> DataFrame:
    """qid, dim and the mean square over the query's tokens."""
    return by_dimension(queries, "qid").groupBy("qid", "dim").agg(F.avg(F.col("x") * F.col("x")).alias("importance"))


def global_importance(queries: DataFrame) -> DataFrame:
    """dim and the sum of squares over all query tokens."""
    return by_dimension(queries).groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("importance"))


def centred_importance(queries: DataFrame, mean: DataFrame) -> DataFrame:
    """qid, dim and the sum over tokens of the squared distance to the corpus mean."""
    gap = F.col("x") - F.col("mean")
    return by_dimension(queries, "qid").join(F.broadcast(mean), "dim").groupBy("qid", "dim").agg(F.sum(gap * gap).alias("importance"))


def as_list(order: DataFrame) -> list[int]:
    """A global order's dimensions (one row a dimension)."""
    return [r.dim for r in order.select("pos", "dim").orderBy("pos").collect()]


def head_sorted(order: DataFrame, head: int) -> DataFrame:
    """The order with its first ``head`` dimensions and the rest each sorted by dimension, per qid."""
    part = (F.col("pos") >= head).cast("int")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(part, "dim")) - 1
    return order.withColumn("pos", place).select("qid", "pos", "dim")


def far_from_mean(vectors: DataFrame, mean: DataFrame, key: str) -> DataFrame:
    """key, pos, dim: a vector's dimensions by falling distance to the mean."""
    gaps = by_dimension(vectors, key).join(F.broadcast(mean), "dim").select(key, "dim", F.abs(F.col("x") - F.col("mean")).alias("gap"))
    return ranked(gaps, "gap", key)


def spearman(left: DataFrame, right: DataFrame, digits=9) -> DataFrame:
    """qid and the rank correlation of two scores over the documents; ties get mean ranks."""

    def ranks(df, name):
        rounded = cut_lineage(df.select("qid", "doc_id", F.round("score", digits).alias("score")))
        return mean_ranks(rounded, "score", "qid").select("qid", "doc_id", F.col("rank").alias(name))

    both = ranks(left, "a").join(ranks(right, "b"), ["qid", "doc_id"])
    return both.groupBy("qid").agg(F.corr("a", "b").alias("rho"))


def quartiles(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, q25 and q75."""
    rows = cut_lineage(rows.select(value))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(quantiles(rows, value, {"q25": 0.25, "q75": 0.75}))  # one row each


def medians(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, median and p95."""
    return quantiles(cut_lineage(rows.select(*keys, value)), value, {"median": 0.5, "p95": 0.95}, *keys)


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_tok"))


def rotate(tokens: DataFrame, axis: list[float]) -> DataFrame:
    """Tokens reflected along an axis: an orthogonal transform in built-in functions."""
    return tokens.withColumn("vec", V.reflect("vec", F.array(*map(F.lit, axis))))


def rotate_matrix(tokens: DataFrame, matrix, vector="vec") -> DataFrame:
    """Tokens times a dense orthogonal matrix (width x width, so of fixed size), by Arrow batches."""
    import numpy as np
    import pyarrow as pa

    shared = tokens.sparkSession.sparkContext.broadcast(np.asarray(matrix, float))
    at = tokens.columns.index(vector)

    def turn(batches):
        m = shared.value
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[0]) @ m
            ends = pa.array(np.arange(0, x.size + 1, m.shape[1]), pa.int32())
            columns = list(b.columns)
            columns[at] = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return tokens.mapInArrow(turn, tokens.schema)


def random_rotation(width: int, seed=123):
    """A random orthogonal matrix."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))
