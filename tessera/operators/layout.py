"""Layouts of vectors: blocks with each dimension contiguous, per document and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def _columns(long: DataFrame, keys: list[str], order: str, digits=6) -> DataFrame:
    """keys, dim and that dimension's values in order."""
    cells = F.sort_array(F.collect_list(F.struct(order, V.signed_round("x", digits).alias("x"))))
    return long.groupBy(*keys, "dim").agg(F.transform(cells, lambda c: c["x"]).alias("column"))


def blocked(vectors: DataFrame, block: int, id_col="vec_id", vector="vec") -> DataFrame:
    """block_id, dim, column: blocks of ``block`` consecutive ids, dimension by dimension. A short last block is kept."""
    long = vectors.select(F.expr(f"{id_col} div {block}").alias("block_id"), F.col(id_col).alias("at"), F.posexplode(vector).alias("dim", "x"))
    return _columns(long, ["block_id"], "at")


def per_document(docs: DataFrame) -> DataFrame:
    """doc_id, dim, column: a document's tokens, dimension by dimension."""
    return _columns(docs.select("doc_id", "tok", F.posexplode("vec").alias("dim", "x")), ["doc_id"], "tok")


def dimension_major(vectors: DataFrame, id_col="vec_id", vector="vec") -> DataFrame:
    """dim, id, x: the long form, for storage partitioned by dimension."""
    return vectors.select(F.col(id_col), F.posexplode(vector).alias("dim", "x"))


def row_major(columns: DataFrame, key="doc_id") -> DataFrame:
    """The token rows of a per-document layout."""
    cells = columns.select(key, "dim", F.posexplode("column").alias("tok", "x"))
    listed = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return cells.groupBy(key, "tok").agg(F.transform(listed, lambda c: c["x"]).alias("vec"))
