"""Documents stored by slices of dimensions, so that a scan of some dimensions reads their columns only.

A stored row is a document: for each slice its tokens' values there, and for each slice but the last the norms
of what lies behind it; besides the largest norm of a token (``reach``) and the number of tokens. Rows are dealt
and sorted by reach, so that Parquet's statistics leave out row groups whose documents can't reach a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.scoring import CELLS, QUERY_BYTES, query_groups, pack_documents, rerank_blocks, rounded, threshold, topk
from tessera.sources.stages import cut_lineage, new_folder, scope

#: Upper bounds may be off by rounding.
SLACK = 1e-6


@dataclass
class Slices:
    """A stored table and the numbers of dimensions up to the end of each slice."""

    spark: SparkSession
    path: str
    marks: list[int]

    @property
    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def names(self, dims: int) -> list[str]:
        """Columns of the slices that make up the first ``dims`` dimensions."""
        if dims not in self.marks:
            raise ValueError(f"{dims} is not the end of a slice: {self.marks}")
        return [f"to_{m}" for m in self.marks if m <= dims]


def store_slices(docs: DataFrame, marks: list[int], path: str | None = None) -> Slices:
    """Write docs (doc_id, tok, vec) by slices that end at ``marks``, the last of which is the width."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "slices")

    def cut(batches):
        for b in batches:
            toks = b.column(1)
            sizes = toks.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = toks.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, marks[-1])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = lambda x, each=1: pa.ListArray.from_arrays(pa.array((ends * each).astype(np.int32)), pa.array(x.ravel()))  # noqa: B023, E731
            norms = np.linalg.norm(flat, axis=1)
            reach = np.array([norms[a:z].max(initial=0) for a, z in zip(ends, ends[1:], strict=False)])
            made = {"doc_id": b.column(0), "n_tok": sizes.astype(np.int32), "reach": reach}
            for low, high in zip([0, *marks], marks, strict=False):
                made[f"to_{high}"] = lists(flat[:, low:high], high - low)
                if high < marks[-1]:
                    made[f"tail_{high}"] = lists(np.linalg.norm(flat[:, high:], axis=1))
            yield pa.record_batch(made)

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"to_{m} array<double>" + (f", tail_{m} array<double>" if m < marks[-1] else "") for m in marks)
    sliced = pack_documents(docs).select("doc_id", "toks").mapInArrow(cut, f"doc_id {kind}, n_tok int, reach double, {columns}")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scope(spark):
        dealt = cut_lineage(sliced).repartitionByRange(tasks, "reach", "doc_id").sortWithinPartitions("reach", "doc_id")
        dealt.write.option("parquet.block.size", 8 << 20).parquet(path)
    return Slices(spark, path, list(marks))


def _matrices(batch, columns, widths):
    """The batch's token rows of the named slices side by side."""
    return np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, w) for c, w in zip(columns, widths, strict=True)], axis=1)


def _sums(slices: Slices, queries: DataFrame, dims: int, bound: bool, limit: int, k: int | None = None) -> DataFrame:
    """qid, doc_id, score by the first ``dims`` dimensions; with ``bound`` plus the products of tail norms."""
    spark, out, names = slices.spark, None, slices.names(dims)
    widths = np.diff([0, *[m for m in slices.marks if m <= dims]]).tolist()
    bound = bound and dims < slices.marks[-1]
    table = slices.table.select("doc_id", "n_tok", *names, *([f"tail_{dims}"] if bound else []))
    for group in query_groups(queries, limit):
        rows = group.select("qid", "qtok", V.doubles("vec").alias("vec")).orderBy("qid", "qtok").collect()
        if not rows:
            continue
        ids = np.array([r.qid for r in rows])
        starts = np.flatnonzero(np.append([True], ids[1:] != ids[:-1]))
        matrix = np.array([r.vec for r in rows])
        if bound:  # the tails' norms as one more dimension
            matrix = np.concatenate([matrix[:, :dims], np.linalg.norm(matrix[:, dims:], axis=1)[:, None]], axis=1)
        shared = spark.sparkContext.broadcast((matrix if bound else matrix[:, :dims], ids[starts], starts))

        def score(batches, shared=shared):
            matrix, qids, starts = shared.value
            for b in batches:
                sizes = b.column("n_tok").to_numpy()
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                flat = _matrices(b, names, widths)
                if bound:
                    flat = np.concatenate([flat, b.column(f"tail_{dims}").flatten().to_numpy(zero_copy_only=False)[:, None]], axis=1)
                own, sizes, at, parts = b.column("doc_id").to_numpy()[some], sizes[some], 0, []
                ends = np.cumsum(sizes)
                while at < len(own):
                    done = ends[at - 1] if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, done + CELLS // len(matrix), "right")))
                    best = np.maximum.reduceat(matrix @ flat[done : ends[stop - 1]].T, (ends - sizes)[at:stop] - done, axis=1)
                    parts.append(np.add.reduceat(best, starts, axis=0))
                    at = stop
                scores = np.concatenate(parts, axis=1)
                if k is not None and k < len(own):
                    keep = np.array([np.lexsort((own, -np.round(row, 6)))[:k] for row in scores])
                    yield pa.record_batch({"qid": np.repeat(qids, k), "doc_id": own[keep].ravel(), "score": np.take_along_axis(scores, keep, 1).ravel()})
                else:
                    yield pa.record_batch({"qid": np.repeat(qids, len(own)), "doc_id": np.tile(own, len(qids)), "score": scores.ravel()})

        one = table.mapInArrow(score, "qid long, doc_id long, score double")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "qid long, doc_id long, score double")


def partial_scores(slices: Slices, queries: DataFrame, dims: int, k: int | None = None, limit=QUERY_BYTES) -> DataFrame:
    """qid, doc_id and the score by the first ``dims`` dimensions (with k: each batch's k best a query)."""
    return _sums(slices, queries, dims, False, limit, k)


def upper_bounds(slices: Slices, queries: DataFrame, dims: int, limit=QUERY_BYTES) -> DataFrame:
    """qid, doc_id and ub: what the score can be at most, from the first ``dims`` dimensions and tail norms."""
    return _sums(slices, queries, dims, True, limit).withColumnRenamed("score", "ub")


def whole_documents(slices: Slices) -> DataFrame:
    """doc_id, toks: packed documents, as block scoring reads them."""
    names = slices.names(slices.marks[-1])
    widths = np.diff([0, *slices.marks]).tolist()

    def pack(batches):
        for b in batches:
            flat = _matrices(b, names, widths)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
            ends = np.concatenate([[0], np.cumsum(b.column("n_tok").to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), vectors)], ["doc_id", "toks"])

    return slices.table.select("doc_id", "n_tok", *names).mapInArrow(pack, "doc_id long, toks array<array<double>>")


def pruned_topk(slices: Slices, queries: DataFrame, k: int, dims: int, limit=QUERY_BYTES) -> DataFrame:
    """qid, rank, doc_id, score of the exact k best; whole documents are scored only where a bound asks for it.

    The k best by the first ``dims`` dimensions are scored in full; the k-th of them is the query's threshold.
    Documents whose norms can't reach any threshold aren't scanned; of the others, those whose upper bound
    does are scored in full for the queries that want them.
    """
    whole, asked = whole_documents(slices), cut_lineage(queries.select("qid", "qtok", "vec"))
    likely = cut_lineage(topk(rounded(partial_scores(slices, asked, dims, k, limit)), k).select("qid", "doc_id"))
    tau = cut_lineage(threshold(rounded(rerank_blocks(whole, asked, likely, limit)), k))
    norms = asked.groupBy("qid").agg(F.sum(V.norm(V.doubles("vec"))).alias("norm"))
    least = norms.join(tau, "qid", "left").agg(F.min(F.when(F.col("norm") > 0, (F.coalesce("tau", F.lit(float("-inf"))) - SLACK) / F.col("norm")).otherwise(F.lit(float("-inf"))))).first()[0]
    reaching = Reaching(slices.spark, slices.path, slices.marks, least if least is not None else float("-inf"))
    bounds = upper_bounds(reaching, asked, dims, limit).join(tau, "qid", "left")
    wanted = cut_lineage(bounds.where("tau is null or ub >= tau - 1e-6").select("qid", "doc_id"))
    return topk(rounded(rerank_blocks(whole, asked, wanted, limit)), k)


@dataclass
class Reaching(Slices):
    """Only the documents with a token of norm ``least`` or more."""

    least: float = float("-inf")

    @property
    def table(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.where(F.col("reach") >= self.least) if np.isfinite(self.least) else rows
