"""Late-interaction scores: sum over query tokens of the best inner product with a document token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from tessera.functions import vectors as V
from tessera.sources.stages import cut_lineage

#: Bytes of query vectors that go to every executor at once; more are dealt in groups.
QUERY_BYTES = 64 << 20


def row_bytes(rows: DataFrame):
    """About the bytes that a row takes: fixed-size values and lists of them by their number, all else by its text."""
    fixed = lambda t: not isinstance(t, ArrayType | MapType | StructType | StringType | BinaryType)
    size = F.lit(0).cast("long")
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        if fixed(f.dataType):
            own = F.lit(16)
        elif isinstance(f.dataType, ArrayType) and fixed(f.dataType.elementType):
            own = 16 + 8 * F.size(c).cast("long")
        else:
            own = 16 + F.octet_length(c if isinstance(f.dataType, StringType | BinaryType) else F.to_json(F.struct(c)))
        size = size + F.coalesce(own, F.lit(16))
    return size


def small(side: DataFrame, limit=QUERY_BYTES) -> DataFrame:
    """The side, stored once and measured: with a broadcast hint up to ``limit`` bytes, else for a distributed join."""
    stored = cut_lineage(side)
    size = stored.select(F.sum(row_bytes(stored))).first()[0] or 0
    return F.broadcast(stored) if size <= limit else stored


def token_pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query token beside every document token: qid, qtok, doc_id, tok, q, d.

    Documents are dealt by id before they meet the broadcast queries: grouping the pairs by document
    then needs no exchange, and what moves is the tokens instead of their products.
    """
    q = queries.select("qid", "qtok", V.doubles("vec").alias("q"))
    d = docs.select("doc_id", "tok", V.doubles("vec").alias("d"))
    return d.repartition("doc_id").crossJoin(small(q))


def best_then_sum(pairs: DataFrame, value, name="score") -> DataFrame:
    """qid, doc_id and the sum over query tokens of the largest value over document tokens."""
    best = pairs.groupBy("qid", "doc_id", "qtok").agg(F.max(value).alias("best"))
    return best.groupBy("qid", "doc_id").agg(F.sum("best").alias(name))


def maxsim_native(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score with built-in functions only, from every pair of tokens: the reference form."""
    return best_then_sum(token_pairs(docs, queries), V.dot("q", "d"))


def chosen_dims(tokens: DataFrame, dims: int | None = None, order: list[int] | None = None) -> DataFrame:
    """Tokens with the first ``dims`` dimensions of an order (null: as stored)."""
    if order is not None:
        return tokens.withColumn("vec", V.gather("vec", F.array(*map(F.lit, order[: dims or len(order)]))))
    return tokens if dims is None else tokens.withColumn("vec", V.prefix("vec", dims))


def maxsim(docs: DataFrame, queries: DataFrame, dims: int | None = None, order: list[int] | None = None, k: int | None = None) -> DataFrame:
    """qid, doc_id, score by blocks; on the first ``dims`` dimensions of an order if given (with k: a block's k best).

    Documents and queries without tokens have no rows.
    """
    return scores(chosen_dims(docs, dims, order), chosen_dims(queries, dims, order), k)


def pack_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its token vectors by tok. The form that block scoring scans."""
    rows = F.sort_array(F.collect_list(F.struct("tok", V.doubles("vec").alias("vec"))))
    return docs.groupBy("doc_id").agg(F.transform(rows, lambda r: r["vec"]).alias("toks"))


def query_groups(queries: DataFrame, limit=QUERY_BYTES) -> list[DataFrame]:
    """Queries in groups whose vectors stay under ``limit`` bytes each (or one query)."""
    per = queries.select(F.sum(F.size("vec").cast("long") * 8)).first()[0] or 0
    groups = max(1, -(-2 * per // limit)) if per > limit else 1
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g) if groups > 1 else queries for g in range(groups)]


def maxsim_blocks(packed: DataFrame, queries: DataFrame, limit=QUERY_BYTES, k: int | None = None, by_token=False) -> DataFrame:
    """qid, doc_id, score from packed documents by matrix products, a block of documents at a time.

    The queries' vectors go to the executors as one matrix of at most ``limit`` bytes; a larger query
    set is scored in several such groups. With ``k``, every block returns its k best rows a query. ``by_token``: a
    block meets one query token after another (all queries' first ones, then the second) and adds up their best.
    """
    spark = packed.sparkSession
    out = None
    for group in query_groups(queries, limit):
        rows = group.select("qid", "qtok", V.doubles("vec").alias("vec")).orderBy("qid", "qtok").collect()
        if not rows:
            continue
        ids = np.array([r.qid for r in rows])
        starts = np.flatnonzero(np.append([True], ids[1:] != ids[:-1]))
        matrix, same = np.array([r.vec for r in rows]), None
        if not by_token:
            distinct, places = np.unique(matrix, axis=0, return_inverse=True)
            if len(distinct) < len(matrix):  # a vector that several tokens have is multiplied once
                matrix, same = distinct, places.ravel()
        shared = spark.sparkContext.broadcast((matrix, ids[starts], starts, same))
        turns = None
        if by_token:
            toks, at = np.array([r.qtok for r in rows]), np.cumsum(np.append([True], ids[1:] != ids[:-1])) - 1
            turns = spark.sparkContext.broadcast([(at[own], own) for own in (np.flatnonzero(toks == t) for t in np.unique(toks))])
        one = packed.select("doc_id", "toks").mapInArrow(_scorer(shared, k, turns), "qid long, doc_id long, score double")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "qid long, doc_id long, score double")


#: Products computed at once (documents' tokens x query tokens), few enough for their memory to be used again.
CELLS = 1 << 20


def _scorer(shared, k, turns=None):
    def products(matrix, starts, same, tokens, cuts):
        if turns is None:
            best = np.maximum.reduceat(matrix @ tokens.T, cuts, axis=1)
            best = best if same is None else best[same]
            return np.add.reduceat(best, starts, axis=0)
        out = np.zeros((len(starts), len(cuts)))
        for at, own in turns.value:  # a query's rows follow each other
            best = np.maximum.reduceat(matrix[own] @ tokens.T, cuts, axis=1)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[first]] += np.maximum.reduceat(best, first, axis=0)
        return out

    def score(batches):
        matrix, qids, starts, same = shared.value
        for batch in batches:
            doc_ids, toks = batch.column(0).to_numpy(), batch.column(1)
            sizes = toks.value_lengths().fill_null(0).to_numpy()
            some = np.flatnonzero(sizes)  # a document without tokens is never ranked
            if not len(some):
                continue
            flat = toks.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
            ends, parts, at = np.cumsum(sizes[some]), [], 0
            while at < len(some):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + CELLS // len(matrix), "right")))
                cuts = (ends - sizes[some])[at:stop] - done
                parts.append(products(matrix, starts, same, flat[done : ends[stop - 1]], cuts))
                at = stop
            scores, own = np.concatenate(parts, axis=1), doc_ids[some]
            if k is not None and k < len(own):
                # by score, then id: ties at the edge must go to the smaller id
                keep = np.array([np.lexsort((own, -np.round(row, 6)))[:k] for row in scores])
                yield pa.record_batch({"qid": np.repeat(qids, k), "doc_id": own[keep].ravel(), "score": np.take_along_axis(scores, keep, 1).ravel()})
            else:
                yield pa.record_batch({"qid": np.repeat(qids, len(own)), "doc_id": np.tile(own, len(qids)), "score": scores.ravel()})

    return score


def scores(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """qid, doc_id, score by blocks: the form to use unless a query must stay with built-in functions."""
    return maxsim_blocks(pack_documents(docs), queries, k=k)


def maxsim_by_token(docs: DataFrame, queries: DataFrame, tokens: int) -> DataFrame:
    """The same scores by the first ``tokens`` query tokens, one after another: each one's best products, summed."""
    return maxsim_blocks(pack_documents(docs), queries.where(F.col("qtok") < tokens), by_token=True)


def rounded(scores: DataFrame, name="score", digits=6) -> DataFrame:
    """Scores rounded, so that order doesn't hang on the order of additions."""
    return scores.withColumn(name, F.round(name, digits))


def topk(scores: DataFrame, k: int, by="qid", item="doc_id", value="score", largest=True) -> DataFrame:
    """by, rank, item, value of the k best per group; ties go to the smaller item, fewer rows if there are fewer."""
    order = Window.partitionBy(by).orderBy(F.desc(value) if largest else F.asc(value), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", item, value)


def threshold(scores: DataFrame, k: int, value="score") -> DataFrame:
    """qid and the k-th largest value; no row for a query with fewer documents."""
    return topk(scores, k, value=value).where(F.col("rank") == k).select("qid", F.col(value).alias("tau"))


def rerank(docs: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact scores of given (qid, doc_id) candidates, ranked by score and then id."""
    pairs = candidates.select("qid", "doc_id").distinct()
    q = queries.select("qid", "qtok", V.doubles("vec").alias("q"))
    d = docs.select("doc_id", "tok", V.doubles("vec").alias("d"))
    scores = rounded(best_then_sum(pairs.join(q, "qid").join(d, "doc_id"), V.dot("q", "d")))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def rerank_blocks(packed: DataFrame, queries: DataFrame, candidates: DataFrame, limit=QUERY_BYTES) -> DataFrame:
    """qid, doc_id and the exact score of given (qid, doc_id) candidates, by matrix products on packed documents.

    Each document meets its own candidates' queries only; queries go out as matrices of at most ``limit`` bytes.
    """
    spark, out = packed.sparkSession, None
    for group in query_groups(queries, limit):
        rows = group.select("qid", "qtok", V.doubles("vec").alias("vec")).orderBy("qid", "qtok").collect()
        if not rows:
            continue
        ids = np.array([r.qid for r in rows])
        starts = np.flatnonzero(np.append([True], ids[1:] != ids[:-1]))
        shared = spark.sparkContext.broadcast((np.array([r.vec for r in rows]), ids[starts], np.append(starts, len(ids))))

        def score(batches, shared=shared):
            matrix, qids, ends = shared.value
            for batch in batches:
                found = []
                for doc, toks, asking in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    vectors = toks.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
                    asking = asking.values.to_numpy()
                    at = np.searchsorted(qids, asking)
                    mine = (at < len(qids)) & (qids[np.minimum(at, len(qids) - 1)] == asking)
                    at = at[mine]
                    if not len(at) or not len(vectors):
                        continue
                    sizes = ends[at + 1] - ends[at]
                    cuts = np.cumsum(sizes) - sizes
                    tokens = np.arange(sizes.sum()) + np.repeat(ends[at] - cuts, sizes)
                    best = np.concatenate([(matrix[some] @ vectors.T).max(1) for some in np.array_split(tokens, -(-len(tokens) * len(vectors) // CELLS))])
                    found.append((np.full(len(at), doc), qids[at], np.add.reduceat(best, cuts)))
                if found:
                    doc, qid, total = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.record_batch({"qid": qid, "doc_id": doc, "score": total})

        asked = candidates.join(group.select("qid").distinct(), "qid").groupBy("doc_id").agg(F.collect_set("qid").alias("qids"))  # at most a group's queries
        one = packed.join(asked, "doc_id").select("doc_id", "toks", "qids").mapInArrow(score, "qid long, doc_id long, score double")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "qid long, doc_id long, score double")


def scanned_cells(docs: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """qid and the products a full scan computes: document tokens x query tokens x dimensions."""
    tokens = docs.agg(F.count("*").alias("n"))
    return queries.groupBy("qid").agg(F.count("*").alias("m")).crossJoin(F.broadcast(tokens)).select("qid", (F.col("n") * F.col("m") * width).alias("cells"))
