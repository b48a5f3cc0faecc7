"""Exact top-k inner-product search on a bit-sliced index.

A block of rows keeps, for every dimension, bitmaps of the bits of its quantised value. A query adds
the slices of all dimensions, weighted by its own bits, with carry-save adders over bitmaps; negative
weights add complements. On the bits of the sums the k-th largest is found from the most significant
slice down. What quantising dropped is bounded by the norms of the residuals (Cauchy-Schwarz): rows
within that band of the k-th sum are scored exactly, all others can't be among the k best.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DROP = 2
FULL = ~np.uint64(0)


def _bitmap(bits):
    """Rows of 0/1 as 64-bit words, row 0 in the lowest bit."""
    width = -(-bits.shape[1] // 64) * 64
    wide = np.zeros((bits.shape[0], width), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def add_bitmaps(by_weight: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps (arrays of them by power of two) as slices, least significant first.

    Full adders turn three bitmaps of one weight into a sum of that weight and a carry of the next.
    """
    out, weight = [], 0
    while by_weight:
        here = by_weight.pop(weight, None)
        carries = []
        while here is not None and len(here) > 1:
            third = len(here) // 3
            if third:
                a, b, c = here[:third], here[third : 2 * third], here[2 * third : 3 * third]
                both = a ^ b
                carries.append((a & b) | (both & c))
                here = np.concatenate([both ^ c, here[3 * third :]])
            else:
                carries.append(here[:1] & here[1:2])
                here = here[:1] ^ here[1:2]
        if carries:
            up = by_weight.get(weight + 1)
            by_weight[weight + 1] = np.concatenate(carries + ([up] if up is not None else []))
        out.append(here[0] if here is not None else None)
        weight += 1
    return out


class Index:
    """Bit slices of the rows of an integer matrix."""

    def __init__(self, x: np.ndarray, drop=DROP):
        self.x, self.n, self.drop = x, len(x), drop
        value = x >> drop
        self.low = value.min(0)
        value = value - self.low
        self.bits = int(value.max()).bit_length() if value.size else 0
        residual = x - ((x >> drop) << drop)
        self.middle = ((1 << drop) - 1) / 2
        self.reach = float(np.sqrt(((residual - self.middle) ** 2).sum(1).max())) if self.n else 0.0
        planes = [(value.T >> j & 1).astype(np.uint8) for j in range(self.bits)]
        dims = x.shape[1]
        plain = _bitmap(np.stack(planes, 1).reshape(dims * self.bits, self.n)) if self.bits else np.zeros((0, -(-self.n // 64)), np.uint64)
        self.rows = _bitmap(np.ones((1, self.n), np.uint8))[0]
        self.slices = np.stack([plain, ~plain & self.rows]).reshape(2, dims, self.bits, len(self.rows))

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of sum |q_i| * (value_i, or its complement where q_i < 0) over the rows."""
        size, parts = np.abs(q), {}
        sign = (q < 0).astype(np.int64)
        for bit in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero(size >> bit & 1)
            for j in range(self.bits) if len(dims) else ():
                parts.setdefault(bit + j, []).append(self.slices[sign[dims], dims, j])
        zero = np.zeros_like(self.rows)
        return [zero if s is None else s for s in add_bitmaps({w: np.concatenate(p) for w, p in parts.items()})]

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k with the largest inner product with q; all ties included."""
        slices = self.sums(q)
        sure, tied, floor = np.zeros_like(self.rows), self.rows, 0
        for weight in range(len(slices) - 1, -1, -1):
            both = sure | (tied & slices[weight])
            if int(np.bitwise_count(both).sum()) >= k:
                tied, floor = tied & slices[weight], floor | 1 << weight
            else:
                sure, tied = both, tied & ~slices[weight]
        # two exact scores differ from the sums by at most twice the residuals' reach
        floor -= int(np.ceil(2 * np.sqrt(float((q.astype(float) ** 2).sum())) * self.reach / (1 << self.drop) + 1e-6))
        if floor <= 0:
            return np.arange(self.n)
        above, equal = np.zeros_like(self.rows), self.rows
        for weight in range(len(slices) - 1, -1, -1):
            if floor >> weight & 1:
                equal = equal & slices[weight]
            else:
                above, equal = above | (equal & slices[weight]), equal & ~slices[weight]
        chosen = (above | equal).view(np.uint8)
        return np.flatnonzero(np.unpackbits(chosen, bitorder="little")[: self.n])

    def top(self, q: np.ndarray, k: int, ids: np.ndarray, own: int):
        """(ids, scores) of the k best rows but ``own``, by score and then id, exact."""
        rows = self.candidates(q, min(k + int(np.count_nonzero(ids == own)), self.n))
        rows = rows[ids[rows] != own]
        scores = self.x[rows] @ q
        if len(rows) > k:
            least = np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        order = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows[order]], scores[order]


def _matrix(column):
    """Ragged integer vectors as a matrix, short ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    wide, flat = int(sizes.max(initial=0)), column.flatten().to_numpy()
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    x = np.zeros((len(sizes), wide), np.int64)
    x[np.arange(wide) < sizes[:, None]] = flat
    return x


def _search_block(index, ids, batch, k):
    """A batch of queries (id, v) against a block's index."""
    asked, q = batch.column(0).to_numpy(), _matrix(batch.column(1))
    wide = index.x.shape[1]
    q = np.pad(q, ((0, 0), (0, max(0, wide - q.shape[1]))))[:, :wide].astype(np.int64)  # what the rows lack counts nothing
    if wide and np.abs(q).max(initial=0) * float(np.abs(index.x).max(initial=0)) * wide < 2**31:
        q = q.astype(index.x.dtype)
    found = [index.top(v, k, ids, own) for v, own in zip(q, asked, strict=True)]
    n = [len(f[0]) for f in found]
    return pa.record_batch({"query_id": np.repeat(asked, n), "id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found]).astype(np.int64)})


def topk_inner_product(rows: DataFrame, queries: DataFrame, k=20, id_col="id", vector_col="vector", block_rows=8192, query_group=256) -> DataFrame:
    """query_id, rank, id and score of each query's k best rows (all, if fewer), its own id left out.

    Vectors are arrays of integers; shorter ones count as padded with zeros, null ones and ones with
    null elements are left out. Ties go to the smaller id; rows that repeat an id count as one row each.
    Rows are dealt into even blocks, whatever their ids; a block's rows come first and are indexed once,
    then the queries pass by, ``query_group`` at a time. Each block returns k rows a query. An empty side gives an empty result.
    """
    spark = rows.sparkSession
    usable = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null and not exists(v, e -> e is null)")
    rows, queries = usable(rows), usable(queries)
    blocks = max(1, -(-rows.count() // block_rows))
    parts = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    left = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block"), F.lit(False).alias("query"), "id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = left.unionByName(queries.select(every.alias("block"), F.lit(True).alias("query"), "id", "v"))
    dealt = dealt.repartitionById(parts, (F.col("block") % parts).cast("int")).sortWithinPartitions("block", "query", "id")

    def search(batches):
        block, held, index, ids = None, [], None, None
        for batch in batches:
            cell, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a).select(["id", "v"])
                if cell[a] != block:
                    block, held, index = cell[a], [], None
                if not query[a]:
                    held.append(part)
                    continue
                if index is None and held:
                    table = pa.Table.from_batches(held)
                    ids, x = table["id"].to_numpy(), _matrix(table["v"])
                    top = float(np.abs(x).max(initial=0))
                    index = Index(x.astype(np.int32) if top * top * max(1, x.shape[1]) < 2**31 else x)
                if index is not None and index.x.shape[1]:
                    for at in range(0, part.num_rows, query_group):
                        yield _search_block(index, ids, part.slice(at, query_group), k)

    some = dealt.mapInArrow(search, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
