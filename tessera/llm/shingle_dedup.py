"""Near-duplicates by the exact Jaccard similarity of word shingles.

Texts that share a band of ``ROWS`` minima out of ``BANDS`` are candidates: at a similarity of 0.8 a
pair has none in common with a probability of (1 - 0.8 ** 5) ** 36, less than one in a million, and
less above. Every candidate is decided by the two whole sets of shingles, so that no link is below the
limit. The first candidates are all with one leader a key, so that a large group of copies of one text
costs in proportion to its rows. Keys whose rows are in different groups after that form clusters, and
a cluster's rows are compared with each other inside tasks, two blocks of bounded size at a time: only
links that connect groups come out, never the pairs.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .components import connected_components
from .storage import discard, drop_shuffles, materialize
from .textscan import U, mix, slices, words

BANDS, ROWS = 36, 5
STEP = U(0x9E3779B97F4A7C15)
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 128, 1 << 16, 1 << 13


def shingle_sets(column, shingle: int = 5):
    """(hashes, cuts) of a text column: the sorted distinct shingles of text i are hashes[cuts[i]:cuts[i + 1]].

    Words are split at white space, A-Z lower-cased; fewer than ``shingle`` words are one shingle.
    """
    keys, doc, offsets = words(column)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    ends = np.cumsum(n)[doc]
    at = np.arange(len(keys))
    at = at[(at + shingle <= ends) | (at == ends - n[doc])]
    made = mix(keys[at])
    for j in range(1, shingle):
        more = at + j < ends[at]
        made[more] = mix(made[more] * STEP + keys[at[more] + j])
    order = np.lexsort((made, doc[at]))
    made, of = made[order], doc[at][order]
    first = np.ones(len(made), bool)
    first[1:] = (made[1:] != made[:-1]) | (of[1:] != of[:-1])
    return made[first], np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=len(n)))])


def marks(docs: DataFrame, text_col="text", shingle=5) -> DataFrame:
    """docs and, of the text's set of shingles, node (a key of the whole set), n (size) and keys (bands; none if empty)."""
    at = docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            for part in slices(batch, at):
                h, cuts = shingle_sets(part.column(at), shingle)
                n = np.diff(cuts)
                full = np.flatnonzero(n)
                node, bands = np.zeros(len(n), U), np.zeros((len(full), BANDS), U)
                if len(full):
                    starts = cuts[full]
                    node[full] = mix(np.add.reduceat(mix(h ^ STEP), starts) + n[full].astype(U))
                    for k, factor in enumerate(FACTORS):
                        band = bands[:, k // ROWS]
                        band[:] = mix(band * STEP + np.minimum.reduceat(h * factor, starts) + U(k))
                sizes = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(bands.ravel().view(np.int64)))
                made = [pa.array(node.view(np.int64)), pa.array(n), lists]
                yield pa.record_batch([*part.columns, *made], [*part.schema.names, "node", "n", "keys"])

    schema = StructType(list(docs.schema.fields)).add("node", "long").add("n", "long").add("keys", ArrayType(LongType()))
    return docs.mapInArrow(scan, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                h, cuts = shingle_sets(part.column(1), shingle)
                lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), lists], ["node", "shingles"])

    return texts.mapInArrow(scan, "node long, shingles array<long>")


def _linked_roots(table: pa.Table, least: Fraction) -> pa.Table:
    """(a, b): links that connect the roots of a pair of blocks (or of one) whose sets are similar enough.

    table: node, root, block and shingles. Every pair of rows of the two blocks with different roots is
    compared, by products of incidence matrices; what is returned is a forest over the roots.
    """
    lists = table.column("shingles").combine_chunks()
    root, block = table.column("root").to_numpy(), table.column("block").to_numpy()
    n = lists.value_lengths().to_numpy().astype(np.int64)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    out = []
    if len(np.unique(root)) > 1 and len(table):
        _, column, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(n)), n), count > 1
        number = np.cumsum(shared) - 1
        row, column = row[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(left), len(right)))
        for at in range(0, int(shared.sum()), COLUMNS):
            own = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            held = np.zeros((len(n), COLUMNS), np.float32)
            held[row[own], column[own] - at] = 1
            both += held[left] @ held[right].T
        p, q = least.numerator, least.denominator
        hit = both * (p + q) >= (n[left][:, None] + n[right]) * p
        i, j = np.nonzero(hit & (root[left][:, None] != root[right]))
        up = {}

        def find(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for x, y in np.unique(np.column_stack([root[left[i]], root[right[j]]]), axis=0).tolist():
            x, y = sorted((find(x), find(y)))
            if x != y:
                up[y] = x
                out.append((x, y))
    return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_sets(classes: DataFrame, texts: DataFrame, least=0.8, shingle=5, likely: DataFrame | None = None) -> DataFrame:
    """(node, root): the smallest node that links of at least ``least`` lead to; nodes without a link give no row.

    classes: node, n, keys and row, one row a node, and texts: row and text, both in stored tables.
    likely: pairs (a, b) of nodes that are tried besides, such as the links of fingerprints.
    """
    least = Fraction(str(least))
    p, q = least.numerator, least.denominator
    spark = classes.sparkSession
    met = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = materialize(met.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    met = materialize(met.join(shared, "key"))
    drop_shuffles(spark)
    wanted = met.select("node") if likely is None else met.select("node").union(likely.select("a")).union(likely.select("b"))
    chosen = classes.join(wanted.distinct(), "node", "left_semi").select("node", "row")
    sets = materialize(_sets(texts.select("row", "text").join(chosen.hint("merge"), "row").select("node", "text"), shingle))
    drop_shuffles(spark)

    def similar(pairs):
        sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab"]
        both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
        total = F.size("of_a").cast("long") + F.size("of_b")
        found = pairs.join(sides[0], "a").join(sides[1], "b")
        return materialize(found.where(both * (p + q) >= total * p).select("a", "b"))

    # every node with the one that meets most others under its key: in a group of copies mostly their source
    weight = materialize(met.groupBy("node").agg(F.sum("rows").alias("weight")))
    weighed = materialize(met.join(weight, "node").select("key", "node", "n", "weight"))
    lead = materialize(weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("lead")).select("key", F.col("lead.node").alias("other"), F.col("lead.n").alias("m")))
    fits = (F.col("n") * q >= F.col("m") * p) & (F.col("m") * q >= F.col("n") * p)
    pairs = weighed.join(lead, "key").where((F.col("node") != F.col("other")) & fits)
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    pairs = materialize((pairs if likely is None else pairs.union(likely.select("a", "b"))).distinct())
    links = similar(pairs)
    roots = materialize(connected_components(links))
    drop_shuffles(spark)

    # what still meets other groups under a key: all pairs of each cluster, block by block
    named = materialize(met.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    split = materialize(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("head")).where("low < high").select("key", "head"))
    open_ = materialize(named.join(split, "key").select("node", "n", "root", "head").distinct())
    clusters = connected_components(open_.select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = open_.select("node", "n", "root").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node", "left")
    nodes = materialize(nodes.withColumn("cluster", F.coalesce("cluster", "node")))
    drop_shuffles(spark)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sized = materialize(nodes.groupBy("cluster").agg(blocks))
    nodes = nodes.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = nodes.join(sets, "node").select("node", "root", "block", "shingles", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pair = [F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q")]
    more = dealt.groupBy("cluster", *pair).applyInArrow(lambda t: _linked_roots(t, least), "a long, b long")
    found = materialize(connected_components(materialize(links.union(more))))
    discard(shared, met, sets, weight, weighed, lead, pairs, links, roots, named, split, open_, sized)
    return found
