"""Placement of documents by a hierarchical weighted hash tree.

The tree has regions, racks and shards; an inner node weighs as much as its leaves. At each level a
row draws -ln(u) / weight for every child, u hashed from its id and the child's name, and descends
to the lowest draw. A child's draw depends on its own weight alone, so when a weight changes rows
move only in and out of the subtrees whose weights change, and a new region takes rows only into itself.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, a rack or, with a shard number and no children, a shard. Names are unique in a tree."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, racks=2, per_rack=2) -> Node:
    """The tree of ``shards`` equal shards: full regions of racks * per_rack shards, then one region a shard.

    Trees of n and n + 1 shards differ, within a full region's worth, by one region of one shard.
    """
    regions, size = [], racks * per_rack
    for r in range(shards // size):
        made = [Node(f"rack{r}.{k}", tuple(Node(f"shard{s}", shard=s) for s in range(r * size + k * per_rack, r * size + (k + 1) * per_rack))) for k in range(racks)]
        regions.append(Node(f"region{r}", tuple(made)))
    for s in range(shards // size * size, shards):
        regions.append(Node(f"region-of-{s}", (Node(f"rack-of-{s}", (Node(f"shard{s}", shard=s),)),)))
    return Node("root", tuple(regions))


def grow(root: Node, shard: int, weight=1.0) -> Node:
    """The tree with one more shard, in a region of its own, which therefore takes rows only into itself."""
    leaf = Node(f"shard{shard}", shard=shard, own_weight=weight)
    return Node(root.name, (*root.children, Node(f"region-of-{shard}", (Node(f"rack-of-{shard}", (leaf,)),))), own_weight=root.own_weight)


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / float(node.weight)


def place(key: Column, root: Node) -> Column:
    """The shard that a key descends to; nodes without weight get nothing, ties go to the earlier child."""
    if root.shard is not None:
        return F.lit(root.shard)
    live = [(i, c) for i, c in enumerate(root.children) if c.weight > 0]
    if not live:
        raise ValueError(f"{root.name} has no weight")
    if len(live) == 1:
        return place(key, live[0][1])
    low = F.least(*(F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in live))
    # bind the draw once: an inner let by transform over a one-element array
    return F.element_at(F.transform(F.array(low["i"]), lambda child: _choose(key, live, child)), 1)


def _choose(key, live, child):
    out = F.when(child == live[0][0], place(key, live[0][1]))
    for i, c in live[1:]:
        out = out.when(child == i, place(key, c))
    return out


def shard_documents(docs: DataFrame, shards=16, id_col="doc_id", text_col="text", parts=4096) -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot and grown_shard (with one more shard).

    The law is ``key``: id and number of shards decide. size is the text's UTF-8 bytes (null: none)
    plus one; a null text has the empty text's checksum. Slots run gapless from 0 in each shard, by
    ``parts`` hash parts (of id, size and checksum) and then these, so no shard is ordered in one task. Rows with
    equal ids, null ids too, go to one shard and get slots of their own. An empty table gives an
    empty result; other columns are ignored.
    """
    root = tree(shards)
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        key,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, root).alias("shard"),
        place(key, grow(root, shards)).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.crc32(text), F.octet_length(text), F.lit("slot")), F.lit(parts)).cast("int").alias("part"),
    )
    counts = rows.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))  # at most shards * parts rows
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "size", "text_crc32")) - 1
    slotted = rows.withColumn("within", within).join(F.broadcast(starts), ["shard", "part"])
    return slotted.select(id_col, "size", "text_crc32", "law", "shard", (F.col("start") + F.col("within")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards=16, id_col="doc_id") -> None:
    """Write docs to one folder ``shard=<n>`` a shard; a row's shard is that of shard_documents().

    Rows without an id or a text, and repeated ones, are written like any other, whole; a column of docs
    that is itself called shard is written as ``shard_of_row``. An empty table writes no folder.
    """
    docs = docs.withColumnRenamed("shard", "shard_of_row")
    docs.withColumn("shard", place(F.col(id_col), tree(shards))).write.partitionBy("shard").parquet(path)
