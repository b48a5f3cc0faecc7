"""The trie of conversations' prefixes, from polynomial fingerprints that are verified.

Turns are hashed and, sorted by conversation and place, scanned with numpy: a prefix' fingerprint is the
running sum of its turns' values times powers of a base. Equal fingerprints at one depth make a candidate
group. Contents behind equal hashes are compared first, which numbers them; then each member's turn is
compared with that of its group's representative, and members that differ are split off, with all their
later prefixes. As a turn's value follows from its content and the base is odd, groups whose last turns
are all equal come from one group a turn earlier: so equal prefixes, and no others, share a node.

Of all conversations through a node the smallest represents it, and the nodes that a conversation
represents are the last ones of its path. Sums over a subtree are thus sums over a node's conversations
of what each represents, less what its own representative has above the node.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textscan import U, mix

BASE = U(0x9E3779B97F4A7C15)  # odd
BITS = 62  # so that two sums add up without overflow
KEY = ["pos", "fp", "branch"]
#: Ids of one chunk of a node's list of conversations differ in so many bits at most.
CHUNK_BITS = 16


def running(rows: DataFrame, group: str, order: list[str], weigh, bits=BITS) -> DataFrame:
    """rows, each with its ``value`` and the sum of its group's values up to it as ``total``, modulo 2**bits.

    weigh(batch) gives the values as uint64. Rows are dealt by ranges of (group, order), so that a
    group may lie in any number of partitions; each of these passes on one number.
    """
    spark, mask = rows.sparkSession, (1 << bits) - 1

    def scan(batches):
        part, place, last, sofar = TaskContext.get().partitionId(), 0, None, U(0)
        for b in batches:
            if not b.num_rows:
                continue
            g, value = b.column(group).to_numpy(), weigh(b) & U(mask)
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sums = np.cumsum(value, dtype=U)
            sums -= np.repeat(sums[first] - value[first], np.diff(first, append=len(g)))
            if g[0] == last:
                sums[: first[1] if len(first) > 1 else len(g)] += sofar
            last, sofar = g[-1], sums[-1]
            made = [np.full(len(g), part), place + np.arange(len(g)), value.view(np.int64), (sums & U(mask)).view(np.int64)]
            place += len(g)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], [*b.schema.names, "part", "place", "value", "here"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    scanned = materialize(dealt.mapInArrow(scan, f"{columns}, part long, place long, value long, here long"))
    ends = scanned.groupBy("part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by("here", "place").alias("here"))
    carried, before, open_group = [], 0, None
    for r in sorted(ends.collect()):  # a row a partition
        if r["first"] == open_group:
            carried.append((r["part"], r["first"], before))
        before = r["here"] + (before if r["first"] == r["last"] == open_group else 0)
        open_group = r["last"]
    kind = rows.schema[group].dataType.simpleString()
    carried = spark.createDataFrame([(p, g, c & mask) for p, g, c in carried], f"part long, {group} {kind}, carried long")
    out = scanned.join(F.broadcast(carried), ["part", group], "left")
    total = (F.col("here") + F.coalesce("carried", F.lit(0))).bitwiseAND(F.lit(mask))
    return out.withColumn("total", total).drop("part", "place", "here", "carried")


def number_contents(turns: DataFrame) -> DataFrame:
    """(hash, role, text, variant from 1) of the contents that share their hash with a smaller one; usually none."""
    contents = lambda rows: rows.groupBy("hash", "role", "text").agg(F.lit(1).alias("held"))
    shared = materialize(contents(turns).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    number = F.row_number().over(Window.partitionBy("hash").orderBy("role", "text")) - 1
    odd = contents(turns.join(shared, "hash")).withColumn("variant", number.cast("long"))
    return odd.where("variant > 0").select("hash", "role", "text", "variant")


def number_turns(conversations: DataFrame, hash_bits=64) -> DataFrame:
    """One row per turn: id, place i from 1, hash, variant and size (code points)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("id"), "turn", text("role"), text("text"))
    turns = turns.withColumn("hash", F.call_function("shiftright", F.xxhash64("role", "text"), F.lit(64 - hash_bits)))
    odd = materialize(number_contents(turns))
    turns = turns.join(odd, ["hash", "role", "text"], "left")
    turns = turns.select("id", "turn", "hash", F.coalesce("variant", F.lit(0).cast("long")).alias("variant"), F.length("text").cast("long").alias("size"))
    turns = turns.withColumn("row", F.monotonically_increasing_id())  # tells equal turns apart, so that ranges can split them
    ones = lambda b: np.ones(b.num_rows, U)
    return running(turns, "id", ["turn", "hash", "variant", "row"], ones).withColumnRenamed("total", "i").drop("turn", "row", "value")


def rebuild(turns: DataFrame, block=100, heads=6) -> DataFrame:
    """Rows (id, pos, hash, variant, size, turns) of the rebuilt conversations, with a row at pos 0 for each.

    A conversation's first h turns, h being the unsigned CRC-32 of its decimal id modulo ``heads``, give way
    to the first h of the conversation id - id % block (the remainder has the id's sign).
    """
    own = ["hash", "variant", "size"]
    held = turns.groupBy("id").agg(F.max("i").alias("n"))
    held = held.withColumns({"head": F.crc32(F.col("id").cast("string").cast("binary")) % heads, "base": F.col("id") - F.col("id") % block})
    held = held.join(held.select(F.col("id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lent = F.least("head", F.coalesce("base_n", F.lit(0)))
    held = held.withColumn("lent", lent)
    held = materialize(held.select("id", "base", "head", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("turns")))
    rest = turns.join(held, "id").where("i > head").select("id", (F.col("i") - F.col("head") + F.col("lent")).alias("pos"), *own, "turns")
    first = turns.where(F.col("i") < heads).withColumnRenamed("id", "base").join(held, "base").where("i <= lent")
    first = first.select("id", F.col("i").alias("pos"), *own, "turns")
    none = F.lit(0).cast("long")
    root = held.select("id", none.alias("pos"), *(none.alias(c) for c in own), "turns")
    return rest.unionByName(first).unionByName(root)


def fingerprint_prefixes(turns: DataFrame, bits=BITS) -> DataFrame:
    """turns with the fingerprint fp of each prefix and up, that of the prefix before it."""

    def weigh(b):
        pos, key, variant = (b.column(c).to_numpy().view(U) for c in ("pos", "hash", "variant"))
        return np.where(pos > 0, mix(key ^ mix(variant)) * np.power(BASE, pos), U(0))

    out = running(turns, "id", ["pos"], weigh, bits).withColumnRenamed("total", "fp")
    return out.withColumn("up", (F.col("fp") - F.col("value")).bitwiseAND(F.lit((1 << bits) - 1))).drop("value")


def split_collisions(prefixes: DataFrame) -> DataFrame:
    """prefixes with the column branch, and up_branch for the prefix before: what sets colliding groups apart.

    A group's members are compared with the turn of its representative, the smallest id; a branch lists the
    places where a conversation differed from it, and the number of its content there. Mostly it is empty.
    """
    content = ["hash", "variant"]
    members = prefixes.groupBy("pos", "fp", *content).agg(F.min("id").alias("first"))
    leading = members.groupBy("pos", "fp").agg(F.count("*").alias("n"), F.min(F.struct("first", *content)).alias("leads")).where("n > 1")
    odd = members.join(leading, ["pos", "fp"]).where(F.struct(*content) != F.struct(*(F.col(f"leads.{c}") for c in content)))
    odd = materialize(odd.select("pos", "fp", *content, F.concat_ws(":", "pos", *content).alias("mark")))
    marks = prefixes.join(odd, ["pos", "fp", *content]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "mark"))).alias("marks"))
    marked = prefixes.join(materialize(marks), "id", "left")
    upto = lambda place: F.coalesce(F.array_join(F.transform(F.filter("marks", lambda m: m["pos"] <= place), lambda m: m["mark"]), ","), F.lit(""))
    return marked.withColumns({"branch": upto(F.col("pos")), "up_branch": upto(F.col("pos") - 1)}).drop("marks")


def list_digests(ends: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of each node's ids (distinct), ascending and comma-joined.

    Ids are joined by chunks of at most 2**16 anywhere; the chunks of a node then pass through its hash one
    after the other, which is sequential by nature but keeps nothing.
    """
    chunk = F.call_function("shiftright", F.col("id"), F.lit(CHUNK_BITS)).alias("chunk")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*KEY, chunk).agg(joined.alias("ids"))

    def digest(batches):
        key = state = None
        for b in batches:
            out = []
            for *own, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if own != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield batch(out)
        if key:
            yield batch([(*key, state.hexdigest())])

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [*KEY, "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, *KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(digest, "pos long, fp long, branch string, ends_sha256 string")


def build_trie(turns: DataFrame, bits=BITS) -> DataFrame:
    """One row per node of the trie of rebuilt turns (see rebuild()), as conversation_trie() returns them."""
    prefixes = fingerprint_prefixes(turns, bits)
    keyed = split_collisions(prefixes)
    nodes = keyed.groupBy(*KEY).agg(F.min("id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("size", "up", "up_branch")))
    nodes = materialize(nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("size")))
    above = [(F.col("pos") - 1).alias("pos"), F.col("up").alias("fp"), F.col("up_branch").alias("branch")]
    children = nodes.where("pos > 0").select(*above).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, KEY, "left").fillna(0, ["n_children"]))
    own = known.groupBy(F.col("conv_id").alias("id")).agg(F.sum("saves").alias("saves"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    below = keyed.join(own, "id", "left").groupBy(*KEY).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in ("saves", "leaf")))
    chain = running(known.select("conv_id", "pos", "saves"), "conv_id", ["pos"], lambda b: b.column("saves").to_numpy().view(U))
    ahead = chain.select("conv_id", "pos", (F.col("total") - F.col("saves")).alias("ahead"))
    parents = nodes.select((F.col("pos") + 1).alias("pos"), F.col("fp").alias("up"), F.col("branch").alias("up_branch"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(below, KEY).join(list_digests(keyed.where("pos = turns").select(*KEY, "id")), KEY, "left")
    out = out.join(ahead, ["conv_id", "pos"]).join(parents, ["pos", "up", "up_branch"], "left")
    out = out.select(
        "conv_id",
        F.col("pos").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("sum_leaf").alias("n_leaves"),
        (F.col("sum_saves") - F.col("ahead")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = materialize(out)
    discard(prefixes, keyed, nodes, known, chain)
    return out


def conversation_trie(conversations: DataFrame, block=100, heads=6, bits=BITS, hash_bits=64) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    Columns: conv_id (its smallest conversation), depth, parent_conv_id (the root's is null), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Conversations are ordered by turn, null first, and
    equal turns by the hash of their content; repeated rows are turns of their own. Null roles and
    texts are empty ones. Rows without a conversation's id belong to none and are left out; long texts are
    read whole, an empty table has no nodes, and other columns are ignored. Ids are whole numbers.

    bits and hash_bits: of the fingerprints and of the turns' hashes; any widths give the same rows.
    """
    numbered = number_turns(conversations, hash_bits)
    turns = rebuild(numbered, block, heads)
    out = build_trie(turns, bits)
    discard(turns)
    return out
