"""SimHash near-duplicates of documents, with pigeonring-filtered linking.

A fingerprint holds, bit by bit, the majority over the XXH64 values of a text's word shingles.
Two fingerprints link within ``radius`` differing bits. Cut into ``radius + 1`` segments on a
ring, two linked fingerprints have a segment from which every chain of l consecutive segments
differs in at most l * radius / (radius + 1) bits: the first segment not at all, the first two in
at most one bit. Rows therefore meet under the first segment and either half of the second, longer
chains are held to their budgets, and only what is left gets the full Hamming check.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize
from .textscan import mix, slices

SEED = 42
#: Rows of a key above which it is split; rows that a task compares at a time.
OFTEN, HELD = 4096, 1 << 18


def text_fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> tuple[int, ...]:
    """Unsigned 64-bit words of majority bits over the shingles' hashes, zeros without words.

    The first word takes the hashes themselves, the others scramblings of them.
    """
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space
    if not tokens:
        return (0,) * words
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - k + 1)
    out = []
    for w in range(words):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)]
            part = (mix(part + np.uint64(w)) if w else part).astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]))
    return tuple(out)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle=4, words=1) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as signed longs; null text is empty."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = np.array([text_fingerprint(t, shingle, words) for t in part.column(1).to_pylist()], np.uint64)
                flat = pa.array(found.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, words), pa.int32()), flat)
                yield pa.record_batch({"id": part.column(0), "fp": lists})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"id {kind}, fp array<long>")


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the radius + 1 segments of 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_keys(radius: int) -> list[tuple[int, int]]:
    """(first segment, mask): the keys under which rows meet, segment i and half of segment i + 1."""
    parts = segments(radius)
    if radius == 0:
        return [(0, (1 << 64) - 1)]
    keys = []
    for i, (shift, width) in enumerate(parts):
        low, wide = parts[(i + 1) % len(parts)]
        for at, n in ((low, wide // 2), (low + wide // 2, wide - wide // 2)):
            keys.append((i, ((1 << width) - 1) << shift | ((1 << n) - 1) << at))
    return keys


def within(a, b, first, radius):
    """Where uint64 arrays a and b link, tried along the chains from segment ``first``."""
    parts = segments(radius)
    masks = np.array([((1 << w) - 1) << s for s, w in parts], np.uint64)
    differ, live = a ^ b, np.arange(len(a))
    total = np.zeros(len(a), np.int64)
    for length in range(1, len(parts) + 1):
        total = total + np.bitwise_count(differ[live] & masks[(first[live] + length - 1) % len(parts)])
        keep = total * len(parts) <= length * radius
        live, total = live[keep], total[keep]
    return live


def _find(parent, x):
    while not np.array_equal(up := parent[x], x):
        x = up
    return x


def split_keys(rows: DataFrame, keys: list[tuple[int, int]], often: int) -> DataFrame:
    """rows with ``sub``: null, or where over ``often`` rows share a key, one row for each part of the key's other bits.

    Linked rows of a key differ in at most ``radius`` of these bits, so they agree on one of radius + 1 parts.
    """
    radius = len(keys) // 2 - 1
    counts = materialize(rows.groupBy("k", "bits").count().where(F.col("count") > often).select("k", "bits", F.lit(True).alias("often")))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    parts = []
    for k in range(len(keys)):
        rest = [b for b in range(64) if not keys[k][1] >> b & 1]
        cut = [rest[len(rest) * i // (radius + 1) : len(rest) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
        parts.append([signed(sum(1 << b for b in c)) for c in cut])
    own = F.get(F.array(*(F.array(*map(F.lit, p)) for p in parts)), F.col("k") % len(keys))
    word = F.get(F.array(*(c for c in rows.columns if c.startswith("w"))), F.floor(F.col("k") / len(keys)).cast("int"))
    subs = F.transform(own, lambda m, i: F.struct(i.alias("part"), m.bitwiseAND(word).alias("bits")))
    none = F.array(F.lit(None).cast("struct<part:int,bits:bigint>"))
    joined = rows.join(counts, ["k", "bits"], "left")
    return joined.select(*rows.columns, F.explode(F.when(F.col("often"), subs).otherwise(none)).alias("sub"))


def linked_pairs(keys, first, word, node, radius, whole=None, total=None):
    """Pairs of nodes that connect what links within equal keys; a spanning set, not all pairs.

    word: the 64 bits that the key is of; whole: all words of each row, with ``total`` as their limit.
    Exact: every pair of rows with equal keys is compared, in vectors, but a pair inside a component
    that is already connected isn't returned. Time is quadratic in the distinct fingerprints under
    one key, which split_keys() keeps few; memory and output are linear.
    """
    order = np.lexsort((node, keys))
    keys, first, word, node = keys[order], first[order], word[order], node[order]
    whole = whole[order] if whole is not None else None
    values, place = np.unique(node, return_inverse=True)
    parent = np.arange(len(values))
    out_a, out_b = [], []
    live, d = np.arange(len(keys)), 1
    while len(live):
        live = live[live + d < len(keys)]
        live = live[keys[live + d] == keys[live]]
        for at in range(0, len(live), 1 << 20):
            i = live[at : at + (1 << 20)]
            hit = i[within(word[i], word[i + d], first[i], radius)]
            if whole is not None:
                hit = hit[np.bitwise_count(whole[hit] ^ whole[hit + d]).sum(1, dtype=np.int64) <= total]
            a, b = _find(parent, place[hit]), _find(parent, place[hit + d])
            new = a != b
            out_a.append(values[place[hit[new]]])
            out_b.append(values[place[hit[new] + d]])
            a, b = a[new], b[new]
            while len(a):
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                a, b = _find(parent, a), _find(parent, b)
                a, b = a[a != b], b[a != b]
        d += 1
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_a), join(out_b)


def fingerprint_edges(fps: DataFrame, radius=4, words=1, total=None) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (node, fp) of which some word lies within radius."""
    keys = chain_keys(radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    word = lambda w: F.get("fp", F.lit(w))
    made = [F.struct(F.lit(w * len(keys) + k).alias("k"), word(w).bitwiseAND(F.lit(signed(m))).alias("bits")) for w in range(words) for k, (_, m) in enumerate(keys)]
    every = [f"w{w}" for w in range(words)]
    rows = fps.select("node", *(word(w).alias(every[w]) for w in range(words)), F.explode(F.array(*made)).alias("key")).select("node", *every, "key.k", "key.bits")

    def link_rows(held):
        table = pa.Table.from_batches(held)
        node, k, bits, part, rest = (table.column(c).to_numpy() for c in ("node", "k", "bits", "part", "rest"))
        whole = np.stack([table.column(c).to_numpy() for c in every], 1).view(np.uint64)
        change = np.zeros(len(k), bool)
        for c in (k, bits, part, rest):
            change[1:] |= c[1:] != c[:-1]
        first = np.array([i for i, _ in keys])[k % len(keys)]
        own = whole[np.arange(len(k)), k // len(keys)]
        a, b = linked_pairs(np.cumsum(change), first, own, node, radius, whole if words > 1 else None, total)
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    def link(batches):
        held, n, last = [], 0, None  # whole groups, at least HELD rows of them at a time
        for batch in batches:
            code = np.column_stack([batch.column(c).to_numpy() for c in ("k", "bits", "part", "rest")])
            if not len(code):
                continue
            if n >= HELD:
                new = np.flatnonzero((code != last).any(1))
                cut = int(new[0]) if len(new) else len(code)
                held.append(batch.slice(0, cut))
                if not len(new):
                    continue
                yield link_rows(held)
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n, last = n + batch.num_rows, code[-1]
        if n:
            yield link_rows(held)

    dealt = split_keys(rows, keys, OFTEN).select("node", "k", "bits", F.coalesce("sub.part", F.lit(-1)).alias("part"), F.coalesce("sub.bits", F.lit(0)).alias("rest"), *every)
    order = ["k", "bits", "part", "rest"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=4, radius=4, words=1, total=None) -> DataFrame:
    """One row per input row: id, fp (signed longs) and component (smallest id reachable by links).

    Null text counts as empty; texts without words share fingerprint zero and link like any other.
    A text of fewer than ``shingle`` words is one shingle. Equal texts, repeated rows and repeated
    ids are kept row by row; rows whose id is null get the component of their group's other ids.
    An empty table gives an empty result, further columns are ignored.
    """
    node = F.get("fp", F.lit(0)) if words == 1 else F.xxhash64("fp")
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, words).withColumn("node", node))
    classes = marked.groupBy("node").agg(F.first("fp").alias("fp"), F.min("id").alias("low"))
    roots = connected_components(fingerprint_edges(classes.select("node", "fp"), radius, words, total))
    grouped = classes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    grouped = materialize(grouped.select("node", "low", F.coalesce("root", "node").alias("root")))
    lows = materialize(grouped.groupBy("root").agg(F.min("low").alias("component")))  # stored, so that a large group's join can be split
    by_node = grouped.join(lows, "root").select("node", "component")
    return marked.join(by_node, "node", "left").select(F.col("id").alias(id_col), "fp", "component")


def similarity_limit(least: float, words: int) -> int:
    """Bits in which fingerprints of ``words`` words differ, on average, at a Jaccard similarity of the shingles."""
    cosine = 2 * least / (1 + least)
    return int(64 * words * np.arccos(cosine) / np.pi)
