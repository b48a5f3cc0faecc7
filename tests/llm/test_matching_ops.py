"""Near-duplicates, components, fingerprints and top-k search against brute force."""

import hashlib
import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bitsliced, components, fingerprints, simhash_dedup


def slow_fingerprint(text, k=4):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").replace("\x0b", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " ", "one", "a b c", "a b c d", "A b C d e É é", "x " * 300, "a\tb\nc\x0bd e"])
def test_text_fingerprint(text):
    assert simhash_dedup.text_fingerprint(text) == (slow_fingerprint(text),)


def test_near_duplicates_of_the_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(df).collect()}
    fps = {r.doc_id: slow_fingerprint(r.text) for r in df.collect()}
    want = slow_components(fps, 4)
    assert {i: r.fp[0] % 2**64 for i, r in got.items()} == fps
    assert {i: r.component for i, r in got.items()} == want


def nodes(spark, fps):
    return spark.createDataFrame([(x, [x]) for x in fps], "node long, fp array<long>")


def test_wide_fingerprints_link_similar_texts(spark):
    """Copies with few words changed link, those with many don't; against the definition by all pairs."""
    r = np.random.default_rng(1)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in r.integers(0, 5000, 300)]
        for c, changes in enumerate((0, 0, 1, 3, 6, 60)):
            words = list(base)
            for at in r.choice(300, changes, replace=False):
                words[at] = f"new{r.integers(0, 10**6)}"
            rows.append((10 * g + c, " ".join(words)))
    limit = simhash_dedup.similarity_limit(0.8, 4)
    assert limit == 38
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component for x in simhash_dedup.near_duplicates(df, shingle=5, radius=6, words=4, total=limit).collect()}
    fps = {i: simhash_dedup.text_fingerprint(t, 5, 4) for i, t in rows}
    parent = {i: i for i in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            each = [(x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)]
            if a < b and min(each) <= 6 and sum(each) <= limit:
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    assert got == parent
    assert all(got[10 * g + c] == 10 * g for g in range(12) for c in (1, 2)) and all(got[10 * g + 5] == 10 * g + 5 for g in range(12))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_links_of_planted_fingerprints(spark, radius):
    r = np.random.default_rng(radius)
    centres = r.integers(0, 2**63, 12, dtype=np.int64)
    fps = set()
    for c in centres.tolist():
        for _ in range(12):
            x = c % 2**64
            for b in r.choice(64, r.integers(0, radius + 3), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = simhash_dedup.fingerprint_edges(nodes(spark, signed), radius).collect()
    table = {s % 2**64: s for s in signed}
    want = slow_components({s: u for u, s in table.items()}, radius)
    linked = slow_components_of_edges(signed, [(e.a, e.b) for e in edges])
    assert linked == want
    assert all(((e.a ^ e.b) % 2**64).bit_count() <= radius for e in edges)


def slow_components_of_edges(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_a_large_group_gives_few_links(spark):
    """All pairs of 1,000 fingerprints link; a spanning set of them comes back."""
    rows = [(int(x),) for x in {sum(1 << int(b) for b in c) for c in np.random.default_rng(0).integers(0, 60, (1000, 2))}]
    edges = simhash_dedup.fingerprint_edges(nodes(spark, [r[0] for r in rows]), 4)
    assert len(rows) - 1 <= edges.distinct().count() <= 12 * len(rows)
    assert slow_components_of_edges([r[0] for r in rows], [(e.a, e.b) for e in edges.collect()]) == {r[0]: min(rows)[0] for r in rows}


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_split_keys_lose_no_link(spark, monkeypatch, radius):
    """With every key that five rows share split, and few rows held at a time, the components stay the same."""
    monkeypatch.setattr(simhash_dedup, "OFTEN", 5)
    monkeypatch.setattr(simhash_dedup, "HELD", 20)
    r = np.random.default_rng(radius)
    base = int(r.integers(0, 2**63))
    fps = {base ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 9), replace=False)) for _ in range(250)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = simhash_dedup.fingerprint_edges(nodes(spark, signed), radius).collect()
    assert slow_components_of_edges(signed, [(e.a, e.b) for e in edges]) == slow_components({s: s % 2**64 for s in signed}, radius)
    assert all(((e.a ^ e.b) % 2**64).bit_count() <= radius for e in edges)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (-5, -9)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = slow_components_of_edges(sorted({x for e in edges for x in e}), edges)
    assert {**{n: n for n in want}, **got} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_edges(spark, odd_docs, no_docs):
    rows = simhash_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component == 1 and by[3].component == by[4].component == by[5].component == 3 and by[3].fp == [0]
    assert by[None].component is None
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def test_edited_texts_and_likeness(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    by_text = {}
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == like(r.fingerprint, got[j].fingerprint)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        others = {int(o.fingerprint, 16) for o in got.values()} - {int(r.fingerprint, 16)}
        want = sum((int(r.fingerprint, 16) ^ o).bit_count() <= 3 for o in others)
        assert r.n_near == (want if i % 20 == 0 else None)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_majority_equals_counting_bits(spark):
    texts = ["", "one", "a b a b c", "x y z " * 15_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.fp_text for r in fingerprints.fingerprint_texts(df, ["k"], ["text"]).collect()}
    hashes = {r.k: r.h for r in df.select("k", fingerprints.term_hashes(F.col("text")).alias("h")).collect()}
    for k, hs in hashes.items():
        bits = np.unpackbits(np.array(hs, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        assert got[k] % 2**64 == sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(hs))


def test_search_in_permuted_tables(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 40)]
    rows = base + [x ^ sum(1 << int(b) for b in r.choice(63, n, replace=False)) for x in base for n in (1, 3, 4)]
    df = spark.createDataFrame([(x,) for x in rows + base[:5]], "fp long")
    queries = spark.createDataFrame([(x,) for x in base], "query long")
    got = sorted(map(tuple, fingerprints.near_fingerprints(df, queries, 3, 6).collect()))
    want = sorted((q, f, d) for q in set(base) for f in set(rows) if (d := ((q ^ f) % 2**64).bit_count()) <= 3)
    assert got == want


def test_fingerprint_edges(spark, odd_docs, no_docs):
    rows = fingerprints.fingerprint_edits(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.n_chars for r in rows if r.doc_id in (3, 4)} == {0}
    assert len({r.fingerprint for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert fingerprints.fingerprint_edits(no_docs).count() == 0
    one = fingerprints.fingerprint_edits(odd_docs.where("doc_id = 6")).first()
    text = odd_docs.where("doc_id = 6").first().text
    third = len(text) // 3
    assert one.edited_sha256 == hashlib.sha256((text[: len(text) - third] + text[:third]).encode()).hexdigest()


def slow_topk(x, queries, k):
    out = []
    for q in queries:
        s = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:k]
        out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s)]
    return out


@pytest.mark.parametrize(("n", "spread", "k"), [(300, 8, 5), (130, 2, 20), (15, 40, 20), (200, 0, 3)])
def test_topk_is_exact_with_ties(spark, n, spread, k):
    r = np.random.default_rng(n)
    x = {i: np.rint(r.standard_normal(6) * spread).astype(int) for i in range(n)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, vector array<long>")
    got = bitsliced.topk_inner_product(df, df.where("id % 10 = 0"), k, block_rows=100, query_group=8).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted(slow_topk(x, range(0, n, 10), k))


def test_candidates_hold_the_best_and_drop_most():
    r = np.random.default_rng(1)
    x = np.rint(r.standard_normal((4000, 32)) * 9).astype(np.int64)
    index = bitsliced.Index(x)
    sizes = []
    for q in x[:20]:
        scores = x @ q
        rows = index.candidates(q, 10)
        assert set(np.flatnonzero(scores >= np.sort(scores)[-10])) <= set(rows.tolist())
        sizes.append(len(rows))
    assert np.mean(sizes) < 1500


def test_topk_edges(spark):
    rows = [(0, [1, 2]), (1, [1]), (2, None), (3, [1, None]), (4, []), (None, [5, 5]), (0, [1, 2])]
    df = spark.createDataFrame(rows, "id long, vector array<long>").withColumn("cell", F.lit("clash"))
    got = bitsliced.topk_inner_product(df, df.where("id = 1"), 5).collect()
    assert sorted((r["rank"], r.id, r.score) for r in got) == [(1, 0, 1), (2, 0, 1), (3, 4, 0)]
    assert bitsliced.topk_inner_product(df.where("false"), df, 5).count() == 0
    assert bitsliced.topk_inner_product(df, df.where("false"), 5).count() == 0


def test_topk_of_an_id_repeated_more_often_than_k():
    r = np.random.default_rng(2)
    x = np.rint(r.standard_normal((400, 16)) * 9).astype(np.int64)
    ids = np.arange(400)
    x[:30], ids[:30] = x[0] * 3, 0
    got, scores = bitsliced.Index(x).top(x[0], 20, ids, 0)
    want = sorted((-int(x[i] @ x[0]), i) for i in range(30, 400))[:20]
    assert list(zip((-scores).tolist(), got.tolist(), strict=True)) == want


def test_followers_of_rows_that_share_an_id(spark):
    """A frequent id and many rows without one fill several ranges; the chain is that of one sort."""
    rows = [(7, f"seven {i}") for i in range(300)] + [(None, f"none {i}") for i in range(150)] + [(i, f"id {i}") for i in range(100)] + [(7, "seven 1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    signed = lambda t: (h := spark_hash(t)) - (h >> 63 << 64)
    chain = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    want = sorted((str(i), t, chain[(k + 1) % len(chain)][1]) for k, (i, t) in enumerate(chain))
    assert sorted((str(r.id), r.text, r.next_text) for r in fingerprints.followers(df).collect()) == want


def spark_hash(*values):
    """XXH64 as Spark chains it over values, each hash the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed)
    return seed


def plain_fingerprint(text):
    words = re.split("[ \t-\r]+", text.strip(" \t\n\x0b\f\r").lower())
    hashes = [spark_hash(a, b) for a, b in itertools.pairwise(words)] + [spark_hash(words[-1])]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints_equal_plain_code(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["river", "house", "old", "new", "bank", "x"]) for _ in range(r.randrange(0, 60))) for _ in range(40)] + ["", " \t ", "one", "A a  A"]
    rows = fingerprints.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        text, after = texts[row.doc_id], texts[row.doc_id - 1]  # of the row with the next lower id, after the first the last
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = (plain_fingerprint(t) for t in (text, edited, after))
        assert (int(row.fingerprint, 16), int(row.edited_fingerprint, 16)) == (own, other), text
        assert row.near_edited == 1 - (own ^ other).bit_count() / 64 and row.near_next == 1 - (own ^ following).bit_count() / 64


def test_shards_equal_plain_descent(spark):
    """Every row's way down the tree recomputed from its draws, with unlike weights too."""
    from tessera.llm import sharding

    def descend(key, node):
        while node.shard is None:
            draws = [(-math.log(((spark_hash(key, c.name) >> 12) + 0.5) / (1 << 52)) / c.weight, i) for i, c in enumerate(node.children) if c.weight > 0]
            node = node.children[min(draws)[1]]
        return node.shard

    even = sharding.tree(16)
    rows = sharding.shard_documents(spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()
    assert all(r.shard == descend(r.doc_id, even) and r.grown_shard == descend(r.doc_id, sharding.grow(even, 16)) for r in rows)
    leaf = lambda s, w: sharding.Node(f"s{s}", shard=s, own_weight=w)
    uneven = sharding.Node("root", (sharding.Node("a", (sharding.Node("a0", (leaf(0, 1.0), leaf(1, 3.0))),)), sharding.Node("b", (sharding.Node("b0", (leaf(2, 0.5),)), sharding.Node("b1", (leaf(3, 0.0), leaf(4, 2.0)))))))
    found = spark.range(500).select("id", sharding.place(F.col("id"), uneven).alias("shard")).collect()
    assert all(r.shard == descend(r.id, uneven) for r in found) and {r.shard for r in found} == {0, 1, 2, 4}
