"""Toxicity chain, language model and packing."""

import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import hpy_lm, packing, textscan, toxicity

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n=120, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at, out = 0, []
        for _ in range(int(r.integers(5, 60))):
            at = (at * 7 + int(r.integers(0, 4))) % len(WORDS)  # a word follows from the one before it
            out.append(WORDS[at])
        rows.append((i, " ".join(out)))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_word_keys_are_those_of_equal_words():
    import pyarrow as pa

    texts = ["The the THE cat", None, "", "cat\x0bthe tac act", "é É é"]
    keys, doc, _ = textscan.words(pa.array(texts))
    want = [(w, i) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert doc.tolist() == [i for _, i in want]
    assert len(set(zip([w for w, _ in want], keys.tolist(), strict=True))) == len({w for w, _ in want}) == len(set(keys.tolist()))


def test_language_model_base_counts_and_gain(spark):
    df, rows = corpus(spark)
    train = F.col("doc_id") % 4 != 0
    got = {r.doc_id: r for r in hpy_lm.score_texts(df, train).collect()}
    tokens = {i: [*t.split(), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if i % 4 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.train_tokens, r.train) == (len(ws), n, i % 4 != 0)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    held = [i for i in got if i % 4 == 0]
    assert sum(got[i].score for i in held) > 0.75 * sum(got[i].base_score for i in held)  # both negative


def test_language_model_probabilities_add_up_to_one(spark):
    """One-word texts of every known word, of an unknown one and none at all: what P(first token) adds up to."""
    df, rows = corpus(spark, 60, 2)
    known = sorted({w for _, t in rows for w in t.split()})
    # P(w, end) = P(w | start) P(end | w); two-word texts "w w3" and "w3" give P(end | w) by way of P(w3 | w)
    texts = {("one", w): w for w in [*known, "never-seen"]} | {("two", w): f"{w} {w}" for w in [*known, "never-seen"]} | {("three", w): f"{w} {w} {w}" for w in [*known, "never-seen"]} | {("none", ""): ""}
    probe = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts.values())], df.schema)
    out = {r.doc_id: r.score for r in hpy_lm.score_texts(df.union(probe), F.col("doc_id") < 10_000, buckets=5).collect()}
    log = {k: out[10_000 + i] for i, k in enumerate(texts)}
    # log P(w w) - log P(w) = log P(w | w), with which P(w | start) P(end | w) is left
    total = 10 ** log["none", ""]
    ends = {}
    for w in [*known, "never-seen"]:
        assert math.isclose(log["three", w] - log["two", w], log["two", w] - log["one", w], abs_tol=1e-9)
        ends[w] = log["one", w]
        total += 10 ** log["one", w]
    assert 0 < total <= 1 + 1e-9  # the texts of at most one token and its end are some of all texts


def test_predictive_probabilities_add_up_to_one_in_every_context():
    """From the formula's parts: what a context's words and the unknown word get, given one seating."""
    r = np.random.default_rng(3)
    c = r.integers(0, 9, (5, 40))
    d1, d0, table = 0.7, 0.5, hpy_lm.log_stirling(0.7)
    t = hpy_lm.seat(c.ravel(), np.full(c.size, 0.2), d1, table, r).reshape(c.shape)
    c0 = t.sum(0)
    t0 = hpy_lm.seat(c0, np.full(len(c0), 0.1), d0, hpy_lm.log_stirling(d0), r)
    v = np.count_nonzero(c0)
    p0 = (c0 - d0 * t0 + (1 + d0 * t0.sum()) / (v + 1)) / (1 + c0.sum())
    p0 = np.append(p0[c0 > 0], (1 + d0 * t0.sum()) / (v + 1) / (1 + c0.sum()))
    assert math.isclose(p0.sum(), 1)
    for k in range(5):
        cc, tt = np.append(c[k][c0 > 0], 0), np.append(t[k][c0 > 0], 0)
        assert math.isclose(((cc - d1 * tt + (1 + d1 * tt.sum()) * p0) / (1 + cc.sum())).sum(), 1)


def test_seating_has_the_law_of_sequential_resampling():
    """Small cells: the drawn numbers of tables follow S_d(c, t) a**t, found by listing all partitions."""
    d, a, c = 0.6, 0.3, 4

    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            for k in range(len(p)):
                yield [*p[:k], p[k] + 1, *p[k + 1 :]]
            yield [*p, 1]

    want = np.zeros(c + 1)
    for p in partitions(c):
        want[len(p)] += a ** len(p) * math.prod(math.prod(j - d for j in range(1, s)) for s in p)
    draws = hpy_lm.seat(np.full(200_000, c), np.full(200_000, a), d, hpy_lm.log_stirling(d), np.random.default_rng(0))
    assert np.allclose(np.bincount(draws, minlength=c + 1) / len(draws), want / want.sum(), atol=0.005)
    many = hpy_lm.seat(np.full(100, 5000), np.full(100, 2.0), d, hpy_lm.log_stirling(d), np.random.default_rng(0))
    assert many.min() >= 1 and many.max() <= 5000


def test_language_model_edges(spark, odd_docs, no_docs):
    rows = hpy_lm.score_texts(odd_docs, F.col("doc_id") < 5).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[8].n_tokens == 3001 and by[None].n_tokens == 6
    none = hpy_lm.score_texts(odd_docs, F.lit(False)).collect()
    assert {r.score for r in none} == {0.0} == {r.base_score for r in none}
    assert hpy_lm.score_texts(no_docs, F.lit(True)).count() == 0


def plain_sampler(cells, base, d1, d0, burn, samples, seed):
    """Customer by customer: contexts over one parent over a base; averaged predictive probabilities."""
    r, tables, parent = random.Random(seed), {k: [] for k in cells}, {w: [] for w in base}
    opened, customers = Counter(), Counter()
    for (u, _), c in cells.items():
        customers[u] += c

    def p0(w):
        seated, all_tables = (sum(f(x) for x in parent.values()) for f in (sum, len))
        return (sum(parent[w]) - d0 * len(parent[w]) + (1 + d0 * all_tables) * base[w]) / (1 + seated)

    def sit(own, discount, new):
        k = r.choices(range(len(own) + 1), [*(n - discount for n in own), new])[0]
        own[k:] = [*own[k : k + 1], *own[k + 1 :]] or [0]
        own[k] += 1
        return own[k] == 1

    def leave(own):
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        return not own[k] and own.pop(k) == 0

    def add(u, w):
        if sit(tables[u, w], d1, (1 + d1 * opened[u]) * p0(w)):
            opened[u] += 1
            sit(parent[w], d0, (1 + d0 * sum(map(len, parent.values()))) * base[w])

    def remove(u, w):
        if leave(tables[u, w]):
            opened[u] -= 1
            leave(parent[w])

    each, out = [k for k, c in cells.items() for _ in range(c)], Counter()
    for k in each:
        add(*k)
    for sweep in range(burn + samples):
        for k in each:
            remove(*k)
            add(*k)
        for u in customers if sweep >= burn else ():
            for w in base:
                own = tables.get((u, w), [])
                out[u, w] += (sum(own) - d1 * len(own) + (1 + d1 * opened[u]) * p0(w)) / (1 + customers[u]) / samples
    return out


def test_averaged_probabilities_are_those_of_a_plain_sampler():
    r, n_contexts, n_words = np.random.default_rng(1), 5, 10
    cells = {(u, w): int(r.integers(1, 12)) for u in range(n_contexts) for w in range(n_words) if r.random() < 0.4}
    keys = [(u, w) for u in range(n_contexts) for w in range(n_words)]
    c, (context, word) = np.array([cells.get(k, 0) for k in keys]), np.array(keys).T
    n = np.bincount(word, c, n_words)
    base = (n + 1) / (n.sum() + n_words + 1)
    d1, d0 = hpy_lm._discount(c), hpy_lm._discount(np.bincount(word, np.minimum(c, 1), n_words))
    want = plain_sampler(cells, dict(enumerate(base)), d1, d0, 30, 600, 0)
    ones = np.ones(n_contexts)
    got = hpy_lm.predictive(c, context, word, base, ones < 0, (ones, ones), 30, 2000, np.random.default_rng(0))
    off = np.abs(got / np.array([want[k] for k in keys]) - 1)
    assert off.max() < 0.15 and off.mean() < 0.03


def test_rooms_of_a_frequent_context_add_up_to_one():
    r, rooms, n_words = np.random.default_rng(2), 3, 30
    n = r.integers(1, 50, n_words)
    total, of, own_c = n.sum() + n_words + 1, np.arange(n_words) % rooms, r.integers(0, 9, n_words)
    base, added = np.append(n + 1, 1) / total, 0.0
    for k in range(rooms):
        mine = np.append(of == k, k == 0)  # the unknown word is in room 0
        c, share = np.append(own_c, 0)[mine], base[mine].sum()
        whole = (c.sum() + share) / (own_c.sum() + 1)
        at = np.zeros(len(c), int)
        added += hpy_lm.predictive(c, at, np.arange(len(c)), base[mine], np.array([True]), (np.array([whole]), np.array([share])), 2, 3, r).sum()
    assert math.isclose(added, 1)


def test_frequent_contexts_and_partitions_leave_scores_whole(spark, monkeypatch):
    """Frequent contexts in rooms score every token and beat the base; how the rows are dealt changes nothing."""
    df, rows = corpus(spark, 80, 3)
    monkeypatch.setattr(hpy_lm, "ROOM", 20)
    score = lambda d: sorted((r.doc_id, r.score, r.base_score, r.n_tokens) for r in hpy_lm.score_texts(d, F.col("doc_id") % 4 != 0, buckets=4).collect())
    got = score(df)
    assert [g[0] for g in got] == [i for i, _ in rows] and all(g[3] == len(t.split()) + 1 for g, (_, t) in zip(got, rows, strict=True))
    assert sum(g[1] for g in got if g[0] % 4 == 0) > 0.85 * sum(g[2] for g in got if g[0] % 4 == 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = score(df.repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-12) for a, b in zip(got, again, strict=True))


def scores(df, **more):
    return {r.doc_id: (r.score, r.base_score, r.n_known) for r in hpy_lm.score_texts(df, F.col("doc_id") % 4 != 0, **more).collect()}


def test_scores_hang_on_no_size(spark, monkeypatch):
    """The bytes of text, rows outside the training set, tasks and divided contexts change where work is done, no score."""
    df, _ = corpus(spark, 80, 5)
    want = scores(df)
    text = " ".join(f"{w} unseen{i}" for i, w in enumerate(WORDS)) + " w1 w7 unseen" * 550_000  # 7 MB, past BUCKET
    more = scores(df.union(spark.createDataFrame([(1000, text)], df.schema)))
    assert more.pop(1000)[0] < 0 and more == want
    monkeypatch.setattr(hpy_lm, "BUCKET", 500)  # some thirty tasks, several readers
    assert scores(df) == want
    monkeypatch.setattr(hpy_lm, "ROOM", 20)  # contexts whose words lie in many tasks
    assert scores(df) == want
    assert scores(df, seed=12) != want


def test_scores_are_those_of_one_model_in_one_place(spark, monkeypatch):
    """Tasks, readers and divided contexts together give what all cells over one parent give."""
    df, rows = corpus(spark, 80, 6)
    pairs = {i: list(itertools.pairwise([None, *t.split(), None])) for i, t in rows}
    cells = Counter(p for i, ps in pairs.items() if i % 4 for p in ps)
    keys = sorted({p for ps in pairs.values() for p in ps}, key=str)
    place = {w: k for k, w in enumerate(sorted({w for p in keys for w in p}, key=str))}
    c, context, word = (np.array(x) for x in zip(*((cells[p], place[p[0]], place[p[1]]) for p in keys), strict=True))
    n = np.bincount(word, c, len(place))
    base, ones = (n + 1) / (n.sum() + np.count_nonzero(n) + 1), np.ones(len(place))
    mean = dict(zip(keys, hpy_lm.predictive(c, context, word, base, ones < 0, (ones, ones), 20, 300, np.random.default_rng(0)), strict=True))
    monkeypatch.setattr(hpy_lm, "ROOM", 20)
    got = scores(df, buckets=12, samples=8)
    off = [got[i][0] / sum(math.log10(mean[p]) for p in ps) - 1 for i, ps in pairs.items()]
    print("largest", max(map(abs, off)), "mean", np.mean(np.abs(off)))
    assert max(map(abs, off)) < 0.02 and np.mean(np.abs(off)) < 0.005


def test_seating_hangs_on_the_cells_alone():
    """Keyed draws: a cell's tables are the same whatever cells it is seated with, also by leaps."""
    keys, c = np.arange(400), np.tile([1, 3, 40, 700], 100)
    mass, table = np.linspace(0.1, 5, 400), hpy_lm.log_stirling(0.6)
    whole = hpy_lm.seat(c, mass, 0.6, table, hpy_lm.Draws(keys, 1, 2))
    part = np.random.default_rng(0).permutation(400)[:150]
    assert (hpy_lm.seat(c[part], mass[part], 0.6, table, hpy_lm.Draws(keys[part], 1, 2)) == whole[part]).all()
    assert (hpy_lm.seat(c, mass, 0.6, table, hpy_lm.Draws(keys, 1, 3)) != whole).any()
    even = hpy_lm.Draws(np.arange(100_000), 5).random(100_000)
    assert np.abs(np.histogram(even, 20, (0, 1))[0] / 5000 - 1).max() < 0.08 and abs(np.corrcoef(even[1:], even[:-1])[0, 1]) < 0.02


def test_long_text_is_scored_whole(spark):
    text = "some words that come again " * 500_000  # 13.5 MB, over a slice
    got = hpy_lm.score_texts(spark.createDataFrame([(1, text), (2, "some words")], "doc_id long, text string"), F.lit(True)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 2_500_001, 2: 3}


def labelled(spark, n=600):
    r = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        words = [WORDS[j] for j in r.integers(0, 60, 25)]
        toxic, junk = i % 5 == 0, i % 7 == 0
        words += ["vile" + "abcdef"[int(r.integers(0, 6))]] * toxic + ["zzz"] * junk
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_chain_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = toxicity.score_toxicity(docs, toxicity.corpus_chain(docs, labels)).collect()
    held = [r for r in out if r.doc_id % 2]
    assert np.mean([r.is_toxic == (r.doc_id % 5 == 0) for r in held]) > 0.98
    assert np.mean([r.is_low_quality == (r.doc_id % 7 == 0) for r in held]) > 0.98


def newton(x, y, dense, penalty=1.0):
    """Ridge logistic regression with a free intercept, solved by Newton steps; all but ``dense`` columns scaled by evidence."""
    n, rate = x.sum(0), y.mean()
    square = (x.T @ y - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9)
    scale = np.append(square / (square + 12), 1)
    scale[len(scale) - 1 - dense : -1] = 1
    x = np.column_stack([x, np.ones(len(x))]) * scale
    ridge, w = np.diag([penalty] * (x.shape[1] - 1) + [0]), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return lambda z: 1 / (1 + np.exp(-((np.column_stack([z, np.ones(len(z))]) * scale) @ w)))


def test_chain_equals_a_plain_solver(spark):
    """Features, folds and both models of the chain recomputed with sets, dense matrices and Newton's method."""
    docs, labels = labelled(spark, 240)
    texts, known = dict(docs.collect()), {r.doc_id: r for r in labels.collect()}
    ids = sorted(known)
    feats = {i: {o for w in re.findall("[a-z]+", t.lower()) for o in (w, *(w[:n] for n in (4, 5, 6, 8) if len(w) > n))} for i, t in texts.items()}
    seen = Counter(f for i in ids for f in feats[i])
    columns = sorted(f for f, n in seen.items() if n > 1)
    x = {i: np.array([f in feats[i] for f in columns], float) for i in texts}
    fold = np.random.default_rng(5).permutation(len(ids)) % 5
    train, every = np.array([x[i] for i in ids]), np.array([x[i] for i in sorted(texts)])
    for dense, (name, value) in enumerate((("low_quality", lambda r: 1 - r.quality), ("toxic", lambda r: r.toxic))):
        y = np.array([value(known[i]) for i in ids], float)
        out = np.zeros(len(ids))
        for f in range(5):
            out[fold == f] = newton(train[fold != f], y[fold != f], dense)(train[fold == f])
        p = newton(train, y, dense)(every)
        train, every = np.column_stack([train, out]), np.column_stack([every, p])
        got = {r.doc_id: r[f"p_{name}"] for r in toxicity.score_toxicity(docs, toxicity.corpus_chain(docs, labels)).collect()}
        assert max(abs(got[i] - q) for i, q in zip(sorted(texts), p, strict=True)) < 0.02


def test_chain_of_a_single_label_has_numbers(spark):
    docs, labels = labelled(spark, 40)
    one = toxicity.corpus_chain(docs, labels.limit(1))
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in toxicity.score_toxicity(docs, one).collect())


def test_chain_reads_one_text_of_a_repeated_id(spark):
    docs, labels = labelled(spark, 120)
    again = docs.union(docs.where("doc_id < 4").withColumn("text", F.concat("text", F.lit(" zz more words"))).crossJoin(spark.range(50)).drop("id"))
    a, b = (toxicity.corpus_chain(d, labels) for d in (docs, again.repartition(3)))
    assert a.lexicon.keys.tolist() == b.lexicon.keys.tolist() and a.thresholds == b.thresholds


def test_toxicity_edges(spark, odd_docs, no_docs):
    docs, labels = labelled(spark, 100)
    chain = toxicity.corpus_chain(docs, labels)
    got = toxicity.score_toxicity(odd_docs.withColumn("p_toxic", F.lit("clash")), chain)
    assert got.count() == odd_docs.count() and "label" in got.columns and dict(got.dtypes)["p_toxic"] == "double"
    assert toxicity.score_toxicity(no_docs, chain).count() == 0
    blank = toxicity.corpus_chain(docs, labels.where("false"))
    assert not any(r.is_toxic for r in toxicity.score_toxicity(docs, blank).collect())
    nulls = labels.withColumn("toxic", F.lit(None).cast("int")).unionByName(labels)
    assert toxicity.corpus_chain(docs, nulls).thresholds[1] <= 1.1


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    texts = ["hello <|endoftext|> world", "a<|startoftext|><|endoftext|>", "<|STARTOFTEXT|> <| endoftext |>", "", None, "it's 'street we'll'' 're x", "á É İ ΟΔΟΣ 12½ ٣ <|endoftext|> \x1c\x85 a b", "'s", "''t", "don't", "x'", "'", "é ẛ̣", "'", "s next", "…—“q”", "a​b", "中文 日本語", "-" * 400]
    ids, ends = packing.token_ids(texts, PATH)
    at = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[at:end].tolist() == own.encode(text or "", add_special_tokens=False).ids, text
        at = end


def test_ids_of_every_code_point_equal_the_library():
    """Assigned code points, some that this Python doesn't know, between letters, blanks and themselves."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    points = [c for c, k in enumerate(kinds) if k not in ("Cn", "Co", "Cs")] + [c for c, k in enumerate(kinds) if k == "Cn"][::97] + [0xE000, 0x10FFFD, 0x1C89, 0xA7CB, 0x105C0]
    for a in range(0, len(points), 20_000):
        some = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s" for c in points[a : a + 20_000]]
        ids, ends = packing.token_ids(some, PATH)
        found = np.split(ids, ends[:-1])
        assert [hex(c) for c, f, e in zip(points[a:], found, own.encode_batch(some, add_special_tokens=False), strict=False) if f.tolist() != e.ids] == []


def check_packing(rows, texts, length=2048):
    from tokenizers import Tokenizer

    want = {}
    model = Tokenizer.from_file(PATH)
    copies = Counter()
    for i, text in texts:
        own = np.array([*model.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        for s in range(0, len(own), length):
            p = own[s : s + length]
            copies[i, s, len(p), zlib.crc32(p.tobytes()), len(own)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == copies
    for r in rows:
        want.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(want) == list(range(len(want)))
    for parts in want.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length


def test_packing_edges(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert packing.pack(no_docs, PATH).count() == 0


def test_packing_has_little_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(df, PATH).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    used = sum(r.length for r in rows)
    assert max(r.sequence_id for r in rows) + 1 <= -(-used // 2048) * 1.03 + 1


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock_covers_demand_near_the_bound(seed):
    r = np.random.default_rng(seed)
    capacity = 64
    demand = np.zeros(capacity + 1, np.int64)
    for s in r.integers(1, capacity + 1, 12):
        demand[s] += int(r.integers(1, 200))
    patterns = packing.cutting_stock(demand, capacity)
    made = sum(n * c for n, c in patterns)
    assert (made == demand).all() and all((c * np.arange(capacity + 1)).sum() <= capacity for _, c in patterns)
    uses = sum(n for n, _ in patterns)
    large = demand[capacity // 2 + 1 :].sum()
    bound = max(-(-(demand * np.arange(capacity + 1)).sum() // capacity), large)
    assert bound <= uses <= bound * 1.12 + 8


def test_best_pattern_is_optimal():
    prices = np.array([0, 0.11, 0.0, 0.35, 0.4, 0.6, 0, 0, 0, 0])
    value, counts = packing.best_pattern(prices, 9)
    fits = [c for c in itertools.product(range(10), range(4), range(3), range(2)) if c[0] + 3 * c[1] + 4 * c[2] + 5 * c[3] <= 9]
    assert math.isclose(value, max(0.11 * c[0] + 0.35 * c[1] + 0.4 * c[2] + 0.6 * c[3] for c in fits))
    assert math.isclose(value, (counts * prices).sum()) and (counts * np.arange(10)).sum() <= 9
