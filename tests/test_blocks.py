"""Searches in blocks against their forms on pairs, and rounding as SQL has it."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import index, knn, layout, pruning, scoring, stats, sweeps
from tessera.plans import catalog
from tessera.sources import tokens

SF = "/root/testdata/sf0.001"


def test_layout_keeps_the_sign_of_zero(spark):
    vectors = spark.createDataFrame([(0, [-1e-7, 0.25]), (1, [1e-7, -0.1234567])], "vec_id long, vec array<double>")
    columns = [r["column"] for r in layout.blocked(vectors, 64).orderBy("dim").collect()]
    assert columns == [[-0.0, 0.0], [0.25, -0.123457]]
    assert np.signbit(columns[0]).tolist() == [True, False]


def _table(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>")


def _vectors(spark, n=90, width=8):
    """Vectors, some of them copies of others, and every ninth as a query."""
    x = np.random.default_rng(4).standard_normal((n, width)) * 0.7 ** np.arange(width)
    x[1::10] = x[0]
    return _table(spark, x), _table(spark, x).where("vec_id % 9 = 0").selectExpr("vec_id AS qid", "vec")


def _rows(found):
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("alpha", [None, 0.0, 1.5])
@pytest.mark.parametrize("sparse", [0.0, 1.1])
def test_early_termination_equals_its_form_on_pairs(spark, monkeypatch, alpha, sparse):
    for name, value in (("TASK_ROWS", 40), ("BLOCK_ROWS", 7), ("BLOCK_QUERIES", 3), ("SPARSE", sparse)):
        monkeypatch.setattr(knn, name, value)
    vectors, queries = _vectors(spark)
    want = knn.terminate_early(knn.pairs(vectors, queries), 3, [2, 4, 8], alpha)
    monkeypatch.setattr(knn, "pairs", None)  # no pair is a row
    got = knn.early_termination(vectors, queries, 3, [2, 4, 8], alpha)
    assert [_rows(g) for g in got] == [_rows(w) for w in want]


def test_early_scan_of_lists_equals_its_form_on_pairs(spark, monkeypatch):
    vectors, queries = _vectors(spark)
    centres = vectors.where("vec_id in (3, 5, 8, 12)").selectExpr("vec_id AS centroid", "vec")
    lists = index.nearest(vectors, centres, 1, "vec_id").drop("rank").join(vectors, "vec_id")
    order = [7, 6, 5, 4, 3, 2, 1, 0]
    pairs = index.probed_pairs(lists, centres, queries, 2).withColumns({"q": F.reverse("q"), "x": F.reverse("x")})
    want = knn.terminate_early(pairs, 3, [2, 4, 8])
    monkeypatch.setattr(index, "probed_pairs", None)
    got = index.early_scan(lists, centres, queries, 2, 3, [2, 4, 8], order=order)
    assert [_rows(g) for g in got] == [_rows(w) for w in want]


def test_alpha_sweep_equals_one_search_for_each(spark, monkeypatch):
    vectors, queries = _vectors(spark)
    truth, want = knn.exact(vectors, queries, 3).select("qid", "vec_id"), []
    for alpha in (0.0, 0.7, 3.0):
        found, work = knn.terminate_early(knn.pairs(vectors, queries), 3, [2, 4, 8], alpha)
        recall = knn.recall(found, truth, 3).agg(F.round(F.avg("recall"), 6)).first()[0]
        want.append((alpha, recall, work.agg(F.round(F.avg("fraction"), 6)).first()[0]))
    monkeypatch.setattr(knn, "pairs", None)
    assert _rows(knn.alpha_sweep(vectors, queries, 3, [2, 4, 8], [0.7, 0.0, 3.0])) == want


@pytest.mark.parametrize("k", [1, 3, 200])
@pytest.mark.parametrize("shape", ["plain", "halves", "far"])
def test_nearest_equals_its_form_on_pairs(spark, monkeypatch, shape, k):
    """halves: distances as 2**-7, which end in half a digit; far: vectors whose squares swallow their distances."""
    for name, value in (("NEAR_ROWS", 40), ("BLOCK_ROWS", 7), ("NEAR_QUERIES", 3)):
        monkeypatch.setattr(knn, name, value)
    vectors, queries = _vectors(spark)
    if shape != "plain":
        x = np.random.default_rng(5).integers(0, 3, (90, 4)) * 2.0**-4 + (1e7 if shape == "far" else 0)
        vectors, queries = _table(spark, x), _table(spark, x).where("vec_id % 9 = 0").selectExpr("vec_id AS qid", "vec")
    want = _rows(knn.exact(vectors, queries, k))
    monkeypatch.setattr(knn, "pairs", None)  # no pair is a row
    assert _rows(knn.nearest(vectors, queries, k)) == want
    assert _rows(knn.nearest(vectors, queries, k, limit=300)) == want  # queries in groups


def test_nearest_of_odd_rows(spark):
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, vec array<double>")
    vectors = table([(None, [0.0]), (7, [1.0]), (5, [0.0]), (9, [3.0])], "vec_id")
    queries = table([(1, [0.0])], "qid")
    found = lambda k: [tuple(r) for r in knn.nearest(vectors, queries, k).orderBy("rank").collect()]
    assert found(1) == [(1, 1, 5, 0.0)]  # a null id is the larger one of equals
    assert found(9) == [(1, 1, 5, 0.0), (1, 2, None, 0.0), (1, 3, 7, 1.0), (1, 4, 9, 9.0)]
    vast = table([(i, [x]) for i, x in enumerate([1.5e154 + 1e140, 1.5e154, -1.5e154, 1.0])], "vec_id")  # squares overflow
    got = [tuple(r) for r in knn.nearest(vast, table([(1, [1.5e154])], "qid"), 3).orderBy("rank").collect()]
    assert [r[2] for r in got] == [1, 0, 2] and got[1][3] < 1e281 and got[2][3] == np.inf
    assert knn.nearest(vectors.where("false"), queries, 3).count() == knn.nearest(vectors, queries.where("false"), 3).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_knn_l2_pairs_no_rows(spark):
    """a join of all queries with all vectors made every pair a row."""
    plan = catalog.queries()["knn_l2"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def _tokens(spark, seed, items, names):
    """Ragged items; in the first tokens of an item the tails vanish."""
    r, rows = np.random.default_rng(seed), []
    for i in range(items):
        for t in range(r.integers(1, 6)):
            rows.append((i, t, (r.standard_normal(8) * 0.5 ** np.arange(8) * (np.arange(8) < 4 if t == 0 else 1)).tolist()))
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} int, vec array<double>")


def _both(spark):
    return _tokens(spark, 1, 40, ("doc_id", "tok")), _tokens(spark, 2, 7, ("qid", "qtok"))


def test_scores_by_token_need_no_pairs(spark, monkeypatch):
    docs, queries = _both(spark)
    for tokens in (5, 2):
        want = _rows(scoring.rounded(scoring.maxsim_native(docs, queries.where(F.col("qtok") < tokens))))
        with monkeypatch.context() as m:
            m.setattr(scoring, "token_pairs", None)
            assert _rows(scoring.rounded(scoring.maxsim_by_token(docs, queries, tokens))) == want


def test_live_counts_equal_live_tokens(spark, monkeypatch):
    docs, queries = _both(spark)
    want = _rows(pruning.live_tokens(pruning.bound_pairs(docs, queries, 4)).groupBy("qid", "doc_id").agg(F.countDistinct("tok")))
    monkeypatch.setattr(pruning, "BOUND_CELLS", 64)
    assert _rows(pruning.live_counts(docs, queries, 4)) == want


def test_probes_by_blocks(spark, monkeypatch):
    docs, queries = _both(spark)
    centres = docs.where("tok = 0 and doc_id < 6").selectExpr("doc_id AS centroid", "vec")
    lists = index.assign(docs, centres)
    near = index.nearest(queries, centres, 2, "qid", "qtok").drop("rank").join(queries.withColumnRenamed("vec", "q"), ["qid", "qtok"])
    hits = lists.withColumnRenamed("vec", "d").join(near, "centroid")
    rough = scoring.rounded(scoring.best_then_sum(hits, V.dot("q", "d")))
    want = scoring.rerank(docs, queries, scoring.topk(rough, 6)).where("rank <= 3").select("qid", "rank", "doc_id", "score")
    monkeypatch.setattr(index, "PROBE_CELLS", 64)
    got = index.probe(lists, docs, centres, queries, 2, 6, 3)
    assert [r[:3] for r in _rows(got)] == [r[:3] for r in _rows(want)]
    assert np.allclose([r[3] for r in _rows(got)], [r[3] for r in _rows(want)])
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["maxsim_all_scores", "maxsim_per_token_union", "amortize_m", "token_prune_k48", "knn_l2_early_term", "knn_alpha_sweep", "alpha_points"])
def test_no_query_pairs_all_rows(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner\n" not in plan and "Join Cross" not in plan  # all joins have a condition


def test_encoded_texts_meet_no_shuffle_of_tokens(spark):
    texts = spark.createDataFrame([(1, "a b c, a a"), (2, None), (3, "D d e!"), (4, "?"), (5, "c a")], "id long, text string")
    queries = tokens.hashed_encoder(texts.where("id in (1, 3)"), "id", "text", 16, tok="qtok").withColumnRenamed("id", "qid")
    want = _rows(scoring.rounded(scoring.maxsim_blocks(scoring.pack_documents(tokens.hashed_encoder(texts, "id", "text", 16).withColumnRenamed("id", "doc_id")), queries)))
    packed = tokens.hashed_documents(texts, "id", "text", 16)
    assert _rows(scoring.rounded(scoring.maxsim_blocks(packed, queries))) == want
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()


def _rounds_by_pairs(docs, q, k, steps, shrink, order):
    """((doc, score) of the k best, cells): the rounds of one setting on pairs of tokens, one by one."""
    order = np.arange(8) if order is None else np.array(order)
    live, cells = {d: x[:, order] for d, x in docs.items()}, 0
    q = q[:, order]
    for at, step in zip([0, *steps], steps, strict=False):
        cells += sum(len(x) for x in live.values()) * len(q) * (step - at)
        p = {d: q[:, :step] @ x[:, :step].T for d, x in live.items()}
        if step == steps[-1]:
            found = {d: round(m.max(1).sum(), 6) for d, m in p.items()}
            return sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k], cells
        r = {d: np.outer(np.linalg.norm(q[:, step:], axis=1), np.linalg.norm(x[:, step:], axis=1)) * V.confidence(step, steps[-1], shrink) for d, x in live.items()}
        low = sorted(((p[d] - r[d]).max(1).sum() for d in live), reverse=True)
        tau = low[k - 1] if len(low) >= k else -np.inf
        live = {d: x[(p[d] + r[d] >= (p[d] - r[d]).max(1, keepdims=True)).any(0)] for d, x in live.items() if (p[d] + r[d]).max(1).sum() >= tau - 1e-9}


@pytest.mark.parametrize("small", [False, True])
def test_settings_share_rounds(spark, monkeypatch, small):
    """queries that differ by the shrink only are asked once, and find and count what each would alone."""
    if small:
        monkeypatch.setattr(pruning, "SIEVE_CELLS", 8)
        monkeypatch.setattr(pruning, "SCAN_TOKENS", 9)
    docs, queries = _both(spark)
    matrix = stats.random_rotation(8)
    arms = [("natural", None, None), ("bond", None, None), ("ada", None, None), ("bond", 2, 17), ("natural", None, 2)]
    knobs = [(a, s, m, n, 2) for a, m, n in arms for s in (0.8, 1.0, 0.0, 0.3)]
    asked = sweeps._asked(docs, queries, sweeps.settings(spark, knobs))
    assert asked.count() == 4 * queries.count() + queries.where("qtok < 2").count()  # not once a shrink
    found, work = pruning.shared_rounds(scoring.pack_documents(docs), asked, 3, [2, 4, 8], matrix=matrix)
    orders = {(r.qid.form, r.qid.own): r.order for r in asked.collect()}
    got, cells = {}, {}
    for r in found.orderBy("rank").collect():
        got.setdefault(tuple(r.qid), []).append((r.doc_id, r.score))
    for r in work.collect():
        cells[tuple(r.qid)] = cells.get(tuple(r.qid), 0) + r.cells
    by = lambda rows, key: {i: np.array([r.vec for r in rows if r[key] == i]) for i in {r[key] for r in rows}}
    d, q = by(docs.orderBy("doc_id", "tok").collect(), "doc_id"), by(queries.orderBy("qid", "qtok").collect(), "qid")
    for knob, (arm, shrink, m, first, _) in enumerate(knobs):
        for own, x in q.items():
            turn = lambda y: y @ matrix if arm == "ada" else y  # noqa: B023, E731
            some = {i: turn(y) for i, y in d.items() if first is None or i < first}
            best, seen = _rounds_by_pairs(some, turn(x[:m]), 3, [2, 4, 8], shrink, orders[knob // 4 * 4, own])
            assert [i for i, _ in got[knob, own]] == [i for i, _ in best]
            assert np.allclose([s for _, s in got[knob, own]], [s for _, s in best])
            assert cells[knob, own] == seen
