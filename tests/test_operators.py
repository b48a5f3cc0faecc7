"""Properties and edge cases of the retrieval operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import harness, index, knn, metrics, pruning, report, scoring, stats
from tessera.sources import corpora, tokens


def token_table(spark, items, names=("doc_id", "tok")):
    made = [(i, t, [float(x) for x in v]) for i, vs in items for t, v in enumerate(vs)]
    return spark.createDataFrame(made, f"{names[0]} long, {names[1]} int, vec array<double>")


def make(seed, docs=30, queries=4, width=12, decay=0.7):
    r = np.random.default_rng(seed)
    scale = decay ** np.arange(width)

    def some(n, lo, hi):
        out = []
        for i in range(n):
            v = r.standard_normal((r.integers(lo, hi), width)) * scale
            out.append((i, v / np.linalg.norm(v, axis=1, keepdims=True)))
        return out

    return some(docs, 1, 6), some(queries, 2, 5)


def brute(docs, queries, k):
    out = {}
    for q, qv in queries:
        s = sorted((-round(float((qv @ dv.T).max(1).sum()), 6), d) for d, dv in docs)
        out[q] = [(d, -x) for x, d in s[:k]]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.doc_id, r.score))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_agree_with_numpy(spark, seed):
    docs, queries = make(seed)
    d, q = token_table(spark, docs), token_table(spark, queries, ("qid", "qtok"))
    want = brute(docs, queries, 5)
    native = as_dict(scoring.topk(scoring.rounded(scoring.maxsim_native(d, q)), 5).collect())
    packed = scoring.pack_documents(d)
    blocks = as_dict(scoring.topk(scoring.rounded(scoring.maxsim_blocks(packed, q, k=5)), 5).collect())
    groups = as_dict(scoring.topk(scoring.rounded(scoring.maxsim_blocks(packed, q, limit=500)), 5).collect())
    assert native == want and blocks == want and groups == want


def test_pruning_is_lossless_and_prunes(spark):
    docs, queries = make(3, docs=60)
    d, q = token_table(spark, docs), token_table(spark, queries, ("qid", "qtok"))
    found, work = pruning.pruned_search(d, q, 3, [4, 8, 12])
    assert as_dict(found.collect()) == brute(docs, queries, 3)
    pairs = {r.step: r.n for r in work.groupBy("step").agg(F.sum("pairs").alias("n")).collect()}
    assert pairs[12] < pairs[4]


def test_bounds_enclose_scores_of_any_vectors(spark):
    docs, queries = make(4)
    docs = [(i, v * (1 + i % 3)) for i, v in docs]  # not unit vectors
    d, q = token_table(spark, docs), token_table(spark, queries, ("qid", "qtok"))
    scores = scoring.maxsim(d, q)
    last = None
    for k in (2, 6, 12):
        both = scores.join(pruning.upper_scores(d, q, k), ["qid", "doc_id"]).join(pruning.lower_scores(d, q, k), ["qid", "doc_id"])
        row = both.agg(F.min(F.col("ub") - F.col("score")), F.min(F.col("score") - F.col("lb")), F.sum("ub")).first()
        assert row[0] > -1e-9 and row[1] > -1e-9
        assert last is None or row[2] <= last + 1e-9
        last = row[2]


def test_orthogonal_transforms_and_permutations_keep_scores(spark):
    docs, queries = make(5)
    d, q = token_table(spark, docs), token_table(spark, queries, ("qid", "qtok"))
    want = brute(docs, queries, 4)
    turn = stats.random_rotation(12)
    assert np.allclose(turn @ turn.T, np.eye(12))
    order = [int(i) for i in np.random.default_rng(1).permutation(12)]
    for a, b in ((stats.rotate_matrix(d, turn), stats.rotate_matrix(q, turn)), (pruning.reorder(d, order), pruning.reorder(q, order))):
        assert as_dict(scoring.topk(scoring.rounded(scoring.maxsim(a, b)), 4).collect()) == want


def test_edges(spark):
    docs = [(0, [[1, 0]]), (1, [[1, 0]]), (2, [[0, 0]]), (3, [[0, 2], [3, 0]])]
    d, q = token_table(spark, docs), token_table(spark, [(0, [[1, 0]])], ("qid", "qtok"))
    top = scoring.topk(scoring.rounded(scoring.maxsim(d, q)), 10).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in top] == [(3, 3.0), (0, 1.0), (1, 1.0), (2, 0.0)]  # ties by id, fewer rows than k
    assert scoring.maxsim(d.where("false"), q).count() == 0
    packed = scoring.pack_documents(d)
    assert scoring.maxsim_blocks(packed, q.where("false")).count() == 0


@pytest.mark.parametrize(("tokens", "cells"), [(20, 300), (1 << 15, 1 << 23)])
def test_one_pass_search_is_exact_in_every_order_and_with_ties(spark, monkeypatch, tokens, cells):
    monkeypatch.setattr(pruning, "SCAN_TOKENS", tokens)  # small blocks: thresholds and bounds come into play
    monkeypatch.setattr(pruning, "SCAN_CELLS", cells)
    r = np.random.default_rng(8)
    rows = [(d, t, (r.standard_normal(12) * 0.8 ** np.arange(12)).tolist()) for d in range(60) for t in range(1 + d % 5)]
    rows += [(100 + d, t, v) for d, t, v in rows if d < 8]  # equal documents: the smaller id goes first
    docs = spark.createDataFrame(rows, "doc_id long, tok int, vec array<double>")
    asked = spark.createDataFrame([(q, t, (r.standard_normal(12) * 0.8 ** np.arange(12)).tolist(), r.permutation(12).tolist() if q % 2 else None) for q in range(6) for t in range(3)], "qid long, qtok int, vec array<double>, order array<int>")
    first = asked.groupBy("qid").agg(F.min_by("order", "qtok").alias("order"))
    asked = asked.drop("order").join(first, "qid")
    want = sorted(scoring.topk(scoring.rounded(scoring.maxsim(docs, asked)), 9).collect())
    packed = scoring.pack_documents(docs).coalesce(1)
    for dense, warm in ((0.5, 0), (1.1, 0), (0.0, 0), (0.5, 6)):
        assert sorted(pruning.pruned_topk(packed, asked, 9, [3, 6, 9, 12], warm, dense).collect()) == want
    assert pruning.pruned_topk(packed, asked.where("false"), 9, [12]).count() == 0


def test_width_is_the_commonest(spark):
    rows = [(0, None), (1, [1.0]), (2, [1.0, 2.0]), (3, [3.0, 4.0]), (4, []), (5, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    assert sorted(r.id for r in tokens.validate(df).collect()) == [2, 3]
    assert tokens.validate(df.where("id in (0, 4)")).count() == 0


def test_validate_rejects_bad_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    assert [r.id for r in tokens.validate(df).collect()] == [0]


def test_checkpoints():
    assert tokens.checkpoints(128) == [4, 12, 20, 32, 48, 64, 96, 128]
    assert tokens.checkpoints(64) == [4, 12, 20, 32, 48, 64]
    assert tokens.checkpoints(10, (4,)) == [4, 8, 10]


def test_early_termination_is_exact(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((80, 8)) * 0.6 ** np.arange(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
    queries = vectors.where("vec_id < 5").selectExpr("vec_id AS qid", "vec")
    want = {i: np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:3].tolist() for i in range(5)}
    for found in (knn.exact(vectors, queries, 3), knn.exact_blocks(vectors, queries, 3, limit=128), knn.early_termination(vectors, queries, 3, [2, 4, 8])[0]):
        got = {}
        for row in found.orderBy("qid", "rank").collect():
            got.setdefault(row.qid, []).append(row.vec_id)
        assert got == want
    work = knn.early_termination(vectors, queries, 3, [2, 4, 8])[1].agg(F.max("fraction")).first()[0]
    assert work < 1


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "qid int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (1, 99, 1), (2, 5, 1), (3, 1, 1)], "qid int, doc_id int, rel int")
    value = lambda df, c: {r.qid: round(r[c], 4) for r in df.collect()}
    assert value(metrics.recall_at(run, qrels, 10), "recall") == {1: 0.6667, 2: 0.0, 3: 0.0}
    assert value(metrics.mrr_at(run, qrels, 10), "mrr") == {1: 0.5, 2: 0.0, 3: 0.0}
    assert value(metrics.map_at(run, qrels, 10), "map") == {1: round((1 / 2 + 2 / 3) / 3, 4), 2: 0.0, 3: 0.0}
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert value(metrics.ndcg_at(run, qrels, 10), "ndcg")[1] == round((1 / np.log2(3) + 0.5) / ideal, 4)


def test_index_with_all_probes_is_exact(spark):
    docs, queries = make(7)
    d, q = token_table(spark, docs), token_table(spark, queries, ("qid", "qtok"))
    centres = index.kmeans_centroids(d, 4)
    found = index.probe(index.assign(d, centres), d, centres, q, 4, 1000, 3)
    assert as_dict(found.collect()) == brute(docs, queries, 3)
    coded = index.encode_residuals(index.assign(d, centres), centres, low=-2, high=2, bits=8)
    again = index.decode_residuals(coded, centres, low=-2, high=2, bits=8).join(d.withColumnRenamed("vec", "own"), ["doc_id", "tok"])
    assert again.select(F.sqrt(V.squared_l2("vec", "own")).alias("e")).agg(F.max("e")).first()[0] < 0.05
    assert index.partitions_for(1_191_618) == 16384


def test_sources_and_sinks(spark, tmp_path):
    d = token_table(spark, make(8, docs=3)[0])
    path = str(tmp_path / "x_doc_embs.parquet")
    assert tokens.read_cache(spark, path) is None
    tokens.write_cache(d, path)
    assert tokens.read_cache(spark, path, d).count() == d.count()
    assert tokens.read_cache(spark, path, d.where("doc_id > 0")) is None
    assert tokens.list_caches(spark, str(tmp_path)) == ["x"]
    (tmp_path / "r.csv").write_text("dataset,ivf_nprobe,recall,avg\na,32,0.9,oops\na,64,0.95,2.5\n")
    one = corpora.read_report(spark, "L", str(tmp_path / "r.csv"))
    assert corpora.read_report(spark, "L", str(tmp_path / "none.csv")) is None
    rows = corpora.union_reports([one, None]).orderBy("ivf_nprobe").collect()
    assert [(r.label, r.ivf_nprobe, r.avg) for r in rows] == [("L", 32, None), ("L", 64, 2.5)]
    assert corpora.rows_by_file(spark, str(tmp_path / "*.csv")).collect()[0]["count"] == 2
    (tmp_path / "m.json").write_text('{\n"num_embeddings": 6, "avg_doclen": 2.0\n}')
    (tmp_path / "l.json").write_text("[1, 2, 3]")
    found = corpora.check_metadata(corpora.read_metadata(spark, str(tmp_path / "m.json")), corpora.read_doc_lengths(spark, str(tmp_path / "l.json"))).first()
    assert found.consistent and found.docs == 3
    made = []
    for _ in range(2):
        harness.step(spark, str(tmp_path / "step"), lambda: made.append(1) or spark.range(3))
    assert made == [1]
    corpora.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    corpora.write_index(d.withColumn("centroid", F.col("doc_id")), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).where("centroid = 1").count() == d.where("doc_id = 1").count()


def test_load_dataset(spark, tmp_path):
    spark.createDataFrame([("d1", " T", "x \n"), ("d2", "", "y")], "_id string, title string, text string").write.parquet(str(tmp_path / "c.parquet"))
    spark.createDataFrame([("q1", "a"), ("q2", "b")], "_id string, text string").write.parquet(str(tmp_path / "q.parquet"))
    spark.createDataFrame([("q1", "d1", 1)], "`query-id` string, `corpus-id` string, score int").write.parquet(str(tmp_path / "r.parquet"))
    docs, queries, qrels = corpora.load_dataset(spark, *(str(tmp_path / f"{n}.parquet") for n in "cqr"))
    assert {(r.doc_id, r.text) for r in docs.collect()} == {("d1", "T x"), ("d2", "y")}
    assert [r.qid for r in queries.collect()] == ["q1"]
    assert corpora.qrels_map(qrels).first().judged == {"d1": 1}


def test_small_reports(spark):
    assert report.sweep_points([10, 50, 100], 60) == [10, 50, 60]
    assert V.sampling_ratio(64, 64, 2.0) == 1.0 and V.confidence(0, 64, 0.5) == 1.0
    assert harness.sample(spark.range(100), "id", 7).count() == 7
    assert set(harness.timings(lambda: spark.range(3), repeats=2)) == {"min", "median"}
