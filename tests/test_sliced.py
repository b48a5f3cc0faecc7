"""Storage by slices of dimensions: only the columns asked for, only the row groups that can matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pruning, scoring, sliced


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    scale = 0.85 ** np.arange(32)
    rows = [(d, t, (r.normal(size=32) * scale * (0.1 if d < 500 else 1)).tolist()) for d in range(600) for t in range(int(r.integers(1, 6)))]
    asked = [(q, t, (r.normal(size=32) * scale).tolist()) for q in range(8) for t in range(3)]
    return spark.createDataFrame(rows, "doc_id long, tok int, vec array<double>"), spark.createDataFrame(asked, "qid long, qtok int, vec array<double>")


def near(got, want, name):
    a, b = ({(r.qid, r.doc_id): r[name] for r in df.collect()} for df in (got, want))
    return a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in b) < 1e-9


@pytest.mark.parametrize("limit", [scoring.QUERY_BYTES, 2000])
def test_slices_give_the_same_scores_and_bounds(spark, data, limit):
    docs, queries = data
    stored = sliced.store_slices(docs, [4, 8, 32])
    for dims in (4, 8, 32):
        assert near(sliced.partial_scores(stored, queries, dims, limit=limit), scoring.maxsim(docs, queries, dims), "score")
        assert near(sliced.upper_bounds(stored, queries, dims, limit), pruning.upper_scores(docs, queries, dims), "ub")
    packed = {r.doc_id: r.toks for r in scoring.pack_documents(docs).collect()}
    assert {r.doc_id: r.toks for r in sliced.whole_documents(stored).collect()} == packed
    with pytest.raises(ValueError):
        stored.names(5)


@pytest.mark.parametrize("k", [1, 10, 700])
def test_pruned_search_of_slices_is_exact(spark, data, k):
    docs, queries = data
    stored = sliced.store_slices(docs, [4, 8, 32])
    want = scoring.topk(scoring.rounded(scoring.scores(docs, queries)), k).collect()
    assert sorted(sliced.pruned_topk(stored, queries, k, 8).collect()) == sorted(want)


def test_a_scan_reads_its_slices_only(spark, data):
    docs, queries = data
    stored = sliced.store_slices(docs, [4, 8, 32])
    plan = sliced.partial_scores(stored, queries, 8)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "to_4" in read and "to_8" in read and "to_32" not in read and "tail" not in read
    plan = sliced.upper_bounds(sliced.Reaching(spark, stored.path, stored.marks, 0.5), queries, 8)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(reach,0.5)" in plan and "tail_8" in plan and "tail_4" not in plan
    assert sliced.store_slices(docs.where("doc_id < 0"), [4, 32]).table.count() == 0
    assert sliced.pruned_topk(stored, queries.where(F.lit(False)), 3, 8).count() == 0
