"""The chain's fit is bounded in bytes, whatever the labelled texts' length."""

import numpy as np

from tessera.llm import toxicity


def fitted(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    return toxicity.fit_chain(docs, labels, ("toxic",), folds=2, **kw)


def test_long_texts_are_left_out_of_the_fit(spark):
    rows = [(i, f"{'nasty foul' if i % 2 else 'kind words'} here number{i}") for i in range(40)]
    long = [(100 + i, " ".join("q" + "".join(chr(97 + int(x)) for x in f"{k:07d}") for k in range(50_000))) for i in range(2)]  # 450 kB each
    plain, bounded, whole = fitted(spark, rows), fitted(spark, rows + long, sample_bytes=300_000), fitted(spark, rows + long)
    assert np.array_equal(plain.lexicon.keys, bounded.lexicon.keys) and np.allclose(plain.weights[0], bounded.weights[0])
    assert len(whole.lexicon.keys) > 10 * len(plain.lexicon.keys)
    one = fitted(spark, rows + long, sample_bytes=700_000)  # room for one of them, whose words then are its own
    assert len(one.lexicon.keys) < len(whole.lexicon.keys)
    assert not len(fitted(spark, long, sample_bytes=10).lexicon.keys)


def test_a_settled_table_leaves_nothing_else(spark):
    from tessera.llm import storage

    before = [*storage._made]
    inner = []

    def make():
        inner.append(storage.materialize(spark.range(5)))
        return inner[0].selectExpr("id + 1 AS id")

    out = storage.settle(spark, make)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5] and len(storage._made) == len(before) + 1
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in inner[0].inputFiles())
