"""The corpus pipeline against plain code over a small table."""

from collections import Counter
from fractions import Fraction

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tessera.llm import packing, pii, queries
from tests.llm.test_near_dedup import similarity, slow_sets
from tests.llm.test_scoring_ops import check_packing

SF = "/root/testdata/sf0.001"


def slow_groups(texts):
    """The smallest id of each text's component, by the Jaccard similarity of all pairs of shingle sets."""
    sets, parent = slow_sets({i: t.lower() for i, t in texts.items()}), {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and similarity(sets[a], sets[b]) >= Fraction(4, 5):
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()} if low != high else parent
    return parent


def test_run_equals_plain_code(spark, tmp_path):
    """Toxicity by the operator (a classifier); everything after it by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    texts = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
    groups = slow_groups(texts)
    first = {i: texts[i] for i in sorted(set(groups.values()))}
    detector = pii.fit_detector(kept.join(spark.createDataFrame([(i,) for i in first], "doc_id long"), "doc_id"))
    clean = [(i, pii.mask(t, detector.spans(t)[1])) for i, t in first.items()]
    check_packing(corpus_pipeline.run(spark, SF).collect(), clean)


def test_stages_of_odd_rows(spark, tmp_path):
    rows = [(1, "same text here now ok"), (1, "same text here now ok"), (2, "same text here now ok"), (3, None), (4, ""), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS LONG) AS n_chars")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            assert Counter(r.doc_id for r in docs.collect()) == {1: 1, 3: 1, None: 1}
    assert seen == [7, 3, 3, 3]


def test_stages_of_clashing_columns_and_empty_tables(spark, odd_docs):
    """Columns with the names that stages add come through as they are; an empty table stays empty."""
    names = ["copies", "copy", "own", "node", "keys", "n", "first", "is_toxic", "p_toxic", "is_low_quality", "p_low_quality", "a.b"]
    docs = odd_docs.withColumns({c: F.lit(f"clash {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"clash {c}" for r in rows for c in names), name
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs.where("false"), SF).count() == 0


def test_long_text_comes_through_whole(spark):
    words = " ".join(f"w{i}" for i in range(400_000))  # 2.7 MB
    docs = spark.createDataFrame([(1, words), (2, f"{words} more"), (3, "short one")], "doc_id long, text string").selectExpr("doc_id", "text", "length(text) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == {1, 3}
    check_packing(pieces, [(1, words), (3, "short one")])


def test_stage_order_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert packing.LENGTH == 2048 and public_tokenizers.path("word_bpe_49k.json") and F
