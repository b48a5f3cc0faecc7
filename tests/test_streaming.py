from tessera.operators import scoring
from tessera.streaming.scorer import score_stream
from tests.test_operators import as_dict, brute, make, token_table


def test_streamed_queries_get_exact_results(spark, tmp_path):
    docs, queries = make(9)
    q = token_table(spark, queries, ("qid", "qtok"))
    q.coalesce(1).write.parquet(str(tmp_path / "in"))
    packed = scoring.pack_documents(token_table(spark, docs))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, packed, 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert as_dict(spark.read.parquet(str(tmp_path / "out")).collect()) == brute(docs, queries, 3)
