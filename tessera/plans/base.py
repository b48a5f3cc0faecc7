"""Registration of queries with their SQL, and the tables and SQL views that they share."""

from __future__ import annotations

from tessera.sources import tokens

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark, sf_dir, aniso=None):
    """(document tokens, query tokens)."""
    return tokens.from_vectors(tokens.validate(read(spark, sf_dir, "embeddings"), "embedding"), aniso)


def qrels(spark, sf_dir):
    return tokens.label_qrels(*tables(spark, sf_dir))


RATE = 0.9


def views(aniso: bool = False) -> str:
    """CTEs vecs, doc_tokens, query_tokens and qrels; with the anisotropic variant of the vectors if asked."""
    vec = "embedding::DOUBLE[]"
    if aniso:
        decayed = f"list_transform(embedding::DOUBLE[], lambda x, i: x * power({RATE}::DOUBLE, i - 1))"
        vec = f"list_transform({decayed}, lambda y: y / sqrt(list_inner_product({decayed}, {decayed})))"
    return f"""
    vecs AS (SELECT vec_id, label, {vec} AS vec FROM embeddings),
    doc_tokens AS (SELECT vec_id // 10 AS doc_id, (vec_id % 10)::INT AS tok, label, vec FROM vecs WHERE vec_id % 10 < 6 + (vec_id // 10) % 4),
    query_tokens AS (SELECT vec_id // 50 AS qid, ((vec_id % 50) // 10)::INT AS qtok, label, vec FROM vecs WHERE vec_id % 10 = 9),
    qrels AS (SELECT q.qid, d.doc_id, 1::INT AS rel FROM query_tokens q JOIN doc_tokens d ON q.label = d.label AND q.qtok = 0 AND d.tok = 0)
    """


def scores_sql(name="scores", q="q.vec", d="d.vec", score="score") -> str:
    """CTE of unrounded scores by qid and doc_id."""
    return f"""
    {name} AS (
        SELECT qid, doc_id, sum(best) AS {score}
        FROM (SELECT q.qid, d.doc_id, q.qtok, max(list_inner_product({q}, {d})) AS best FROM query_tokens q, doc_tokens d GROUP BY ALL)
        GROUP BY ALL
    )"""


def topk_sql(k: int, source="scores") -> str:
    """SELECT of qid, rank, doc_id, score: the k best rounded scores."""
    return f"""
    SELECT qid, rank::INT AS rank, doc_id, score FROM (
        SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
        FROM (SELECT qid, doc_id, round(score, 6) AS score FROM {source})
    ) WHERE rank <= {k}"""


def exact_sql(k: int, aniso=False) -> str:
    return f"WITH {views(aniso)}, {scores_sql()} {topk_sql(k)}"
