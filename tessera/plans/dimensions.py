"""Queries on statistics and orders of dimensions, layouts and rank correlation."""

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import layout
from tessera.operators import scoring as S
from tessera.operators import stats
from tessera.plans.base import query, read, scores_sql, tables, views
from tessera.sources import tokens

LONG = """
    long AS (SELECT doc_id, tok, dim::INT AS dim, vec[dim + 1] AS x FROM doc_tokens, range(0, 64) t(dim)),
    qlong AS (SELECT qid, qtok, dim::INT AS dim, vec[dim + 1] AS x FROM query_tokens, range(0, 64) t(dim)),
    vars AS (SELECT dim, var_pop(x) AS variance FROM long GROUP BY dim),
    mu AS (SELECT dim, avg(x) AS mean FROM long GROUP BY dim)
"""
WITH = f"WITH {views()}, {LONG}"


@query(f"{WITH} SELECT dim, round(variance, 9) AS variance FROM vars")
def dim_variance(spark, sf_dir):
    """F1, E13."""
    return stats.variances(tables(spark, sf_dir)[0]).select("dim", F.round("variance", 9).alias("variance"))


@query(f"{WITH} SELECT (row_number() OVER (ORDER BY round(variance, 9) DESC, dim) - 1)::INT AS pos, dim FROM vars")
def order_variance(spark, sf_dir):
    """F2, J2."""
    return stats.ranked(stats.variances(tables(spark, sf_dir)[0]), "variance").select("pos", "dim")


CUM = f"""{WITH}, r AS (SELECT row_number() OVER (ORDER BY round(variance, 9) DESC, dim) AS k, dim, variance FROM vars)
    SELECT k, sum(variance) OVER (ORDER BY k) / sum(variance) OVER () AS share FROM r"""


@query(f"SELECT k::INT AS k, round(share, 6) AS share FROM ({CUM}) WHERE k IN (1, 2, 4, 8, 16, 32, 64)")
def cum_variance(spark, sf_dir):
    """budgets above the width are cut to it."""
    return stats.variance_at(tables(spark, sf_dir)[0], [1, 2, 4, 8, 16, 32, 64, 128], 64).select("k", F.round("share", 6).alias("share"))


@query(
    f"""WITH {views()}, n AS (SELECT sqrt(list_inner_product(vec, vec)) AS n FROM doc_tokens)
    SELECT round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm,
        stddev_pop(n) <= 0.01 AND abs(avg(n) - 1) <= 0.05 AS unit_norm FROM n"""
)
def norm_stats(spark, sf_dir):
    """F5, E4."""
    report = tokens.norm_report(tables(spark, sf_dir)[0])
    return report.select(*(F.round(c, 6).alias(c) for c in report.columns[:4]), "unit_norm")


@query(f"{WITH} SELECT dim, round(mean, 9) AS mean FROM mu")
def corpus_mean(spark, sf_dir):
    """F6."""
    return stats.means(tables(spark, sf_dir)[0]).select("dim", F.round("mean", 9).alias("mean"))


@query(f"{WITH} SELECT qid, dim, round(avg(x * x), 9) AS importance FROM qlong GROUP BY ALL")
def q_importance(spark, sf_dir):
    """F7."""
    return stats.query_importance(tables(spark, sf_dir)[1]).select("qid", "dim", F.round("importance", 9).alias("importance"))


@query(f"{WITH} SELECT dim, round(sum(x * x), 9) AS importance FROM qlong GROUP BY ALL")
def global_importance(spark, sf_dir):
    """F8."""
    return stats.global_importance(tables(spark, sf_dir)[1]).select("dim", F.round("importance", 9).alias("importance"))


@query(f"{WITH} SELECT qid, dim, round(sum((x - mean) * (x - mean)), 9) AS importance FROM qlong JOIN mu USING (dim) GROUP BY ALL")
def centred_importance(spark, sf_dir):
    """F9."""
    docs, queries = tables(spark, sf_dir)
    return stats.centred_importance(queries, stats.means(docs)).select("qid", "dim", F.round("importance", 9).alias("importance"))


@query(f"{WITH} SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(avg(x * x), 9) DESC, dim) - 1)::INT AS pos, dim FROM qlong GROUP BY qid, dim")
def order_q2(spark, sf_dir):
    """J3, E11."""
    return stats.ranked(stats.query_importance(tables(spark, sf_dir)[1]), "importance", "qid").select("qid", "pos", "dim")


@query(f"{WITH} SELECT (row_number() OVER (ORDER BY round(sum(x * x), 9) DESC, dim) - 1)::INT AS pos, dim FROM qlong GROUP BY dim")
def order_global_q2(spark, sf_dir):
    """J4."""
    return stats.ranked(stats.global_importance(tables(spark, sf_dir)[1]), "importance").select("pos", "dim")


DTM = f"{WITH}, r AS (SELECT qid, dim, row_number() OVER (PARTITION BY qid ORDER BY round(abs(x - mean), 9) DESC, dim) - 1 AS pos FROM qlong JOIN mu USING (dim) WHERE qtok = 0)"


@query(f"{DTM} SELECT qid, pos::INT AS pos, dim FROM r")
def order_dtm(spark, sf_dir):
    """Single-vector queries (first tokens), by distance to the mean."""
    docs, queries = tables(spark, sf_dir)
    return stats.far_from_mean(queries.where("qtok = 0"), stats.means(docs), "qid").select("qid", "pos", "dim")


@query(f"{DTM} SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY (pos >= 16), dim) - 1)::INT AS pos, dim FROM r")
def order_dtm_improved(spark, sf_dir):
    """The farthest quarter first, each part by dimension."""
    docs, queries = tables(spark, sf_dir)
    return stats.head_sorted(stats.far_from_mean(queries.where("qtok = 0"), stats.means(docs), "qid"), 16)


@query(
    f"""{WITH}, i AS (SELECT qid, dim, round(sum((x - mean) * (x - mean)), 9) AS importance FROM qlong JOIN mu USING (dim) GROUP BY ALL),
    r AS (SELECT qid, dim, row_number() OVER (PARTITION BY qid ORDER BY importance DESC, dim) - 1 AS pos FROM i)
    SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY (pos >= 16), dim) - 1)::INT AS pos, dim FROM r"""
)
def order_block_aware(spark, sf_dir):
    """J7."""
    docs, queries = tables(spark, sf_dir)
    return stats.head_sorted(stats.ranked(stats.centred_importance(queries, stats.means(docs)), "importance", "qid"), 16)


@query(
    f"""WITH {views()} SELECT qid, qtok,
        list_transform(list_sort(list_transform(vec, lambda x, i: {{'k': -x, 'i': i - 1}})), lambda p: p.i::INT) AS by_value,
        list_transform(range(63, -1, -1), lambda i: round(vec[i + 1], 6)) AS reversed
    FROM query_tokens"""
)
def array_orders(spark, sf_dir):
    """Argsort and gather inside one array column."""
    _, queries = tables(spark, sf_dir)
    back = F.sequence(F.lit(63), F.lit(0), F.lit(-1))
    return queries.select("qid", "qtok", V.argsort_desc("vec").alias("by_value"), F.transform(V.gather("vec", back), lambda x: V.signed_round(x)).alias("reversed"))


@query("SELECT vec_id // 64 AS block_id, dim::INT AS dim, list(round(embedding[dim + 1]::DOUBLE, 6) ORDER BY vec_id) AS \"column\" FROM embeddings, range(0, 64) t(dim) GROUP BY ALL")
def layout_blocked(spark, sf_dir):
    """K1, K2, DM5: blocks of 64 vectors; the short last block is kept."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("vec"))
    return layout.blocked(vectors, 64)


@query(f"{WITH} SELECT doc_id, dim, list(round(x, 6) ORDER BY tok) AS \"column\" FROM long GROUP BY ALL")
def layout_per_doc(spark, sf_dir):
    """K3, DM7."""
    return layout.per_document(tables(spark, sf_dir)[0])


@query("SELECT vec_id, dim::INT AS dim, round(embedding[dim + 1]::DOUBLE, 6) AS x FROM embeddings, range(0, 64) t(dim)")
def layout_dim_major(spark, sf_dir):
    """K4, DM6."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("vec"))
    return layout.dimension_major(vectors).withColumn("x", V.signed_round("x"))


RHO = f"""WITH {views()}, {scores_sql('a', 'q.vec[1:32]', 'd.vec[1:32]')}, {scores_sql('b')},
    ra AS (SELECT qid, doc_id, rank() OVER (PARTITION BY qid ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY qid, round(score, 9)) - 1) / 2 AS x FROM a),
    rb AS (SELECT qid, doc_id, rank() OVER (PARTITION BY qid ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY qid, round(score, 9)) - 1) / 2 AS y FROM b)
    SELECT qid, corr(x, y) AS rho FROM ra JOIN rb USING (qid, doc_id) GROUP BY qid"""


def _rho(spark, sf_dir):
    docs, queries = tables(spark, sf_dir)
    return stats.spearman(S.maxsim(docs, queries, dims=32), S.maxsim(docs, queries))


@query(f"SELECT qid, round(rho, 6) AS rho FROM ({RHO})")
def spearman_partial_vs_full(spark, sf_dir):
    """F11."""
    return _rho(spark, sf_dir).select("qid", F.round("rho", 6).alias("rho"))


@query(f"SELECT round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.75), 6) AS q75 FROM ({RHO})")
def spearman_summary(spark, sf_dir):
    """F12."""
    found = stats.quartiles(_rho(spark, sf_dir), "rho")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(f"WITH {views()}, n AS (SELECT doc_id, count(*) AS n_tok FROM doc_tokens GROUP BY ALL) SELECT count(*) AS docs, sum(n_tok)::BIGINT AS tokens, avg(n_tok) AS mean_length FROM n")
def doc_lengths(spark, sf_dir):
    """F15, DM9."""
    return stats.token_counts(tables(spark, sf_dir)[0]).agg(F.count("*").alias("docs"), F.sum("n_tok").alias("tokens"), F.avg("n_tok").alias("mean_length"))


@query(
    f"""{WITH}, s AS (SELECT label % 2 AS half, dim::INT AS dim, var_pop(vec[dim + 1]) AS v FROM doc_tokens, range(0, 64) t(dim) GROUP BY ALL)
    SELECT half, {', '.join(f'round(max(v) FILTER (dim = {z}), 9) AS "{z}"' for z in range(64))} FROM s GROUP BY half"""
)
def pivot_variance(spark, sf_dir):
    """One row a group, one column a dimension."""
    from tessera.operators.report import pivot_shares

    rows = tables(spark, sf_dir)[0].withColumn("half", F.col("label") % 2).select("half", F.posexplode("vec").alias("dim", "x"))
    variances = rows.groupBy("half", "dim").agg(F.round(F.var_pop("x"), 9).alias("v"))
    return pivot_shares(variances, "half", "dim", list(range(64)), "v")
