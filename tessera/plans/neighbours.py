"""Queries on single-vector search, partitioned indexes and retrieval quality."""

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import index as I
from tessera.operators import knn, metrics, stats
from tessera.operators import scoring as S
from tessera.operators import stored_index as SI
from tessera.plans.base import exact_sql, qrels, query, read, scores_sql, tables, topk_sql, views
from tessera.sources import tokens
from tessera.sources.stages import cut_lineage, keep

K = 10
STEPS = [16, 32, 48, 64]


def _vectors(spark, sf_dir):
    rows = tokens.validate(read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "label", V.doubles("embedding").alias("vec"))
    return rows, rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "vec")


PAIRS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT vec_id AS qid, x AS q FROM v WHERE vec_id % 25 = 0),
    s AS (SELECT qid, vec_id, list_sum(list_transform(list_zip(q, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l2, list_inner_product(q, x) AS ip FROM q, v)"""


def _top(value, order, source="s", k=K):
    return f"""SELECT qid, rank::INT AS rank, vec_id, score FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score {order}, vec_id) AS rank
        FROM (SELECT qid, vec_id, round({value}, 6) AS score FROM {source})) WHERE rank <= {k}"""


L2 = f"{PAIRS} {_top('l2', 'ASC')}"


@query(L2)
def knn_l2(spark, sf_dir):
    """Exact nearest neighbours by distances from differences, blocks sieved by products."""
    return knn.nearest(*_vectors(spark, sf_dir), K)


@query(L2)
def knn_l2_blocks(spark, sf_dir):
    """L1: the same by matrix products."""
    return knn.exact_blocks(*_vectors(spark, sf_dir), K)


@query(f"{PAIRS} {_top('ip', 'DESC')}")
def knn_ip(spark, sf_dir):
    """L2: largest inner products."""
    return knn.exact(*_vectors(spark, sf_dir), K, "ip")


@query(L2)
def knn_l2_early_term(spark, sf_dir):
    """Early termination that loses nothing."""
    return knn.early_termination(*_vectors(spark, sf_dir), K, STEPS)[0]


def early_sql(alpha: float | None, steps=STEPS, width=64) -> str:
    """CTEs of early termination: last<i> holds every pair with its partial distance, dims scanned and state."""
    part = lambda a, b: f"list_sum(list_transform(list_zip(q[{a + 1}:{b}], x[{a + 1}:{b}]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = [
        f"f AS (SELECT qid, vec_id, q, x, round({part(0, steps[0])}, 9) AS first, round({part(0, width)}, 9) AS whole FROM q, v)",
        f"tau AS (SELECT qid, max(whole) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first, vec_id) AS rn FROM f) WHERE rn <= {K} GROUP BY qid)",
        "last AS (SELECT qid, vec_id, q, x, tau, 0.0::DOUBLE AS part, 0 AS scanned, false AS dead FROM f JOIN tau USING (qid))",
    ]
    before, at = "last", 0
    for i, k in enumerate(steps):
        ratio = 1.0 if alpha is None else V.sampling_ratio(k, width, alpha)
        out.append(f"step{i} AS (SELECT qid, vec_id, q, x, tau, dead, CASE WHEN dead THEN part ELSE part + {part(at, k)} END AS part, CASE WHEN dead THEN scanned ELSE scanned + {k - at} END AS scanned FROM {before})")
        out.append(f"last{i} AS (SELECT * REPLACE (dead OR round(part, 9) > tau * {ratio!r}::DOUBLE + 1e-9 AS dead) FROM step{i})")
        before, at = f"last{i}", k
    return PAIRS.split(",\n    s AS")[0] + ", " + ", ".join(out)


LAST = f"last{len(STEPS) - 1}"


@query(L2)
def knn_l2_scan(spark, sf_dir):
    """The same by scanning dimensions under a threshold that runs from block to block."""
    return knn.scanned(knn.scan(*_vectors(spark, sf_dir), K, STEPS), K, STEPS[-1])[0]


@query(f"{early_sql(1.5)} {_top('part', 'ASC', f'(SELECT * FROM {LAST} WHERE NOT dead)')}")
def knn_ads_ratio(spark, sf_dir):
    """Early termination with the adaptive-sampling ratio."""
    return knn.early_termination(*_vectors(spark, sf_dir), K, STEPS, alpha=1.5)[0]


@query(f"{early_sql(None)} SELECT qid, sum(scanned)::BIGINT AS dims, round(sum(scanned) / (count(*) * 64), 6) AS fraction FROM {LAST} GROUP BY qid")
def knn_scanned_dims(spark, sf_dir):
    """Dimensions scanned."""
    return knn.early_termination(*_vectors(spark, sf_dir), K, STEPS)[1].select("qid", "dims", F.round("fraction", 6).alias("fraction"))


ALPHAS = [0.0, 1.0, 2.0, 4.0]


def _alpha_sql():
    picks = []
    for a in ALPHAS:
        found = f"SELECT qid, vec_id, 1 AS hit FROM ({_top('part', 'ASC', f'(SELECT * FROM {LAST} WHERE NOT dead)')})"
        work = f"SELECT avg(fraction) AS work FROM (SELECT qid, sum(scanned) / (count(*) * 64) AS fraction FROM {LAST} GROUP BY qid)"
        inner = early_sql(a)
        recall = f"SELECT avg(recall) AS recall FROM (SELECT t.qid, count(hit) / {K} AS recall FROM ({L2}) t LEFT JOIN ({found}) f USING (qid, vec_id) GROUP BY t.qid)"
        picks.append(f"SELECT {a}::DOUBLE AS knob, round(recall, 6) AS recall, round(work, 6) AS work FROM ({inner} SELECT * FROM ({recall}), ({work}))")
    return " UNION ALL ".join(picks)


def _alpha_points(spark, sf_dir):
    return knn.alpha_sweep(*_vectors(spark, sf_dir), K, STEPS, ALPHAS)


@query(_alpha_sql())
def knn_alpha_sweep(spark, sf_dir):
    """Recall and work for a grid of sampling parameters."""
    return _alpha_points(spark, sf_dir)


@query(
    f"""WITH p AS ({_alpha_sql()}) SELECT target, coalesce((SELECT knob FROM p WHERE recall >= target ORDER BY work, knob LIMIT 1), (SELECT knob FROM p ORDER BY recall DESC, knob LIMIT 1)) AS knob
    FROM (SELECT unnest([0.5, 0.9, 1.0])::DOUBLE AS target)"""
)
def knn_alpha_pick(spark, sf_dir):
    """The parameter with least work that reaches a target, else the one with most recall."""
    points, out = cut_lineage(_alpha_points(spark, sf_dir)), None
    for target in (0.5, 0.9, 1.0):
        one = knn.knob_pick(points.withColumn("target", F.lit(target)), target, "target")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{PAIRS}, r AS ({_top('ip', 'DESC', k=1)}) SELECT avg((qid = vec_id)::INT) AS recall_at_1 FROM r")
def knn_self_match(spark, sf_dir):
    """L9, D5."""
    return knn.self_match(*_vectors(spark, sf_dir))


CENTRES = """centres AS (SELECT label AS centroid, list(x ORDER BY dim) AS cv FROM (
        SELECT label, dim, round(avg(vec[dim + 1]), 9) AS x FROM doc_tokens, range(0, 64) t(dim) GROUP BY ALL) GROUP BY label),
    assigned AS (SELECT doc_id, tok, vec, centroid FROM (SELECT doc_id, tok, vec, centroid,
        row_number() OVER (PARTITION BY doc_id, tok ORDER BY round(list_inner_product(vec, cv), 6) DESC, centroid) AS rn FROM doc_tokens, centres) WHERE rn = 1)"""
CODE = "list_transform(list_zip(vec, cv), lambda p: least(greatest(floor((round(p[1] - p[2], 9) + 0.5) / 0.0625), 0), 15)::INT)"


@query(f"WITH {views()}, {CENTRES} SELECT doc_id, tok, centroid FROM assigned")
def ivf_assign(spark, sf_dir):
    """M1: every token vector in the list of its nearest centroid (means by label)."""
    docs, _ = tables(spark, sf_dir)
    return I.assign(docs, I.mean_centroids(docs, "label")).select("doc_id", "tok", "centroid")


@query(f"WITH {views()}, {CENTRES} SELECT doc_id, tok, centroid, list_sum(codes)::BIGINT AS code_sum, codes[1] AS code_0, codes[64] AS code_63 FROM (SELECT doc_id, tok, centroid, {CODE} AS codes FROM assigned JOIN centres USING (centroid))")
def residual_bucket(spark, sf_dir):
    """M3: four-bit residual codes, by their sum and two of them."""
    docs, _ = tables(spark, sf_dir)
    centres = I.mean_centroids(docs, "label")
    coded = I.encode_residuals(I.assign(docs, centres), centres)
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x)
    return coded.select("doc_id", "tok", "centroid", total.alias("code_sum"), F.get("codes", F.lit(0)).alias("code_0"), F.get("codes", F.lit(63)).alias("code_63"))


PROBES, CANDIDATES = 3, 20


@query(
    f"""WITH {views()}, {CENTRES},
    probes AS (SELECT qid, qtok, vec AS q, centroid FROM (SELECT *, row_number() OVER (PARTITION BY qid, qtok ORDER BY round(list_inner_product(vec, cv), 6) DESC, centroid) AS rn FROM query_tokens, centres) WHERE rn <= {PROBES}),
    rough AS (SELECT qid, doc_id, round(sum(b), 6) AS score FROM (SELECT qid, doc_id, qtok, max(list_inner_product(q, a.vec)) AS b FROM probes JOIN assigned a USING (centroid) GROUP BY ALL) GROUP BY ALL),
    best AS (SELECT qid, doc_id FROM rough QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= {CANDIDATES}),
    {scores_sql()}, kept AS (SELECT * FROM scores SEMI JOIN best USING (qid, doc_id)) {topk_sql(K, 'kept')}"""
)
def ivf_probe_topk(spark, sf_dir):
    """M2: probe three lists a token, score roughly, rescore the best twenty documents exactly."""
    docs, queries = tables(spark, sf_dir)
    centres = I.mean_centroids(docs, "label")
    return I.probe(I.assign(docs, centres), docs, centres, queries, PROBES, CANDIDATES, K)


LISTS = f"""{PAIRS}, centres AS (SELECT label AS centroid, list(c ORDER BY dim) AS cv FROM (SELECT label, dim, round(avg(x[dim + 1]), 9) AS c FROM v, range(0, 64) t(dim) GROUP BY ALL) GROUP BY label),
    a AS (SELECT vec_id, x, centroid FROM v, centres QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(x, cv), 6) DESC, centroid) = 1),
    p AS (SELECT qid, q, centroid FROM q, centres QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_inner_product(q, cv), 6) DESC, centroid) <= 2),
    h AS (SELECT qid, vec_id, q, x, list_sum(list_transform(list_zip(q, x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS l2 FROM p JOIN a USING (centroid))
    {_top('l2', 'ASC', 'h')}"""


def _lists(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir)
    centres = I.mean_centroids(vectors, "label")
    lists = I.nearest(vectors, centres, 1, "vec_id").drop("rank").join(vectors.select("vec_id", "vec"), "vec_id")
    return lists, centres, queries


@query(LISTS)
def ivf_linear_scan(spark, sf_dir):
    """M4, M8: k-NN over the lists of the two nearest centroids."""
    return I.linear_scan(*_lists(spark, sf_dir), 2, K)


@query(LISTS)
def ivf_running_scan(spark, sf_dir):
    """L3, M4: the same lists, each query's nearest list first, dimensions scanned under a running threshold."""
    lists, centres, queries = _lists(spark, sf_dir)
    probed = I.nearest(queries, centres, 2, "qid")
    return knn.scanned(knn.scan(lists, queries, K, STEPS, probed=probed), K, STEPS[-1])[0]


@query(LISTS)
def ivf_bond_scan(spark, sf_dir):
    """M7: the same lists, dimensions of most variance first, terminated early without loss."""
    lists, centres, queries = _lists(spark, sf_dir)
    order = stats.as_list(stats.ranked(stats.variances(lists), "variance"))
    return I.early_scan(lists, centres, queries, 2, K, STEPS, order=order)[0]


@query(early_sql(2.0).replace(PAIRS.split(",\n    s AS")[0], LISTS.split(_top("l2", "ASC", "h"))[0].rstrip()).replace("FROM q, v)", "FROM h)") + " " + _top("part", "ASC", f"(SELECT * FROM {LAST} WHERE NOT dead)"))
def ivf_adaptive_scan(spark, sf_dir):
    """M5: the same lists with adaptive sampling."""
    return I.early_scan(*_lists(spark, sf_dir), 2, K, STEPS, alpha=2.0)[0]


CODED = f"""{CENTRES},
    entries AS (SELECT doc_id, tok, centroid, list_transform({CODE}, lambda k: -0.5 + (k + 0.5) * 0.0625) AS residual FROM assigned JOIN centres USING (centroid)),
    probes AS (SELECT qid, qtok, vec AS q, centroid, product FROM (SELECT qid, qtok, vec, centroid, list_inner_product(vec, cv) AS product,
        row_number() OVER (PARTITION BY qid, qtok ORDER BY round(list_inner_product(vec, cv), 6) DESC, centroid) AS rn FROM query_tokens, centres) WHERE rn <= {PROBES}),
    rough AS (SELECT qid, doc_id, round(sum(b), 6) AS score FROM (SELECT qid, doc_id, qtok, max(product + list_inner_product(q, residual)) AS b FROM probes JOIN entries USING (centroid) GROUP BY ALL) GROUP BY ALL)"""


def _label_index(spark, sf_dir):
    """The stored index over the labels' means, built once for all queries of a session."""

    def make():
        docs, _ = tables(spark, sf_dir)
        return SI.build_index(docs, I.mean_centroids(docs, "label"), codec=SI.Codec.even())

    return keep(spark, ("label index", sf_dir), make)


@query(f"WITH {views()}, {CODED} {topk_sql(K, 'rough')}")
def stored_index_topk(spark, sf_dir):
    """A stored index, its probed lists alone read, packed codes scored by look-up."""
    return SI.search_codes(_label_index(spark, sf_dir), tables(spark, sf_dir)[1], PROBES, K)


@query(
    f"""WITH {views()}, {CODED}, best AS (SELECT qid, doc_id FROM rough QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= {CANDIDATES}),
    {scores_sql()}, kept AS (SELECT * FROM scores SEMI JOIN best USING (qid, doc_id)) {topk_sql(K, 'kept')}"""
)
def stored_index_rescored(spark, sf_dir):
    """M2, H3: the same index; its best documents rescored exactly by blocks."""
    docs, queries = tables(spark, sf_dir)
    return SI.search_index(_label_index(spark, sf_dir), S.pack_documents(docs), queries, PROBES, CANDIDATES, K)


@query(f"WITH {views()}, {CENTRES} SELECT count(*) AS num_embeddings, (SELECT count(*) FROM centres) AS num_partitions, count(*) AS held, count(DISTINCT centroid) AS filled, (SELECT max(n) FROM (SELECT count(*) AS n FROM assigned GROUP BY centroid)) AS longest, true AS consistent FROM assigned")
def stored_index_check(spark, sf_dir):
    """The stored metadata against the lists."""
    return SI.check_index(_label_index(spark, sf_dir))


@query(None)
def ivf_kmeans_topk(spark, sf_dir):
    """M1-M3: two-level k-means with as many lists as the size asks for, four-bit residuals by quantiles, exact rescoring."""
    docs, queries = tables(spark, sf_dir)
    lists = I.partitions_for(docs.count())
    index = keep(spark, ("k-means index", sf_dir), lambda: SI.build_index(docs, I.train_centroids(docs, lists)))
    return SI.search_index(index, S.pack_documents(docs), queries, max(8, lists // 16), 5 * K, K)


@query(exact_sql(K))
def ivf_all_probes(spark, sf_dir):
    """M2: probing every list gives the exact result."""
    docs, queries = tables(spark, sf_dir)
    centres = I.mean_centroids(docs, "label")
    sizes = docs.agg(F.countDistinct("label").alias("lists"), F.countDistinct("doc_id").alias("docs")).first()
    return I.probe(I.assign(docs, centres), docs, centres, queries, sizes.lists, sizes.docs, K)


RUN = f"WITH {views()}, {scores_sql()}, run AS ({topk_sql(100)}), rel AS (SELECT qid, count(*) AS n FROM qrels WHERE rel > 0 GROUP BY qid), asked AS (SELECT DISTINCT qid FROM qrels)"


def _hit_sql(k):
    return f"hits AS (SELECT run.qid, rank, rel FROM run JOIN qrels USING (qid, doc_id) WHERE rank <= {k} AND rel > 0)"


def _run(spark, sf_dir):
    return S.topk(S.rounded(S.scores(*tables(spark, sf_dir), 100)), 100), qrels(spark, sf_dir)


@query(f"{RUN}, {_hit_sql(10)} SELECT qid, round(coalesce(h / n, 0), 6) AS recall FROM asked LEFT JOIN (SELECT qid, count(*) AS h FROM hits GROUP BY qid) USING (qid) LEFT JOIN rel USING (qid)")
def recall_at_k(spark, sf_dir):
    """N1."""
    return S.rounded(metrics.recall_at(*_run(spark, sf_dir), 10), "recall")


@query(
    f"""{RUN}, {_hit_sql(10)}, ideal AS (SELECT qid, sum(rel / log2(place + 1)) AS ideal FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels) WHERE place <= 10 GROUP BY qid)
    SELECT qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM asked LEFT JOIN (SELECT qid, sum(rel / log2(rank + 1)) AS dcg FROM hits GROUP BY qid) USING (qid) LEFT JOIN ideal USING (qid)"""
)
def ndcg_at_k(spark, sf_dir):
    """N2."""
    return S.rounded(metrics.ndcg_at(*_run(spark, sf_dir), 10), "ndcg")


@query(
    f"""{RUN}, {_hit_sql(10)}, p AS (SELECT qid, sum(c / rank) AS p FROM (SELECT qid, rank, count(*) OVER (PARTITION BY qid ORDER BY rank) AS c FROM hits) GROUP BY qid)
    SELECT qid, round(coalesce(p / n, 0), 6) AS map FROM asked LEFT JOIN p USING (qid) LEFT JOIN rel USING (qid)"""
)
def map_at_k(spark, sf_dir):
    """N3."""
    return S.rounded(metrics.map_at(*_run(spark, sf_dir), 10), "map")


@query(f"{RUN}, {_hit_sql(10)} SELECT qid, round(coalesce(m, 0), 6) AS mrr FROM asked LEFT JOIN (SELECT qid, 1 / min(rank) AS m FROM hits GROUP BY qid) USING (qid)")
def mrr_at_k(spark, sf_dir):
    """N4."""
    return S.rounded(metrics.mrr_at(*_run(spark, sf_dir), 10), "mrr")


def _evaluate_sql():
    parts = [RUN]
    for k in (10, 100):
        parts.append(f"h{k} AS (SELECT run.qid, rank, rel FROM run JOIN qrels USING (qid, doc_id) WHERE rank <= {k} AND rel > 0)")
        parts.append(f"i{k} AS (SELECT qid, sum(rel / log2(place + 1)) AS ideal FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels WHERE rel > 0) WHERE place <= {k} GROUP BY qid)")
        parts.append(f"g{k} AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg, count(*) AS h FROM h{k} GROUP BY qid)")
    parts.append("p AS (SELECT qid, sum(c / rank) AS p, 1 / min(rank) AS m FROM (SELECT qid, rank, count(*) OVER (PARTITION BY qid ORDER BY rank) AS c FROM h10) GROUP BY qid)")
    mean = lambda x: f"round(avg(coalesce({x}, 0)), 4)"
    picks = [f"{mean(f'g{k}.dcg / i{k}.ideal')} AS ndcg_{k}, {mean(f'g{k}.h / rel.n')} AS recall_{k}" for k in (10, 100)]
    joins = " ".join(f"LEFT JOIN {t} ON {t}.qid = asked.qid" for t in ("rel", "p", "g10", "g100", "i10", "i100"))
    return f"{', '.join(parts)} SELECT {', '.join(picks)}, {mean('p.p / rel.n')} AS map_10, {mean('p.m')} AS mrr_10 FROM asked {joins}"


@query(_evaluate_sql())
def evaluate_run(spark, sf_dir):
    """All metrics in one row."""
    return metrics.evaluate(*_run(spark, sf_dir))
