"""Queries on bounds and pruning of late-interaction search."""

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import pruning as P
from tessera.operators import scoring as S
from tessera.operators import sliced, stats, sweeps
from tessera.plans.base import exact_sql, qrels, query, scores_sql, tables, topk_sql, views
from tessera.sources import tokens
from tessera.sources.stages import cut_lineage, keep

K = 10
ANISO = 0.9
WIDTH = 64
STEPS = tokens.checkpoints(WIDTH)
ROUNDS = [16, 32, 64]


def bounds_sql(k: int, factor: str = "1.0", name="pairs") -> str:
    """CTE of token pairs with p, u and l after k dimensions, true tail norms."""
    tail = "sqrt(coalesce(list_sum(list_transform({}[%d:64], lambda x: x * x)), 0))" % (k + 1)
    p, r = f"list_inner_product(q.vec[1:{k}], d.vec[1:{k}])", f"{tail.format('q.vec')} * {tail.format('d.vec')} * {factor}"
    return f"{name} AS (SELECT q.qid, q.qtok, d.doc_id, d.tok, {p} AS p, {p} + {r} AS u, {p} - {r} AS l FROM query_tokens q, doc_tokens d)"


def sum_sql(column: str, name: str, source="pairs") -> str:
    return f"{name} AS (SELECT qid, doc_id, sum(b) AS {column} FROM (SELECT qid, doc_id, qtok, max({column[0]}) AS b FROM {source} GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {views()}, {bounds_sql(32)}, {sum_sql('ub', 'b')} SELECT qid, doc_id, round(ub, 6) AS ub FROM b")
def ub_scores_k32(spark, sf_dir):
    """Upper bounds after 32 dimensions."""
    return S.rounded(P.upper_scores(*tables(spark, sf_dir), 32), "ub")


@query(f"WITH {views()}, {bounds_sql(32)}, {sum_sql('lb', 'b')} SELECT qid, doc_id, round(lb, 6) AS lb FROM b")
def lb_scores_k32(spark, sf_dir):
    """Lower bounds after 32 dimensions."""
    return S.rounded(P.lower_scores(*tables(spark, sf_dir), 32), "lb")


EVEN = [*range(0, 64, 2), *range(1, 64, 2)]
_EVEN = "list_concat(list_transform(range(0, 64, 2), lambda i: vec[i + 1]), list_transform(range(1, 64, 2), lambda i: vec[i + 1]))"


@query(
    f"""WITH {views()}, a AS (SELECT * REPLACE ({_EVEN} AS vec) FROM query_tokens), b AS (SELECT * REPLACE ({_EVEN} AS vec) FROM doc_tokens),
    {bounds_sql(32).replace('query_tokens q, doc_tokens d', 'a q, b d')}, {sum_sql('ub', 'c')} SELECT qid, doc_id, round(ub, 6) AS ub FROM c"""
)
def ub_scores_subset(spark, sf_dir):
    """Upper bounds after the 32 even dimensions."""
    docs, queries = tables(spark, sf_dir)
    return S.rounded(P.upper_scores(P.reorder(docs, EVEN), P.reorder(queries, EVEN), 32), "ub")


TIGHT = f"""WITH {views()}, {bounds_sql(32)}, {sum_sql('ub', 'b')}, {scores_sql()},
    t AS (SELECT b.qid, b.doc_id, r.rel IS NOT NULL AS relevant, ub / score AS ratio FROM b JOIN scores USING (qid, doc_id)
        LEFT JOIN qrels r ON r.qid = b.qid AND r.doc_id = b.doc_id WHERE score >= 1e-6)"""


@query(f"{TIGHT} SELECT qid, doc_id, relevant, round(ratio, 6) AS ratio FROM t")
def ub_tightness(spark, sf_dir):
    """Bound over score, by relevance."""
    return S.rounded(P.tightness(*tables(spark, sf_dir), qrels(spark, sf_dir), 32), "ratio")


@query(f"{TIGHT} SELECT relevant, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.95), 6) AS p95 FROM t GROUP BY relevant")
def ub_tightness_medians(spark, sf_dir):
    """F13, F14."""
    rows = P.tightness(*tables(spark, sf_dir), qrels(spark, sf_dir), 32)
    return stats.medians(rows, "ratio", "relevant").select("relevant", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


ORACLE = f"""WITH {views(True)}, {bounds_sql(32)}, {sum_sql('ub', 'b')}, {scores_sql()},
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rn, count(*) OVER (PARTITION BY qid) AS n FROM scores),
    m AS (SELECT *, max(CASE WHEN rn = {K} THEN score END) OVER (PARTITION BY qid) AS tau FROM r),
    o AS (SELECT qid, doc_id, ub < tau - 1e-9 AS pruned, rn <= {K} AS in_topk FROM m JOIN b USING (qid, doc_id) WHERE n > {K})"""


def _oracle(spark, sf_dir):
    docs, queries = tables(spark, sf_dir, ANISO)
    return P.oracle_pruning(P.upper_scores(docs, queries, 32), S.maxsim(docs, queries), K)


@query(f"{ORACLE} SELECT qid, round(avg(pruned::INT), 6) AS rate FROM o GROUP BY qid")
def prune_rate_oracle_tau(spark, sf_dir):
    """Share of documents that the true threshold prunes after 32 dimensions (anisotropic vectors)."""
    return _oracle(spark, sf_dir).groupBy("qid").agg(F.round(F.avg(F.col("pruned").cast("int")), 6).alias("rate"))


@query(f"{ORACLE} SELECT count(*) AS pairs, sum(pruned::INT)::BIGINT AS pruned, sum((pruned AND in_topk)::INT)::BIGINT AS unsafe FROM o")
def prune_safety(spark, sf_dir):
    """pruned documents of the true top ten; must be 0."""
    both = (F.col("pruned") & F.col("in_topk")).cast("int")
    return _oracle(spark, sf_dir).agg(F.count("*").alias("pairs"), F.sum(F.col("pruned").cast("int")).alias("pruned"), F.sum(both).alias("unsafe"))


LIVE = """{live} AS (SELECT qid, qtok, doc_id, tok, p, u, l FROM (
        SELECT *, max(u >= best) OVER (PARTITION BY qid, doc_id, tok) AS needed
        FROM (SELECT *, max(l) OVER (PARTITION BY qid, doc_id, qtok) AS best FROM {pairs})) WHERE needed)"""


@query(f"WITH {views(True)}, {bounds_sql(48)}, {LIVE.format(live='live', pairs='pairs')} SELECT qid, doc_id, count(DISTINCT tok) AS live FROM live GROUP BY ALL")
def token_prune_k48(spark, sf_dir):
    """Tokens that survive after 48 dimensions (anisotropic vectors)."""
    return P.live_counts(*tables(spark, sf_dir, ANISO), 48)


@query(exact_sql(K, True))
def pruned_topk_natural(spark, sf_dir):
    """One pass, each task under its own running thresholds, dimensions in natural order; equals brute force."""
    docs, queries = tables(spark, sf_dir, ANISO)
    return P.pruned_topk(S.pack_documents(docs), queries, K, STEPS, seeded=False)


@query(exact_sql(K, True))
def pruned_topk_bond(spark, sf_dir):
    """Each query in its own order, the quarter of dimensions farthest from the corpus mean first."""
    docs, queries = tables(spark, sf_dir, ANISO)
    own = queries.join(sweeps.query_orders(queries, docs, WIDTH // 4), "qid")
    return P.pruned_topk(S.pack_documents(docs), own, K, STEPS)


@query(exact_sql(K, True))
def pruned_topk_ada(spark, sf_dir):
    """Dimensions rotated at random."""
    docs, queries = tables(spark, sf_dir, ANISO)
    matrix = stats.random_rotation(WIDTH)
    return P.pruned_topk(S.pack_documents(stats.rotate_matrix(docs, matrix)), stats.rotate_matrix(queries, matrix), K, STEPS)


@query(exact_sql(K, True))
def pruned_topk_warmup(spark, sf_dir):
    """No bound before a quarter of the dimensions, single documents only once half of a block can go; shared thresholds."""
    docs, queries = tables(spark, sf_dir, ANISO)
    return P.pruned_topk(S.pack_documents(docs), queries, K, STEPS, warm_up=WIDTH // 4, dense_from=0.5)


@query(exact_sql(K))
def pruned_topk_stock(spark, sf_dir):
    """I10 on vectors where hardly anything can be pruned."""
    docs, queries = tables(spark, sf_dir)
    return P.pruned_topk(S.pack_documents(docs), queries, K, STEPS)


@query(exact_sql(K, True))
def pruned_topk_rounds(spark, sf_dir):
    """The same search in rounds of stored tables, with built-in functions only."""
    return P.pruned_search(*tables(spark, sf_dir, ANISO), K, ROUNDS)[0]


MARKS = [16, 32, 64]


def _slices(spark, sf_dir, aniso=None):
    """The document tokens by slices of dimensions, stored once for all queries of a session."""
    return keep(spark, ("slices", sf_dir, aniso), lambda: sliced.store_slices(tables(spark, sf_dir, aniso)[0], MARKS))


@query(f"WITH {views()}, {scores_sql('scores', 'q.vec[1:32]', 'd.vec[1:32]')} SELECT qid, doc_id, round(score, 6) AS score FROM scores")
def sliced_partial_k32(spark, sf_dir):
    """Scores by the first 32 dimensions, from the two slices that hold them."""
    return S.rounded(sliced.partial_scores(_slices(spark, sf_dir), tables(spark, sf_dir)[1], 32))


@query(f"WITH {views()}, {bounds_sql(32)}, {sum_sql('ub', 'b')} SELECT qid, doc_id, round(ub, 6) AS ub FROM b")
def sliced_bounds_k32(spark, sf_dir):
    """Bounds after 32 dimensions, from two slices and the norms behind them."""
    return S.rounded(sliced.upper_bounds(_slices(spark, sf_dir), tables(spark, sf_dir)[1], 32), "ub")


@query(exact_sql(K, True))
def sliced_pruned_topk(spark, sf_dir):
    """Exact search that scans one slice of all documents and whole documents only where bounds ask for it."""
    return sliced.pruned_topk(_slices(spark, sf_dir, ANISO), tables(spark, sf_dir, ANISO)[1], K, 16)


def rounds_sql(steps: list[int], shrink: float, tag="") -> str:
    """CTEs of a search in rounds: pairs<tag><i> are the rows that round i computes, final<tag> the scores."""
    out, before, at = [], None, 0
    for i, k in enumerate(steps):
        made = bounds_sql(k, f"{V.confidence(k, WIDTH, shrink)!r}", f"all{tag}{i}")
        out.append(made)
        live = f" SEMI JOIN {before} USING (qid, doc_id, tok)" if before else ""
        out.append(f"pairs{tag}{i} AS (SELECT *, {k - at} AS width FROM all{tag}{i}{live})")
        if k < WIDTH:
            out.append(LIVE.format(live=f"live{tag}{i}", pairs=f"pairs{tag}{i}"))
            out.append(f"best{tag}{i} AS (SELECT qid, doc_id, qtok, max(u) AS u, max(l) AS l FROM live{tag}{i} GROUP BY ALL)")
            out.append(f"rank{tag}{i} AS (SELECT qid, doc_id, sum(u) AS ub, sum(l) AS lb, row_number() OVER (PARTITION BY qid ORDER BY sum(l) DESC, doc_id) AS rn FROM best{tag}{i} GROUP BY qid, doc_id)")
            out.append(f"tau{tag}{i} AS (SELECT *, max(CASE WHEN rn = {K} THEN lb END) OVER (PARTITION BY qid) AS tau FROM rank{tag}{i})")
            out.append(f"keep{tag}{i} AS (SELECT DISTINCT qid, doc_id, tok FROM live{tag}{i} SEMI JOIN (SELECT qid, doc_id FROM tau{tag}{i} WHERE tau IS NULL OR ub >= tau - 1e-9) k USING (qid, doc_id))")
            before = f"keep{tag}{i}"
        at = k
    out.append(f"final{tag} AS (SELECT qid, doc_id, sum(b) AS score FROM (SELECT qid, doc_id, qtok, max(p) AS b FROM pairs{tag}{len(steps) - 1} GROUP BY ALL) GROUP BY ALL)")
    return ",\n".join(out)


FULL = "full_cells AS (SELECT qid, (SELECT count(*) FROM doc_tokens) * count(*) * 64 AS cells FROM query_tokens GROUP BY qid)"
WORK = " UNION ALL ".join(f"SELECT qid, {k} AS step, count(*) AS pairs, sum(width)::BIGINT AS cells FROM pairs{i} GROUP BY qid" for i, k in enumerate(ROUNDS))


@query(f"WITH {views(True)}, {rounds_sql(ROUNDS, 1.0)} {WORK}")
def pruned_work_bsp(spark, sf_dir):
    """Live pairs and cells in each round."""
    return P.pruned_search(*tables(spark, sf_dir, ANISO), K, ROUNDS)[1]


@query(f"WITH {views(True)}, {rounds_sql(ROUNDS, 0.5)} {topk_sql(K, 'final')}")
def pruned_topk_shrunk(spark, sf_dir):
    """Inexact search with the residual ramped down to a half."""
    return P.pruned_search(*tables(spark, sf_dir, ANISO), K, ROUNDS, shrink=0.5)[0]


GRID = [1.0, 0.7, 0.3]


def _frontier_sql():
    parts, picks = [], []
    for t, s in zip("abc", GRID, strict=True):
        parts.append(rounds_sql(ROUNDS, s, t))
        cells = " UNION ALL ".join(f"SELECT qid, sum(width)::BIGINT AS cells FROM pairs{t}{i} GROUP BY qid" for i in range(len(ROUNDS)))
        parts.append(f"work{t} AS (SELECT qid, sum(cells) AS cells FROM ({cells}) GROUP BY qid)")
        parts.append(f"found{t} AS (SELECT qid, doc_id, 1 AS hit FROM ({topk_sql(K, 'final' + t)}))")
        recall = f"SELECT x.qid, count(hit) / {K} AS recall FROM truth x LEFT JOIN found{t} USING (qid, doc_id) GROUP BY x.qid"
        picks.append(f"SELECT {s}::DOUBLE AS shrink, round(avg(recall), 6) AS recall, round(avg(w.cells / f.cells), 6) AS work FROM ({recall}) r JOIN work{t} w USING (qid) JOIN full_cells f USING (qid)")
    return f"WITH {views(True)}, {FULL}, {scores_sql()}, truth AS ({topk_sql(K)}), {', '.join(parts)} {' UNION ALL '.join(picks)}"


def frontier(docs, queries, grid, steps, k):
    """shrink, mean recall of the true top k and mean share of a full scan's cells."""
    truth = S.topk(S.rounded(S.scores(docs, queries, k)), k)
    full, out = S.scanned_cells(docs, queries, steps[-1]), None
    for shrink in grid:
        found, work = P.pruned_search(docs, queries, k, steps, shrink=shrink)
        marked = found.select("qid", "doc_id", F.lit(1).alias("hit"))
        recall = truth.join(marked, ["qid", "doc_id"], "left").groupBy("qid").agg((F.count("hit") / k).alias("recall"))
        both = recall.join(P.work_share(work, full), "qid")
        one = both.agg(F.lit(shrink).alias("shrink"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("work"), 6).alias("work"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_frontier_sql())
def shrink_frontier(spark, sf_dir):
    """Work and recall over shrink values."""
    return frontier(*tables(spark, sf_dir, ANISO), GRID, ROUNDS, K)


KEEP = [(16, 0.05), (16, 0.25), (32, 0.1), (32, 0.25)]


def _keep_sql():
    picks = []
    for k, f in KEEP:
        partial = f"SELECT qid, doc_id, sum(b) AS score FROM (SELECT q.qid, d.doc_id, q.qtok, max(list_inner_product(q.vec[1:{k}], d.vec[1:{k}])) AS b FROM query_tokens q, doc_tokens d GROUP BY ALL) GROUP BY ALL"
        kept = f"SELECT qid, doc_id, 1 AS hit FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rn, greatest({K}, round_even({f} * count(*) OVER (PARTITION BY qid), 0)) AS keep FROM (SELECT qid, doc_id, round(score, 6) AS score FROM ({partial}))) WHERE rn <= keep"
        picks.append(f"SELECT {k}::INT AS k, {f}::DOUBLE AS fraction, t.qid, count(hit) / count(*) AS recall FROM truth t LEFT JOIN ({kept}) USING (qid, doc_id) GROUP BY t.qid")
    return f"WITH {views()}, {scores_sql()}, truth AS ({topk_sql(K)}) SELECT * FROM ({' UNION ALL '.join(picks)})"


@query(_keep_sql())
def recall_fixed_prune(spark, sf_dir):
    """Recall of the top ten among the best fraction by a partial score."""
    docs, queries = tables(spark, sf_dir)
    truth, out = S.topk(S.rounded(S.scores(docs, queries, K)), K), None
    for k, fraction in KEEP:
        one = P.keep_fraction(S.rounded(S.maxsim(docs, queries, dims=k)), truth, fraction, K)
        one = one.select(F.lit(k).alias("k"), F.lit(fraction).alias("fraction"), "qid", "recall")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {views()}, m AS (SELECT unnest([1, 3, 5])::INT AS m),
    s AS (SELECT m, q.qid, d.doc_id, q.qtok, max(list_inner_product(q.vec, d.vec)) AS b FROM m JOIN query_tokens q ON q.qtok < m.m, doc_tokens d GROUP BY ALL),
    t AS (SELECT m, qid, doc_id, round(sum(b), 6) AS score FROM s GROUP BY ALL)
    SELECT m, qid, row_number() OVER (PARTITION BY m, qid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM t QUALIFY rank <= 3"""
)
def amortize_m(spark, sf_dir):
    """Top three for queries of one, three and five tokens, by blocks."""
    docs, queries = tables(spark, sf_dir)
    packed, out = cut_lineage(S.pack_documents(docs)), None
    for m in (1, 3, 5):
        best = S.topk(S.rounded(S.maxsim_blocks(packed, queries.where(F.col("qtok") < m), k=3)), 3)
        one = best.select(F.lit(m).alias("m"), "qid", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {views()}, {scores_sql()}, n AS (SELECT unnest([10, 25, 50]) AS n),
    s AS (SELECT n, qid, doc_id, round(score, 6) AS score FROM n JOIN scores ON doc_id < n)
    SELECT n::INT AS n, qid, row_number() OVER (PARTITION BY n, qid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 5"""
)
def scale_probe(spark, sf_dir):
    """The five best among the first n documents, for several n."""
    from pyspark.sql import Window

    scores = S.rounded(S.maxsim(*tables(spark, sf_dir)))
    grid = F.explode(F.array(*map(F.lit, (10, 25, 50))))
    some = scores.select("*", grid.alias("n")).where("doc_id < n")
    order = Window.partitionBy("n", "qid").orderBy(F.desc("score"), "doc_id")
    return some.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("n", "qid", "rank", "doc_id", "score")


@query(exact_sql(K, True))
def sequential_topk(spark, sf_dir):
    """Document by document against the running threshold; equals brute force."""
    return P.sequential_search(*tables(spark, sf_dir, ANISO), K, STEPS).select("qid", "rank", "doc_id", "score")


def _sequential_sql():
    """A document's own pruning of tokens doesn't hang on the threshold, and pruned documents never raise it.

    So the threshold before a document is the k-th best of the rounded scores of those before it.
    """
    out, before, last = [], None, len(STEPS) - 1
    for i, k in enumerate(STEPS):
        at = STEPS[i - 1] if i else 0
        out.append(bounds_sql(k, name=f"every{i}"))
        live = f"SEMI JOIN {before} USING (qid, doc_id, tok)" if before else ""
        out.append(f"pairs{i} AS (SELECT *, {k - at} AS width FROM every{i} {live})")
        out.append(f"live{i} AS (SELECT * FROM (SELECT *, max(u >= best - 1e-9) OVER (PARTITION BY qid, doc_id, tok) AS needed FROM (SELECT *, max(l) OVER (PARTITION BY qid, doc_id, qtok) AS best FROM pairs{i})) WHERE needed)")
        out.append(f"seen{i} AS (SELECT qid, doc_id, sum(width) AS cells, count(DISTINCT tok) AS tokens FROM pairs{i} GROUP BY qid, doc_id)")
        out.append(f"left{i} AS (SELECT qid, doc_id, count(DISTINCT tok) AS tokens FROM live{i} GROUP BY qid, doc_id)")
        out.append(f"ub{i} AS (SELECT qid, doc_id, sum(b) AS ub FROM (SELECT qid, doc_id, qtok, max(u) AS b FROM live{i} GROUP BY ALL) GROUP BY ALL)")
        before = f"live{i}"
    out.append(scores_sql())
    out.append(f"floors AS (SELECT s.qid, s.doc_id, (SELECT list_sort(list(round(p.score, 6)), 'DESC')[{K}] FROM scores p WHERE p.qid = s.qid AND p.doc_id < s.doc_id) AS floor FROM scores s)")
    steps = " UNION ALL ".join(f"SELECT {i} AS i, qid, doc_id, cells, s.tokens - l.tokens AS dropped, ub < floor - 1e-9 AS stops FROM seen{i} s JOIN left{i} l USING (qid, doc_id) JOIN ub{i} USING (qid, doc_id) JOIN floors USING (qid, doc_id)" for i in range(len(STEPS)))
    out.append(f"steps AS ({steps})")
    out.append("run AS (SELECT *, coalesce(max(stops::INT) OVER (PARTITION BY qid, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS runs FROM steps)")
    return f"""WITH {views(True)}, {', '.join(out)} SELECT qid, sum(cells)::BIGINT AS cells, sum(coalesce(stops, false)::INT)::BIGINT AS docs_all, sum((coalesce(stops, false) AND i < {last})::INT)::BIGINT AS docs_early,
        sum(dropped)::BIGINT AS tokens_all, sum(CASE WHEN i < {last} THEN dropped ELSE 0 END)::BIGINT AS tokens_early FROM run WHERE runs GROUP BY qid"""


@query(_sequential_sql())
def sequential_counters(spark, sf_dir):
    """Cells and pruned documents and tokens of the sequential form, with the last checkpoint and without."""
    found = P.sequential_search(*tables(spark, sf_dir, ANISO), K, STEPS)
    return found.where("rank = 1").select("qid", "cells", "docs_all", "docs_early", "tokens_all", "tokens_early")
