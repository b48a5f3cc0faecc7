"""Queries on corpora, judgements and benchmark reports."""

from pyspark.sql import functions as F

from tessera.operators import harness, metrics
from tessera.operators import report as R
from tessera.plans.base import qrels, query, read, tables, views
from tessera.sources import corpora as C
from tessera.sources import tokens
from tessera.sources.stages import new_folder


@query("SELECT doc_id, regexp_replace(regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS text FROM documents")
def corpus_concat(spark, sf_dir):
    """Title, space and text, stripped (the source stands for the title)."""
    return read(spark, sf_dir, "documents").select("doc_id", C.title_and_text("source", "text").alias("text"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def qrels_semi_join(spark, sf_dir):
    """Rows that occur in the judgements."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("WITH f AS (SELECT DISTINCT doc_id FROM labels ORDER BY doc_id LIMIT 100) SELECT doc_id, source FROM documents SEMI JOIN f USING (doc_id) WHERE n_chars > 100")
def semi_join_first_100(spark, sf_dir):
    """C4: the first hundred judged ids that also have a usable row."""
    first = C.head(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", 100)
    return read(spark, sf_dir, "documents").where("n_chars > 100").join(first, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS INT) AS rel FROM labels")
def typed_judgements(spark, sf_dir):
    """C2."""
    rows = read(spark, sf_dir, "labels").select(F.lit("q").alias("qid"), "doc_id", F.col("quality").alias("rel"))
    return C.typed_qrels(rows).select("doc_id", "rel")


@query(f"WITH {views()} SELECT DISTINCT d.doc_id, q.qid, r.rel IS NOT NULL AS relevant FROM doc_tokens d CROSS JOIN (SELECT DISTINCT qid FROM query_tokens) q LEFT JOIN qrels r ON r.qid = q.qid AND r.doc_id = d.doc_id")
def relevance_flag(spark, sf_dir):
    """Every pair, with whether it is judged relevant."""
    from tessera.operators.pruning import relevance
    from tessera.operators.scoring import small

    docs, queries = tables(spark, sf_dir)
    pairs = docs.select("doc_id").distinct().crossJoin(small(queries.select("qid").distinct()))
    return relevance(pairs, qrels(spark, sf_dir)).select("doc_id", "qid", "relevant")


@query(f"WITH {views()} SELECT qid, count(*) AS n, string_agg(doc_id || ':' || rel, ',' ORDER BY doc_id) AS judged FROM qrels GROUP BY qid")
def qrels_nested(spark, sf_dir):
    """A3: a query's judgements in one row, shown as text."""
    nested = C.nested_qrels(qrels(spark, sf_dir))
    shown = F.array_join(F.transform("judged", lambda j: F.concat_ws(":", j["doc_id"], j["rel"])), ",")
    return nested.select("qid", F.size("judged").cast("long").alias("n"), shown.alias("judged"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def id_positions(spark, sf_dir):
    """A4: positions by id."""
    return C.positions(read(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def head_scan(spark, sf_dir):
    """The first fifty rows' text."""
    return C.head(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 50)


@query("SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id LIMIT 80")
def exact_sample(spark, sf_dir):
    """Exactly eighty rows without replacement, keyed by id and seed."""
    return harness.sample(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 80)


@query("SELECT item_id, text FROM benchmark")
def benchmark_scan(spark, sf_dir):
    """A1: a plain scan of a query split."""
    return C.read_any(spark, f"{sf_dir}/benchmark.parquet").select("item_id", "text")


@query(f"WITH {views()} SELECT doc_id, tok, round(vec[1], 6) AS x0 FROM doc_tokens")
def cache_round_trip(spark, sf_dir):
    """Token vectors written as the cache, checked by ids and read again."""
    from tessera.sources.stages import cut_lineage

    docs, _ = tables(spark, sf_dir)
    return cut_lineage(docs).select("doc_id", "tok", F.round(F.get("vec", F.lit(0)), 6).alias("x0"))


@query(f"WITH {views()} SELECT doc_id, count(*) AS n FROM doc_tokens GROUP BY doc_id")
def cache_reencoded(spark, sf_dir):
    """A cache that holds other ids than asked for is encoded anew, and then serves as it is."""
    docs, _ = tables(spark, sf_dir)
    path = new_folder(spark, "cache")
    tokens.write_cache(docs.where("doc_id % 2 = 0"), path)
    ids = docs.select("doc_id").distinct()
    for encode in (lambda ids: docs.join(ids, "doc_id", "left_semi"), None):
        found = tokens.read_or_encode(spark, path, ids, encode)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


REPORT = [
    ("a", "Brute-force", "32", "1.0", "10.0"),
    ("a", "Brute-force", "128", "1.0", "10.0"),
    ("a", "List scan", "32", "0.91", "4.0"),
    ("a", "List scan", "128", "0.97", "8.0"),
    ("a", "Dimension scan", "32", "0.92", "2.5"),
    ("a", "Dimension scan", "128", "0.98", "n/a"),
    ("b", "List scan", "32", "0.85", "3.0"),
    ("b", "Dimension scan", "32", "0.95", "1.5"),
    (None, "Dimension scan", "32", "0.5", "1.0"),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in REPORT)
RAW = f"raw(dataset, label, ivf_nprobe, recall, avg) AS (VALUES {_VALUES})"
TYPED = f"WITH {RAW}, report AS (SELECT dataset, label, try_cast(ivf_nprobe AS INT) AS ivf_nprobe, try_cast(recall AS DOUBLE) AS recall, try_cast(avg AS DOUBLE) AS avg FROM raw)"


def report(spark):
    """The literal report, read as separate frames a label and united."""
    rows = spark.sql(f"SELECT * FROM (VALUES {_VALUES}) AS raw(dataset, label, ivf_nprobe, recall, avg)")
    labels = ("Brute-force", "List scan", "Dimension scan")
    return C.union_reports([rows.where(F.col("label") == x) for x in labels] + [None])


@query(f"{TYPED} SELECT dataset, label, ivf_nprobe, recall, avg FROM report")
def bench_union(spark, sf_dir):
    """Union of reports, numbers coerced."""
    return report(spark).select("dataset", "label", "ivf_nprobe", "recall", "avg")


@query(f"{TYPED} SELECT label, count(*) AS n, count(avg) AS numbers, sum((avg IS NULL)::INT)::BIGINT AS lost FROM report GROUP BY label")
def bench_coerce(spark, sf_dir):
    """C13."""
    lost = F.sum(F.col("avg").isNull().cast("int"))
    return report(spark).groupBy("label").agg(F.count("*").alias("n"), F.count("avg").alias("numbers"), lost.alias("lost"))


SPEED = f"{TYPED}, speed AS (SELECT r.dataset, r.ivf_nprobe, r.label, b.avg / r.avg AS speedup FROM report r JOIN report b ON r.dataset = b.dataset AND r.ivf_nprobe = b.ivf_nprobe AND b.label = 'Brute-force' WHERE r.label <> 'Brute-force' AND r.avg IS NOT NULL)"


@query(f"{SPEED} SELECT dataset, ivf_nprobe, label, round(speedup, 6) AS speedup FROM speed")
def bench_speedup(spark, sf_dir):
    """C12, G2."""
    return R.speedup(report(spark)).withColumn("speedup", F.round("speedup", 6))


@query(f"{SPEED} SELECT label, round(max(speedup), 6) AS peak, round(median(speedup), 6) AS median FROM speed GROUP BY label")
def bench_speedup_summary(spark, sf_dir):
    """F20."""
    return R.speedup_summary(report(spark)).select("label", F.round("peak", 6).alias("peak"), F.round("median", 6).alias("median"))


@query(f"{TYPED} SELECT dataset, label, recall, avg FROM report WHERE recall >= 0.9")
def bench_pareto(spark, sf_dir):
    """C11, D13, G3."""
    return R.pareto(report(spark))


@query(f"{TYPED} SELECT DISTINCT dataset FROM report WHERE dataset IS NOT NULL")
def bench_datasets(spark, sf_dir):
    """C14."""
    return R.datasets(report(spark))


@query(f"{TYPED}, o AS (SELECT * FROM (VALUES (1, 'Brute-force'), (2, 'Dimension scan'), (3, 'List scan')) AS t(place, label)) SELECT dataset, place::INT AS place, label, avg, recall FROM report JOIN o USING (label) WHERE ivf_nprobe = 32 QUALIFY row_number() OVER (PARTITION BY dataset, label ORDER BY avg) = 1")
def bench_at_probe(spark, sf_dir):
    """One row a label at one nprobe, labels in a fixed order."""
    return R.at_probe(report(spark), 32, ["Brute-force", "Dimension scan", "List scan"])


@query(f"{TYPED} SELECT d AS dataset, EXISTS (SELECT 1 FROM report WHERE dataset = d) AS present FROM (SELECT unnest(['a', 'b', 'c']) AS d)")
def bench_has_results(spark, sf_dir):
    """Whether a data set already has rows."""
    rows = report(spark)
    return spark.createDataFrame([(d, C.has_results(rows, d)) for d in ("a", "b", "c")], "dataset string, present boolean")


@query(
    f"""{SPEED} SELECT label, CASE WHEN median(speedup) >= 2.0 THEN 'PASS' WHEN median(speedup) >= 1.2 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict,
        CASE WHEN max(speedup) * 10 - 20 >= 10 THEN 'PASS' ELSE 'FAIL' END AS gain,
        CASE WHEN max(speedup) >= 2 AND min(speedup) <= 1.5 THEN 'PASS' WHEN max(speedup) >= 2 THEN 'COSTLY' ELSE 'FAIL' END AS recall_gate FROM speed GROUP BY label"""
)
def gate_verdict(spark, sf_dir):
    """Two- and three-way verdicts."""
    s = R.speedup(report(spark)).groupBy("label").agg(F.median("speedup").alias("m"), F.max("speedup").alias("hi"), F.min("speedup").alias("lo"))
    return s.select("label", R.verdict(F.col("m"), 2.0, 1.2).alias("verdict"), R.gain_verdict(F.col("hi") * 10 - 20).alias("gain"), R.recall_verdict(F.col("hi"), F.col("lo"), 2, 1.5).alias("recall_gate"))


POINTS = [("x", "natural", 1.0, 1.0, 0.9), ("x", "natural", 0.5, 0.8, 0.4), ("x", "bond", 1.0, 1.0, 0.8), ("x", "bond", 0.5, 0.9, 0.3), ("y", "natural", 1.0, 1.0, 0.7), ("y", "bond", 1.0, 0.95, 0.6)]
_POINTS = ", ".join(f"('{d}', '{a}', {s}::DOUBLE, {r}::DOUBLE, {w}::DOUBLE)" for d, a, s, r, w in POINTS)


def points(spark):
    return spark.sql(f"SELECT * FROM (VALUES {_POINTS}) AS p(dataset, arm, shrink, recall, work)")


P_SQL = f"WITH p(dataset, arm, shrink, recall, work) AS (VALUES {_POINTS})"


@query(f"{P_SQL} SELECT arm, shrink, round(avg(recall), 6) AS recall, round(avg(work), 6) AS work FROM p GROUP BY ALL")
def frontier_mean(spark, sf_dir):
    """F17."""
    found = R.frontier_mean(points(spark))
    return found.select("arm", "shrink", F.round("recall", 6).alias("recall"), F.round("work", 6).alias("work"))


@query(
    f"""{P_SQL} SELECT arm, coalesce(arg_min(shrink, work * 1000 + shrink) FILTER (recall >= 0.97), arg_max(shrink, recall * 1000 - shrink)) AS knob, arg_min(shrink, work * 1000 + shrink) AS cheapest
    FROM p GROUP BY arm"""
)
def knob_pick(spark, sf_dir):
    """Least work that reaches the target recall, else most recall; and the cheapest."""
    from tessera.operators.knn import knob_pick as pick

    rows = points(spark).withColumn("knob", F.col("shrink"))
    cheapest = rows.groupBy("arm").agg(F.min_by("knob", F.struct("work", "knob")).alias("cheapest"))
    return pick(rows, 0.97, "arm").join(cheapest, "arm")


@query(f"{P_SQL} SELECT 64::INT AS k, shrink AS fraction, round(max(recall) FILTER (arm = 'bond') - max(recall) FILTER (arm = 'natural'), 6) AS gain FROM p GROUP BY shrink")
def gain_over_best(spark, sf_dir):
    """G10."""
    rows = points(spark).select(F.lit(64).alias("k"), F.col("shrink").alias("fraction"), "arm", "recall")
    return R.over_best(rows, "bond", ["natural"]).select("k", "fraction", F.round("gain", 6).alias("gain"))


@query(f"WITH {views()} SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean_length, true AS consistent FROM (SELECT count(*) AS n FROM doc_tokens GROUP BY doc_id)")
def index_metadata_check(spark, sf_dir):
    """A12, M9, DM24: counts of a length list against its metadata."""
    from tessera.operators.stats import token_counts

    lengths = token_counts(tables(spark, sf_dir)[0])
    meta = lengths.agg(F.sum("n_tok").alias("num_embeddings"), F.avg("n_tok").alias("avg_doclen"))
    found = C.check_metadata(meta, lengths)
    return found.select("docs", "tokens", F.round("mean_length", 6).alias("mean_length"), "consistent")


INDEXED = f"""WITH {views()}, n AS (SELECT doc_id, count(*) AS n FROM doc_tokens GROUP BY doc_id), t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean_length FROM n),
    p AS (SELECT count(DISTINCT label) AS partitions FROM doc_tokens), h AS (SELECT sum(n)::BIGINT AS held FROM n WHERE doc_id > 0)"""


@query(
    f"""{INDEXED} SELECT 'whole' AS lists, docs, tokens AS num_embeddings, mean_length, tokens AS held, partitions, true AS consistent FROM t, p
    UNION ALL SELECT 'short', docs, tokens, mean_length, held, partitions, held = tokens FROM t, p, h"""
)
def index_metadata_json(spark, sf_dir):
    """An index's JSON documents against its posting lists, whole and with a document missing."""
    docs, _ = tables(spark, sf_dir)
    assigned = docs.select("doc_id", "tok", "vec", F.col("label").alias("centroid"))
    path, out = new_folder(spark, "index"), None
    C.write_metadata(assigned, path)
    for name, rows in (("whole", assigned), ("short", assigned.where("doc_id > 0"))):
        C.write_index(rows, f"{path}/{name}")
        found = C.check_index(spark, path, f"{path}/{name}")
        one = found.select(F.lit(name).alias("lists"), "docs", "num_embeddings", F.round("mean_length", 6).alias("mean_length"), "held", "partitions", "consistent")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source, '{\"counts\":{\"docs\":' || count(*) || '},\"sizes\":{\"longest\":' || max(n_chars) || '}}' AS document FROM documents GROUP BY source")
def result_json(spark, sf_dir):
    """B1, DM23, E14: nested JSON documents."""
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.max("n_chars").alias("longest"))
    made = F.to_json(F.struct(F.struct("docs").alias("counts"), F.struct("longest").alias("sizes")))
    return rows.select("source", made.alias("document"))


@query("SELECT 'documents.parquet' AS file, count(*) AS n FROM documents")
def rows_by_file(spark, sf_dir):
    """Rows of each input file, counted by the data set's name."""
    rows = read(spark, sf_dir, "documents").select(F.regexp_extract("_metadata.file_path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1).alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT round(1.5 / count(*) * 1000, 6) AS ms_per_query FROM benchmark")
def ms_per_query(spark, sf_dir):
    """N6."""
    n = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    return n.select(F.round(metrics.ms_per_query(F.lit(1.5), F.col("n")), 6).alias("ms_per_query"))


@query(None)
def synthetic_norms(spark, sf_dir):
    """Norms of generated unit vectors."""
    return tokens.norm_report(tokens.synthetic(spark, 500, 64, 5, 20))
