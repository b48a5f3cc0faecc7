"""Corpora, queries, judgements, benchmark reports and index metadata as DataFrames, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.stages import cut_lineage
from tessera.sources.tokens import exists


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV with a header, by format or by the path's ending."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    if fmt in ("json", "jsonl"):
        return spark.read.json(path)
    return spark.read.csv(path, header=True) if fmt == "csv" else spark.read.parquet(path)


def load_dataset(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus: doc_id, text), (queries with judgements: qid, text), (qrels: qid, doc_id, rel) from three splits."""
    judged = typed_qrels(read_any(spark, qrels).withColumnsRenamed({"query-id": "qid", "corpus-id": "doc_id", "score": "rel"}))
    docs = read_any(spark, corpus)
    docs = docs.select(F.col("_id").cast("string").alias("doc_id"), title_and_text("title", "text").alias("text"))
    asked = read_any(spark, queries).select(F.col("_id").cast("string").alias("qid"), "text")
    return docs, judged_queries(asked, judged), judged


def title_and_text(title, text):
    """Title, a space and text, without white space at either end."""
    whole = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def typed_qrels(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.col("qid").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("doc_id"), F.col("rel").cast("int").alias("rel"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that occur in the judgements."""
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def head(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key."""
    return rows.orderBy(key).limit(n)


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """qid and its judgements as a list of (doc_id, rel), by doc_id."""
    return qrels.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("doc_id", "rel"))).alias("judged"))


def qrels_map(qrels: DataFrame) -> DataFrame:
    """qid -> map of doc_id to rel."""
    return qrels.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "rel"))).alias("judged"))


def positions(rows: DataFrame, key: str) -> DataFrame:
    """key and its 0-based position by key, numbered inside ranges of keys and shifted by the ranges before.

    The only rows that meet in one task are the ranges' sizes.
    """
    parts = cut_lineage(rows.select(key).repartitionByRange(F.col(key)).select(key, F.spark_partition_id().alias("part")))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("own", own).join(F.broadcast(starts), "part").select(key, (F.col("start") + F.col("own")).alias("position"))


def read_report(spark: SparkSession, label: str, path: str) -> DataFrame | None:
    """A benchmark CSV with its label; None if the file is missing."""
    return spark.read.csv(path, header=True).withColumn("label", F.lit(label)) if exists(spark, path) else None


NUMBERS = ("ivf_nprobe", "recall", "avg")


def union_reports(reports: list[DataFrame | None]) -> DataFrame:
    """All reports, missing ones skipped and columns by name, numbers coerced (null where they aren't)."""
    frames = [r for r in reports if r is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return coerce(out)


def coerce(report: DataFrame) -> DataFrame:
    kinds = {"ivf_nprobe": "int", "recall": "double", "avg": "double"}
    return report.withColumns({c: F.expr(f"try_cast({c} AS {kinds[c]})") for c in NUMBERS})


def has_results(report: DataFrame, dataset: str) -> bool:
    """Whether a report already has rows of a data set, to skip its run."""
    return not report.where(F.col("dataset") == dataset).isEmpty()


def rows_by_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every CSV file under a path."""
    read = spark.read.csv(path, header=True)
    return read.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).groupBy("file").count()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One index metadata document."""
    return spark.read.json(path, multiLine=True)


def read_doc_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (position) and n_tok from a JSON list of token counts."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<int>")).alias("doc_id", "n_tok"))


def check_metadata(metadata: DataFrame, lengths: DataFrame) -> DataFrame:
    """Counts of the length list beside those of the metadata, and whether they agree."""
    own = lengths.agg(F.count("*").alias("docs"), F.sum("n_tok").alias("tokens"), F.avg("n_tok").alias("mean_length"))
    whole = metadata.select("num_embeddings", "avg_doclen").crossJoin(own)  # one row each
    agree = (F.col("num_embeddings") == F.col("tokens")) & (F.abs(F.col("avg_doclen") - F.col("mean_length")) < 1e-6)
    return whole.withColumn("consistent", agree)


def result_document(values: DataFrame, nested: dict[str, list[str]], digits: dict[str, int]) -> DataFrame:
    """One JSON document a row: columns rounded and grouped into structs."""
    rounded = values.withColumns({c: F.round(c, n) for c, n in digits.items()})
    return rounded.select(F.to_json(F.struct(*(F.struct(*cols).alias(name) for name, cols in nested.items()))).alias("document"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_index(assigned: DataFrame, path: str) -> None:
    """Write an index, one folder a centroid, replacing an older one."""
    assigned.write.mode("overwrite").partitionBy("centroid").parquet(path)


def write_metadata(assigned: DataFrame, path: str, bits=4) -> None:
    """The metadata document and the list of document lengths (by id) of an index, as JSON beside it."""
    lengths = assigned.groupBy("doc_id").agg(F.count("*").alias("n_tok"))
    total = assigned.agg(F.count("*").alias("num_embeddings"), F.countDistinct("centroid").alias("num_partitions"), (F.count("*") / F.countDistinct("doc_id")).alias("avg_doclen"))
    total.select(F.lit(bits).alias("nbits"), F.lit(1).alias("num_chunks"), "*").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    lengths.write.mode("overwrite").json(f"{path}/doclens")


def check_index(spark: SparkSession, path: str, lists: str) -> DataFrame:
    """One row: counts by metadata, by document lengths and by the posting lists themselves, and whether all agree."""
    meta = spark.read.json(f"{path}/metadata")
    held = spark.read.parquet(lists).agg(F.count("*").alias("held"), F.countDistinct("centroid").alias("partitions"))
    found = check_metadata(meta.select("num_embeddings", "avg_doclen", "num_partitions"), spark.read.json(f"{path}/doclens"))
    whole = found.crossJoin(held).crossJoin(meta.select("num_partitions"))  # one row each
    return whole.withColumn("consistent", F.col("consistent") & (F.col("held") == F.col("num_embeddings")) & (F.col("partitions") == F.col("num_partitions")))
