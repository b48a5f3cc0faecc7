"""Corpus pipeline: stages over the documents table, each written as Parquet and read again.

Toxic documents go, one document of each group of near-duplicates stays, personal data is masked,
and what is left is packed into training sequences.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.packing import pack
from tessera.llm.pii import fit_detector, redact_pii
from tessera.llm.shingle_dedup import marks, similar_sets
from tessera.llm.simhash_dedup import fingerprint_edges, fingerprints
from tessera.llm.storage import discard, drop_shuffles, materialize, settle
from tessera.llm.toxicity import corpus_chain, score_toxicity

#: Least Jaccard similarity of five-word shingles at which documents count as near-duplicates.
SIMILARITY = 0.8


def nested(docs):
    """The text, and all other columns as one, so that no name clashes with those that a stage adds."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own"))


def flat(rows, columns):
    """What nested() took, under its own names."""
    return rows.select(*("text" if c == "text" else F.col(f"own.`{c}`") for c in columns))


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain doesn't reject; it learns from the labels table.

    Rows are judged by their text alone: null and empty texts, which have no features, are kept unless
    the labels speak against them, repeated rows and ids go or stay alike, long texts are read whole,
    columns may have any names, and an empty table stays empty.
    """
    chain = corpus_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return flat(score_toxicity(nested(docs), chain).where(~F.col("is_toxic")), docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each group of near-duplicates: the one with the smallest id, of several that with the smallest digest.

    Texts link if the Jaccard similarity of their five-word shingles is at least 0.8, which is decided by
    the whole sets; groups are the components of the links. Candidates are SimHash links and, as no
    radius reaches all pairs of that similarity, shared bands of minima. Rows are told apart by a key of
    their own, so ids may repeat; a row without an id stays only if none of its group has one. Null and
    empty texts are equal texts, an empty table stays empty, and columns may have any names.
    """
    rows = materialize(marks(nested(docs).withColumn("row", F.monotonically_increasing_id())))
    order = F.struct(F.col("own.doc_id").isNull(), "own.doc_id", F.sha2(F.col("text").cast("binary"), 256), "row")
    classes = rows.groupBy("node").agg(F.min(order).alias("first"), *(F.first(c).alias(c) for c in ("n", "keys")))
    classes = materialize(classes.withColumn("row", F.col("first.row")))
    marked = fingerprints(rows.where("n > 0"), "row", "text", shingle=5).withColumnRenamed("id", "row")
    likely = materialize(fingerprint_edges(marked.join(classes.select("row", "node"), "row").select("node", "fp")))
    linked = similar_sets(classes, rows, SIMILARITY, likely=likely)
    grouped = classes.select("node", "first").join(linked, "node", "left")
    kept = materialize(grouped.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.row"))
    discard(classes, likely, linked)
    drop_shuffles(spark)
    return flat(rows.join(kept.hint("merge"), "row"), docs.columns)


def mask_personal_data(spark, docs, sf_dir):
    """Every document, with personal data masked and n_chars recounted.

    Null texts stay null and empty ones empty; repeated rows are masked alike, long texts whole, other
    columns are left as they are, and an empty table stays empty.
    """
    return redact_pii(docs, fit_detector(docs), size_col="n_chars")


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is one piece, its end. Repeated rows and ids are packed row by row, long texts
    in several pieces; other columns don't matter, and an empty table gives no piece.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: None of the stages can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage reads the table that the one before it wrote.

    Rows are treated as the stages say, of null, empty, long and repeated ones too. A stage's own tables go once
    it is written, its result once the next one is; ``release`` of the storage module deletes the last.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return docs
