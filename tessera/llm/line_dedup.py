"""Lines that many documents repeat, found by levelled sorted runs of line hashes.

Documents are taken in batches, largest ids first. A batch's line hashes become a sorted run: a table
bucketed and sorted by hash. What a merge anti join with all runs so far leaves of it are hashes met for
the first time, so their largest document is the line's last one. Then the batch's run is added; as soon
as a level holds two runs, they are merged into one of the next level, so that the n-th batch meets at
most log2(n) + 1 runs. Runs are dealt alike, so neither these joins nor the merges shuffle anything.
DataFrame operations only.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete, discard, materialize, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["a", "b"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    line = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def text_lines(docs: DataFrame, batches: int, least_length: int, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per line whose key is long enough: hash (a, b), id, text hash, place and batch (0: the largest ids)."""
    cuts = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = docs.agg(F.percentile_approx(id_col, cuts, 10_000)).first()[0] if cuts else None  # batches - 1 numbers
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    batch = sum((F.when(F.col("id") < c, 1).otherwise(0) for c in cuts or []), F.lit(0))
    batch = F.when(F.col("id").isNull(), max(0, batches - 1)).otherwise(batch).cast("int")
    rows = rows.select("id", batch.alias("batch"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keys = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_length)
    return keys.select(F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"), "id", "text_hash", "place", "batch")


class SortedRuns:
    """Runs (a, b, n: documents) by level, and the largest document of each hash; all of them bucketed tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.first: list[str] = []
        self.folders: dict[str, str] = {}

    def write(self, run: DataFrame) -> str:
        """Store run by buckets of its hashes, each sorted; its name."""
        name = f"run_{uuid.uuid4().hex}"
        self.folders[name] = f"{shared_folder(self.spark)}/{name}"
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.folders[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, self.folders.pop(name))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """A batch's lines (a, b, id). No id may be in two batches, and ids must fall from batch to batch."""
        once = lines.groupBy(*HASH, "id").agg(F.lit(1).alias("held"))  # first by document, so that no hash is hot
        own = self.write(once.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("id").alias("last")))
        fresh = self.read(own).select(*HASH, "last")
        for run in self.runs():
            fresh = fresh.join(self.read(run), HASH, "left_anti")
        self.first.append(self.write(fresh))
        level, run = 0, own
        while True:
            if level == len(self.levels):
                self.levels.append([])
            if not self.levels[level]:
                self.levels[level].append(run)
                return
            run, level = self.merged(self.levels[level].pop(), run), level + 1

    def merged(self, one: str, other: str) -> str:
        """Both runs' documents by hash, as a run in their place."""
        count = lambda name, c: self.read(name).select(*HASH, F.col("n").alias(c))
        both = count(one, "n1").join(count(other, "n2"), HASH, "full")
        zero = F.lit(0).cast("long")
        run = self.write(both.select(*HASH, (F.coalesce("n1", zero) + F.coalesce("n2", zero)).alias("n")))
        self.drop(one, other)
        return run

    def frequent(self, least: int) -> DataFrame:
        """Stored (a, b, last) of the hashes in at least so many documents; the runs end with it."""
        runs = self.runs()
        while len(runs) > 1:
            runs.append(self.merged(runs.pop(0), runs.pop(0)))
        often = self.read(runs[0]).where(F.col("n") >= least).select(*HASH)
        found = None
        for name in self.first:
            own = self.read(name).join(often, HASH)
            found = own if found is None else found.unionByName(own)
        found = materialize(found.select(*HASH, "last"))
        self.drop(*runs, *self.first)
        return found


def drop_repeated_lines(docs: DataFrame, least=5, least_length=40, batches=4, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row: id, n_lines, n_dropped and the text that stays.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of ``least_length`` code
    points or more in at least ``least`` documents lose their lines except in the largest id holding them.
    Null and empty texts are one empty line. Rows of one id are one document, rows without an id are
    one below all others; repeated rows are treated alike and all returned. Ids are numbers. Long texts are
    read whole, an empty table gives an empty result, other columns are ignored. Keys are told apart by
    two 64-bit hashes.

    Lines travel as hashes; texts move once, to meet the places that they lose. Joins by hash and by
    document sort both sides at any size; adaptive execution splits their hot keys.
    """
    lines = materialize(text_lines(docs, batches, least_length, id_col, text_col))
    runs = SortedRuns(docs.sparkSession)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    lost = lines.join(runs.frequent(least).hint("merge"), HASH).where(~F.col("id").eqNullSafe(F.col("last")))
    lost = materialize(lost.groupBy(F.col("id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.collect_set("place").alias("lost")))
    discard(lines)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.xxhash64("text") == F.col("lost_hash"))
    rows = rows.join(lost.hint("merge"), same, "left").withColumn("lines", F.split("text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    dropped = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost"))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept)
    return rows.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), text.alias("text"))
