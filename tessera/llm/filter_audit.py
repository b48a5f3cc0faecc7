"""What each filter removes in every order of the filters, and what it owes to those before it.

Documents are reduced to masks of the filters that they fail, and these to counted cells, at most one a
part and mask. Cells are unpivoted against the steps of all orders; a running bit-or window over an
order's earlier steps tells which cells were gone before a step, conditional sums over the cells give the
step's counts, and a window over a filter's rows its total over all orders.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize

SPACES = "[\\x20\\x09-\\x0D]+"
#: Of a filter's row: documents kept after the step, removed by it, and so on.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """Failure conditions over the columns text (no nulls) and words (its words)."""
    size, distinct = (F.size(c).cast("long") for c in (F.col("words"), F.array_distinct("words")))
    length = F.length("text").cast("long")
    capitals = length - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return {
        "A": size < 50,
        "B": 100 * distinct < 65 * size,
        "C": 100 * capitals > 5 * length,
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def mask_documents(docs: DataFrame, filters: dict[str, Column], id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """One row per row: id, part and mask, whose bit i is set where the i-th filter fails.

    The bit after these is that of copies: texts that some smaller id has too. Texts are equal
    if their SHA-256 digests are. Rows of one id don't make each other copies, nor do rows without an
    id, which aren't copies either.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = materialize(rows.select("id", "part", mask.alias("mask"), F.sha2("text", 256).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    later = F.when(F.col("id") > F.col("first"), 1 << len(filters)).otherwise(0)
    return rows.join(first, "digest").select("id", "part", (F.col("mask") + later).alias("mask"))


def count_cells(masks: DataFrame, labels: DataFrame, id_col="doc_id", good_col="quality", toxic_col="toxic") -> DataFrame:
    """One row per part and mask: n documents, and how many of them some label calls good or toxic."""
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(says(good_col).alias("good"), says(toxic_col).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit_orders(cells: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, with COUNTS and shapley.

    cells: part, mask, n, good, toxic; names: a letter for each bit of the mask. There are as many orders
    as the letters have permutations, so this is for few filters (5: 120 orders of 5 steps).
    """
    orders = ",".join(map("".join, permutations(names)))
    steps = cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.col("filter")) - 1)
    steps = steps.withColumn("failed", F.col("mask").bitwiseAND(bit))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    where = {
        "kept": ("n", ~fails & ~gone),
        "removed": ("n", fails & ~gone),
        "redundant": ("n", fails & gone),
        "unique_fails": ("n", fails & (F.col("mask") == F.col("failed"))),
        "good_lost": ("good", fails & ~gone),
        "toxic_lost": ("toxic", fails & ~gone),
    }
    sums = [F.sum(F.when(held, F.col(c)).otherwise(0)).alias(k) for k, (c, held) in where.items()]
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(*sums)
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return out.select("part", "filter_order", "step", *COUNTS, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    Null texts are empty, a null part is the empty string. Every row counts, repeated ones too; a row
    without an id has no labels and is no copy. Labels may repeat: an id is good (toxic) if any of its
    labels says so, and null labels say nothing. An empty table has no parts, so no rows; other columns
    are ignored. Texts are read once; what is shuffled is a digest a document.
    """
    filters = text_filters()
    masks = mask_documents(docs, filters, id_col, text_col, part_col)
    cells = materialize(count_cells(masks, labels, id_col))  # at most 32 rows a part
    discard(masks)
    return audit_orders(cells, "".join(filters) + "E")
