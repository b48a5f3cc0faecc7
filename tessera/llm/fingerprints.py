"""SimHash fingerprints of documents and search by permuted block tables; DataFrame operations only.

A text's terms are its pairs of neighbouring words, weighted by how often they occur. Each term's
64-bit hash votes on 64 signed bits. Votes are counted four to a long, in lanes of 16 bits: sixteen
sums a text instead of 64, over chunks of terms that fit a lane.

Search cuts fingerprints into blocks. Two fingerprints within the radius agree on all blocks but
``radius`` of them, so they meet in one of the tables that bring the other blocks to the front.
"""

from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

LANES = 0x0001000100010001
CHUNK = 32_000
BLANKS = " \t\n\x0b\f\r"


def term_hashes(text: Column) -> Column:
    """Hashes of a text's terms, repeats included; the last word, or an empty text, is a term by itself."""
    words = F.split(F.lower(F.btrim(text, F.lit(BLANKS))), "[\\x20\\x09-\\x0D]+")
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def majority(chunks: Column) -> Column:
    """Fingerprint of a text from its chunks (structs of terms n and the sums): bits with over half the votes."""
    terms = F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + c["n"])

    def bit(total, b):
        lane = F.aggregate(
            chunks,
            F.lit(0).cast("long"),
            lambda a, c: a + F.call_function("shiftrightunsigned", F.get(c["sums"], F.pmod(b, F.lit(16))), (F.floor(b / 16) * 16).cast("int")).bitwiseAND(F.lit(0xFFFF)),
        )
        return total.bitwiseOR(F.when(2 * lane > terms, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def fingerprint_texts(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """rows' key columns (together unique) and, for each text column, its fingerprint as ``fp_<name>``."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(t).alias("text")) for i, t in enumerate(texts))))
    # hashes become a column before they are exploded: else every term's row carries a copy of the text
    hashed = rows.select(*keys, each.alias("t")).select(*keys, F.col("t.which").alias("which"), term_hashes(F.col("t.text")).alias("hashes"))
    terms = hashed.select(*keys, "which", F.posexplode("hashes").alias("at", "h"))
    chunk = F.expr(f"at div {CHUNK}").alias("chunk")
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES))).alias(f"s{j}") for j in range(16)]
    sums = terms.groupBy(*keys, "which", chunk).agg(F.count("*").alias("n"), *votes)
    part = F.struct("which", "n", F.array(*(f"s{j}" for j in range(16))).alias("sums"))
    whole = sums.select(*keys, part.alias("part")).groupBy(*keys).agg(F.collect_list("part").alias("parts"))
    own = lambda i: majority(F.filter("parts", lambda p: p["which"] == i))
    return whole.select(*keys, *(own(i).alias(f"fp_{t}") for i, t in enumerate(texts)))


#: Sub-ranges that one id, or all rows without one, can be dealt into.
FINE = 1 << 20


def followers(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, text and next_text: the text of the row with the next lower id; after the lowest comes the highest.

    Null texts are empty ones; rows of equal id follow each other by a hash of the text and then the text,
    null ids come last. Rows are ordered inside ranges of ids, and of hashes where one id fills more than
    a range; to the end of each range is added the head of the range below it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    points, total, without = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n), F.count("*"), F.count_if(F.col("id").isNull())).first()
    cuts = sorted({*(points or [])}) or [0]  # fewer than n numbers
    step = isqrt(len(cuts)) + 1
    listed = lambda v: F.array(*map(F.lit, v)).cast("array<long>")
    coarse = F.size(F.filter(listed(cuts[::step]), lambda c: c < F.col("id")))
    near = F.slice(listed(cuts), F.greatest((coarse - 1) * step, F.lit(0)) + 1, F.lit(step))
    spot = F.greatest((coarse - 1) * step, F.lit(0)) + F.size(F.filter(near, lambda c: c < F.col("id")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # a frequent id is the highest of its range: its rows come first, by hash; fewer than n ids
    often = {r.id: r["count"] for r in rows.where("id is not null").groupBy("id").count().where(F.col("count") > 2 * total / n).collect()}
    often |= {None: without} if without > 2 * total / n else {}
    place = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 44)  # rises with h
    share = lambda k: F.floor(place * min(FINE - 1, -(-k * n // max(1, total))) / FINE)
    fine = F.lit(FINE - 1).cast("long")
    for key, k in often.items():
        fine = F.when(F.col("id").eqNullSafe(F.lit(key)), share(k)).otherwise(fine)
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(spot).cast("long") * FINE + (FINE - 1 - fine))
    tops = rows.groupBy("range").agg(F.min(F.struct(-F.col("id"), "h")).alias("top"))  # a row a range
    order = Window.orderBy(F.desc("range"))
    tops = tops.select(F.lag("range").over(order).alias("before"), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"), F.col("range").alias("of"), "top")
    tops = tops.select(F.coalesce("before", "lowest").alias("into"), "of", F.col("top.col1").alias("low_id"), F.col("top.h").alias("low_h"))
    heads = rows.join(F.broadcast(tops), (rows.range == tops.of) & (-rows.id).eqNullSafe(tops.low_id) & (rows.h == tops.low_h)).groupBy("into").agg(F.min("text").alias("text"))
    ends = heads.select(F.lit(None).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("h"), F.col("into").alias("range"), F.lit(True).alias("end"))
    whole = rows.withColumn("end", F.lit(False)).unionByName(ends)
    inside = Window.partitionBy("range").orderBy("end", F.desc_nulls_last("id"), "h", "text")
    return whole.withColumn("next_text", F.lead("text").over(inside)).where("not end").select("id", "text", "next_text")


def tables(bits: int, blocks: int, radius: int) -> list[int]:
    """Masks of the permuted tables: all choices of blocks - radius blocks that come to the front."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius=3, blocks=6) -> DataFrame:
    """(query, fp, distance): all fingerprints ``fp`` within ``radius`` bits of each ``query``, each pair once.

    Both sides are signed longs and are made distinct first, so copies don't multiply; a fingerprint
    finds itself. A pair is given by the first table in which its front blocks agree.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in tables(64, blocks, radius)]

    def keyed(df, name):
        keys = F.explode(F.array(*(F.struct(F.lit(i).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("front")) for i, m in enumerate(masks))))
        return df.select(name).where(F.col(name).isNotNull()).distinct().select(name, keys.alias("k")).select(name, "k.table", "k.front")

    left, right = keyed(queries, "query"), keyed(fps, "fp")
    differ = left.query.bitwiseXOR(right.fp)
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(differ.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    meet = (left.table == right.table) & (left.front == right.front) & (F.bit_count(differ) <= radius) & (left.table == first)
    return left.hint("merge").join(right, meet).select("query", "fp", F.bit_count(differ).alias("distance"))


def likeness(a, b) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def hexadecimal(c) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def fingerprint_edits(docs: DataFrame, id_col="doc_id", text_col="text", every=20, radius=3) -> DataFrame:
    """Fingerprints of every row's text and of that text with its last third replaced.

    The last floor(n/3) code points give way to the first as many (or all) of the following row's
    text, by followers(). Gives id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and, for rows whose id is divisible by ``every`` (else null), n_near: how many other
    fingerprints of the table lie within ``radius`` bits of theirs. Null text is empty; repeated rows are kept; an empty table gives an empty result;
    other columns are ignored. Equal texts have equal fingerprints.
    """
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("next_text", F.lit(1), third))
    known = lambda c: F.struct(F.xxhash64(c), F.xxhash64(c, F.lit(1)))  # noqa: E731  stands for a text
    rows = followers(docs, id_col, text_col).select("id", "text", n.alias("n_chars"), known("text").alias("this"), known("next_text").alias("that"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "id", "n_chars", "edited_sha256", "this", "that"]
    found = materialize(fingerprint_texts(rows, keys, ["text", "edited"]).drop("row"))
    # stored, so that joins on a text with many copies can be split
    by_text = materialize(found.groupBy("this").agg(F.first("fp_text").alias("fp_next")).withColumnRenamed("this", "that"))
    asked = F.col("id") % every == 0
    near = near_fingerprints(found.select(F.col("fp_text").alias("fp")), found.where(asked).select(F.col("fp_text").alias("query")), radius)
    near = materialize(near.groupBy("query").agg((F.count("*") - 1).alias("n_near")).withColumnRenamed("query", "fp_text"))
    out = found.join(by_text, "that").join(near, "fp_text", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        hexadecimal("fp_text").alias("fingerprint"),
        hexadecimal("fp_edited").alias("edited_fingerprint"),
        likeness("fp_text", "fp_edited").alias("near_edited"),
        likeness("fp_text", "fp_next").alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
    )
