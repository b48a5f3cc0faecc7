"""Packing documents into fixed-length training sequences as a cutting-stock problem.

Every document becomes token ids and one end id, cut into pieces of ``length`` ids and a remainder.
A linear program over the histogram of remainders chooses how often to use which pattern (a set of
size classes that fits a sequence); columns are generated by an unbounded-knapsack dynamic program
on the dual prices. The solution is rounded down, what is left goes first-fit-decreasing into further
patterns, and pieces take the patterns' places by their rank among the pieces of their size class.
"""

import json
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .textscan import codepoints, gather, pieces, point_keys, slices, unassigned

LENGTH = 2048
STEP = 8
END = 1


class Memo:
    """key -> encoded bytes of recent pieces, in two generations of bounded size."""

    def __init__(self, size=150_000):
        self.size, self.young, self.old = size, {}, {}

    def get(self, keys, encode):
        """The value of every key; encode(indices) gives those that are missing."""
        young, old, out, missing = self.young, self.old, [None] * len(keys), []
        for i, k in enumerate(keys):
            value = young.get(k)
            if value is None:
                value = old.get(k)
                if value is None:
                    missing.append(i)
                    continue
                young[k] = value
            out[i] = value
        for i, value in zip(missing, encode(missing), strict=True):
            out[i] = young[keys[i]] = value
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


@cache
def _tokenizer(path):
    """(tokenizer, the same without its normalizer, which ids end a word, memo, strings of added tokens)."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    plain = Tokenizer.from_str(json.dumps(json.loads(model.to_str()) | {"normalizer": None}))
    last = np.zeros(model.get_vocab_size(), bool)
    for token, i in model.get_vocab().items():
        last[i] = token.endswith("</w>")
    return model, plain, last, Memo(), [t.content for t in model.get_added_tokens_decoder().values()]


def encode_words(words, path):
    """Token ids of each normalised word by itself, as uint32 bytes: many words a call, cut at word-ending tokens."""
    _, model, last, *_ = _tokenizer(path)
    out = []
    for at in range(0, len(words), 512):
        some = words[at : at + 512]
        ids = np.array(model.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(last[ids]) + 1
        if len(cuts) == len(some):
            out += [p.tobytes() for p in np.split(ids, cuts[:-1])]
        else:  # a word that the tokenizer splits or drops
            out += [np.array(model.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in some]
    return out


def normalise(text):
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # character by character, so without a final sigma


def _split_ids(joined, points, offsets, path):
    """(ids of all normalised texts laid end to end, end of each), each distinct piece encoded once."""
    starts, ends = pieces(points, offsets, spaced=False)
    keys, first, at = np.unique(point_keys(points, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first].tolist(), ends[first].tolist()
    coded = _tokenizer(path)[3].get(keys.tolist(), lambda m: encode_words([joined[a[i] : b[i]] for i in m], path))
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    flat = np.frombuffer(b"".join(coded), np.uint32)
    place, done = gather(sizes, np.cumsum(sizes) - sizes, at)
    return flat[place], np.concatenate([[0], done])[np.searchsorted(starts, offsets[1:])]


def token_ids(texts, path):
    """(ids of all texts laid end to end, end of each text among them), as the library gives them.

    Texts that hold the string of an added token, or a code point that this Python's Unicode tables
    don't know, go to the library whole.
    """
    model, *_, added = _tokenizer(path)
    known = [normalise(t or "") for t in texts]
    joined, points, offsets = codepoints(known)
    high = np.flatnonzero(points > 0x2FF)  # all below are assigned
    strange = high[unassigned()[points[high]]]
    apart = {*(np.searchsorted(offsets, strange, "right") - 1).tolist()}
    apart |= {i for i, (n, t) in enumerate(zip(known, texts, strict=True)) if any(a in n or a in (t or "") for a in added)}
    if not apart:
        return _split_ids(joined, points, offsets, path)
    ids, ends = _split_ids(*codepoints(["" if i in apart else k for i, k in enumerate(known)]), path)
    each = [np.array(model.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in apart else p for i, p in enumerate(np.split(ids, ends[:-1]))]
    return np.concatenate(each), np.cumsum([len(p) for p in each])


def cut_documents(docs, path, length=LENGTH, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32 and doc_tokens, from whole texts (null: empty)."""

    def cut(batches):
        end = np.array([END], "<u4")
        for batch in batches:
            for part in slices(batch, 1):
                ids, ends = token_ids(part.column(1).to_pylist(), path)
                rows, at = [], 0
                for doc, stop in enumerate(ends.tolist()):
                    own = np.concatenate([ids[at:stop].astype("<u4"), end])
                    at = stop
                    for s in range(0, len(own), length):
                        piece = own[s : s + length]
                        rows.append((doc, s, len(piece), zlib.crc32(piece), len(own)))
                doc, *numbers = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.record_batch([part.column(0).take(doc), *numbers], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices, capacity):
    """Unbounded knapsack by dynamic programming: sizes 1..capacity with prices[size]; (value, counts)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    items = np.flatnonzero(prices > 1e-12)
    for room in range(1, capacity + 1):
        best[room], pick[room] = best[room - 1], 0
        some = items[items <= room]
        if len(some):
            value = prices[some] + best[room - some]
            k = int(np.argmax(value))
            if value[k] > best[room] + 1e-12:
                best[room], pick[room] = value[k], some[k]
    counts, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        if pick[room]:
            counts[pick[room]] += 1
            room -= pick[room]
        else:
            room -= 1
    return best[capacity], counts


def cutting_stock(demand, capacity):
    """Integer patterns that cover a histogram: [(uses, counts by size)], near the fewest sequences.

    demand[s]: how many items of size s (1..capacity). The linear program is solved by the revised
    simplex method from one homogeneous pattern per size, until no pattern's price is above one or,
    where pivots change nothing any more, until twice as many of these as there are sizes.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    need = demand[sizes].astype(float)
    columns = [np.where(sizes == s, capacity // s, 0).astype(float) for s in sizes]
    inverse, uses = np.diag([1 / c[i] for i, c in enumerate(columns)]), need.copy()
    for i, c in enumerate(columns):
        uses[i] /= c[i]
    least, still = uses.sum(), 0
    while still <= 2 * len(sizes):
        prices = np.zeros(capacity + 1)
        prices[sizes] = np.maximum(inverse.sum(0), 0)
        value, counts = best_pattern(prices, capacity)
        if value <= 1 + 1e-7:
            break
        column = counts[sizes].astype(float)
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, uses / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        uses = np.maximum(uses - ratio[out] * step, 0)
        uses[out] = ratio[out]
        columns[out] = column
        inverse[out] /= step[out]
        rest = np.arange(len(sizes)) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
        still = 0 if uses.sum() < least - 1e-9 * max(1.0, least) else still + 1
        least = min(least, uses.sum())
    found, left = [], demand[sizes].astype(np.int64)
    for n, c in zip(uses, columns, strict=True):
        c = c.astype(np.int64)
        n = min(int(n + 1e-6), int((left[c > 0] // c[c > 0]).min()))
        if n:
            left -= n * c
            found.append((n, c))
    open_: list[tuple[int, np.ndarray]] = []  # (room, counts) of what rounding left, largest first
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            k = next((k for k, (room, _) in enumerate(open_) if room >= sizes[i]), None)
            if k is None:
                open_.append((capacity, np.zeros(len(sizes), np.int64)))
                k = len(open_) - 1
            room, c = open_[k]
            c[i] += 1
            open_[k] = (room - int(sizes[i]), c)
    out = []
    for n, c in found + [(1, c) for _, c in open_]:
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = c
        out.append((n, full))
    return out


class Places:
    """Sequence and slot of the item of each rank among the items of its size."""

    def __init__(self, patterns, capacity):
        rows: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        done = np.zeros(capacity + 1, np.int64)
        base = 0
        for uses, counts in patterns:
            slot = 0
            for s in np.flatnonzero(counts)[::-1].tolist():
                rows[s].append((int(done[s]), base, int(counts[s]), slot))
                done[s] += uses * counts[s]
                slot += int(counts[s])
            base += uses
        self.rows = [np.array(r, np.int64).reshape(-1, 4) for r in rows]
        self.sequences = base

    def __call__(self, size, rank):
        """Arrays (sequence, slot) for ranks of one size."""
        table = self.rows[size]
        row = table[np.searchsorted(table[:, 0], rank, "right") - 1]
        at = rank - row[:, 0]
        return row[:, 1] + at // row[:, 2], row[:, 3] + at % row[:, 2]


def pack(docs: DataFrame, path: str, length=LENGTH, step=STEP, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    path: the tokenizer's file. Size classes are ``step`` ids wide. Null and empty texts have one id,
    the end. Repeated rows and ids are packed row by row; a null id stays null. Pieces of one
    sequence lie gapless from offset 0. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    capacity = length // step
    kind = F.ceil(F.col("length") / step).cast("int")
    cut = cut_documents(docs, path, length, id_col, text_col).withColumn("size", kind)
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()))  # tells equal rows apart
    demand = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("size").count().collect():  # at most ``capacity`` rows
        demand[r["size"]] = r["count"]
    full = demand[capacity]
    demand[capacity] = 0
    whole = np.zeros(capacity + 1, np.int64)
    whole[capacity] = 1
    patterns = ([(int(full), whole)] if full else []) + cutting_stock(demand, capacity)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column("size").to_numpy()
            order = np.argsort(size, kind="stable")
            ranked = size[order]
            new = np.diff(ranked, prepend=-1) != 0
            place = np.arange(len(size)) - np.maximum.accumulate(np.where(new, np.arange(len(size)), 0))
            local = np.empty(len(size), np.int64)
            local[order] = place + seen[ranked]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part)), pa.array(local)], [*b.schema.names, "part", "local"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    order = ["size", "id", "start", "ids_crc32", "row"]
    ordered = cut.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = materialize(ordered.mapInArrow(number, f"{columns}, part long, local long"))
    # a size's pieces lie in consecutive partitions: at most ``capacity`` rows more than partitions
    counts = ranked.groupBy("size", "part").count().collect()
    before, seen = {}, np.zeros(capacity + 1, np.int64)
    for size, part, n in sorted(counts):
        before[size, part] = int(seen[size])
        seen[size] += n
    shared = spark.sparkContext.broadcast((before, Places(patterns, capacity)))

    def place(batches):
        before, places = shared.value
        for b in batches:
            size, part, local = (b.column(c).to_numpy() for c in ("size", "part", "local"))
            sequence, slot = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            both = size.astype(np.int64) << 32 | part
            for k in np.unique(both).tolist():
                at = np.flatnonzero(both == k)
                sequence[at], slot[at] = places(k >> 32, local[at] + before[k >> 32, k & 0xFFFFFFFF])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])

    placed = ranked.mapInArrow(place, f"{columns}, part long, local long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
