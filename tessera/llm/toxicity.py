"""Toxicity by a chain of linear classifiers over hashed words.

The chain predicts one category after another; the model of each also reads the probabilities of
the categories before it, which in training are out-of-fold predictions. Features are the presence
of words (letters, A-Z lower-cased) and of their first bytes; a feature is known by its 64-bit key.
Models are fitted on a bounded sample of labelled rows and all features that several of them share;
every document is scored in full.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import discard, materialize
from .textscan import U, buffer, mix, runs, slices, word_keys

PREFIXES = (4, 5, 6, 8)
#: Squared z-score at which a feature counts half.
DOUBT = 12.0
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(column):
    """(keys, document index): every word and every opening of a longer word, repeats included."""
    data, offsets = buffer(column)
    starts, ends = runs(LETTER[data], offsets)
    doc = np.searchsorted(offsets[1:], starts, "right")
    long = [ends - starts > p for p in PREFIXES]
    whole, opened = word_keys(data, starts, ends, openings=PREFIXES)
    found = [whole, *(keys[m] for m, keys in zip(long, opened, strict=True))]
    return np.concatenate(found), np.concatenate([doc, *(doc[m] for m in long)])


def _unique(keys, doc):
    """Each feature once a document."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], doc[new]


@dataclass
class Lexicon:
    """The features a model reads, in order of their keys, found by a table of the keys' first bits."""

    keys: np.ndarray
    slots: np.ndarray = field(init=False)
    shift: int = field(init=False)

    def __post_init__(self):
        bits = max(10, int(4 * len(self.keys)).bit_length())
        self.shift = 64 - bits
        slot = (self.keys >> U(self.shift)).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange((1 << bits) + 1)).astype(np.int32)  # where each slot's keys start

    def __call__(self, keys, doc):
        """(document, number of the feature) of each feature that occurs, once a document."""
        slot = (keys >> U(self.shift)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        live, hits = np.flatnonzero(at < end), []
        while len(live):
            hit = self.keys[at[live]] == keys[live]
            hits.append(live[hit])
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        hit = np.concatenate(hits) if hits else live
        both = np.unique(doc[hit] * max(1, len(self.keys)) + at[hit])
        return both // max(1, len(self.keys)), both % max(1, len(self.keys))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """A 0/1 matrix by rows and by columns, equal columns merged; rows: the row of each entry, in order.

    ``group`` is the merged column of each column, ``many`` how many are merged in each.
    """

    def __init__(self, rows, cols, n, width):
        marks = mix(np.arange(1, n + 1, dtype=U))
        sums = [np.zeros(width, U) for _ in range(2)]
        for k, out in enumerate(sums):
            own = mix(marks + U(k))
            for a in range(0, len(rows), 1 << 20):  # by parts, as the driver has little room
                np.add.at(out, cols[a : a + (1 << 20)], own[rows[a : a + (1 << 20)]])
        _, self.first, self.group, self.many = np.unique(np.column_stack(sums).view(np.dtype((np.void, 16))).ravel(), return_index=True, return_inverse=True, return_counts=True)
        keep = np.zeros(width, bool)
        keep[self.first] = True
        keep = keep[cols]
        rows, cols = rows[keep], self.group.astype(np.int32)[cols[keep]]
        self.n, self.width = n, len(self.first)
        self.cols, self.rows = cols, rows[np.argsort(cols, kind="stable")]
        sizes = np.bincount(rows, minlength=n), np.bincount(cols, minlength=self.width)
        self.full = [np.flatnonzero(k) for k in sizes]
        self.starts = [(np.cumsum(k) - k)[f] for k, f in zip(sizes, self.full, strict=True)]

    def _sum(self, values, side, n):
        out = np.zeros(n)
        if len(values):
            out[self.full[side]] = np.add.reduceat(values, self.starts[side])
        return out

    def times(self, weights):
        return self._sum(weights[self.cols], 0, self.n)

    def score(self, weights):
        """Of the weights of all columns, merged ones too."""
        return self.times(weights[self.first] * self.many)

    def back(self, values):
        return self._sum(values[self.rows], 1, self.width)


def evidence(x: Sparse, y, use, doubt=DOUBT):
    """Scale of each column: its squared z-score for y among the rows in use, over that plus ``doubt``."""
    n, rate = x.back(use), (y * use).sum() / max(1, use.sum())
    square = (x.back(y * use) - n * rate) ** 2 / np.maximum(n * max(rate * (1 - rate), 1e-9), 1e-9)
    return square / (square + doubt)


def logistic(x: Sparse, dense, y, use, penalty=1.0, steps=40):
    """Weights (sparse features, dense columns, intercept) of a logistic regression on the rows in use, by accelerated descent.

    A ridge penalty whose strength on a feature falls with its evidence: none is left out, few count much.
    """
    use = use.astype(float)
    width, scale = x.width, evidence(x, y, use) * np.sqrt(x.many)
    # diagonal bound on curvature: features of a row share its gradient
    row = (x.times(scale**2) + (dense**2).sum(1) + 1) * use
    step = 1 / (0.25 * np.concatenate([scale**2 * x.back(row), dense.T**2 @ row, [row.sum()]]) + penalty)
    w = np.zeros(width + dense.shape[1] + 1)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        error = (sigmoid(x.times(scale * z[:width]) + dense @ z[width:-1] + z[-1]) - y) * use
        slope = np.concatenate([scale * x.back(error), dense.T @ error, [error.sum()]])
        slope[:-1] += penalty * z[:-1]
        nxt = z - step * slope
        up = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = nxt + (t - 1) / up * (nxt - w), nxt, up
    return np.concatenate([(scale * w[:width] / x.many)[x.group], w[width:]])


@dataclass
class Chain:
    """Fitted chain: weights and decision threshold of each category, in order."""

    categories: list[str]
    lexicon: Lexicon
    weights: list[np.ndarray]
    thresholds: list[float]

    def __call__(self, doc, feature, n):
        width, found = len(self.lexicon.keys), np.zeros((n, 0))
        for w in self.weights:
            score = np.bincount(doc, w[feature], n) + found @ w[width:-1] + w[-1]
            found = np.column_stack([found, sigmoid(score)])
        return found


def best_threshold(p, y):
    """The threshold with the best F1, halfway to the next lower score; 1.1, which rejects nothing, without positives."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def fit_chain(docs, labels, categories, id_col="doc_id", text_col="text", sample=10_000, sample_bytes=64 << 20, folds=5, seed=5) -> Chain:
    """Fit on at most ``sample`` labelled ids (the lowest hashes), one text each, and all features of several of them.

    Texts count up to ``sample_bytes`` together: in the order of the hashes, one that doesn't fit any more is left out.

    labels has the id and one 0/1 column a category; several rows of an id count as their maximum, a
    null as 0. Of the texts of a repeated id the first in order is read. A feature of one text alone
    says nothing of others. Without labels, or without a category's positives, nothing is that category.
    """
    votes = [F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")).alias(c) for c in categories]
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*votes).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("text").alias("text"), *(F.max(c).alias(c) for c in categories))
    stored = rows = materialize(rows)  # at most ``sample`` texts
    sizes = rows.select(F.xxhash64(F.lit(seed), "id").alias("h"), "id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()  # a row a text
    room, over = sample_bytes, []
    for r in sorted(sizes):
        if r.n <= room:
            room -= r.n
        else:
            over.append(r.id)
    if over:
        left_out = docs.sparkSession.createDataFrame([(i,) for i in over], "id long")
        rows = rows.join(F.broadcast(left_out), "id", "left_anti")
    n = len(categories)

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found, times = np.unique(_unique(*features(part.column(1)))[0], return_counts=True)
                yield pa.record_batch({"key": found.view(np.int64), "n": times.astype(np.int64)})

    if rows.isEmpty():
        return Chain(list(categories), Lexicon(np.zeros(0, U)), [np.array([*[0.0] * k, -9.0]) for k in range(n)], [1.1] * n)
    counts = rows.select("id", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    lexicon = Lexicon(np.sort(counts.where("n > 1").select("key").toArrow()["key"].to_numpy().view(U)))

    def encode(batches):
        for batch in batches:
            for part in slices(batch, 1):
                doc, feature = lexicon(*features(part.column(1)))
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature.astype(np.int32)))
                yield pa.record_batch({"id": part.column(0), "features": lists, **{f"y{k}": part.column(2 + k) for k in range(n)}})

    data = rows.mapInArrow(encode, "id long, features array<int>, " + ", ".join(f"y{k} int" for k in range(n))).toArrow()
    discard(stored)
    data = data.sort_by("id")
    lists = data["features"].combine_chunks()
    y = np.column_stack([data[f"y{k}"].to_numpy() for k in range(n)]).astype(float)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy())
    x, width = Sparse(rows, lists.flatten().to_numpy(), len(y), len(lexicon.keys)), len(lexicon.keys)
    del data, lists, rows
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    weights, thresholds, before = [], [], np.zeros((len(y), 0))
    for k in range(n):
        out = np.zeros(len(y))
        for f in range(folds):
            w = logistic(x, before, y[:, k], fold != f)
            out = np.where(fold == f, x.score(w[:width]) + before @ w[width:-1] + w[-1], out)
        out = sigmoid(out)
        weights.append(logistic(x, before, y[:, k], np.ones(len(y))))
        thresholds.append(best_threshold(out, y[:, k]))
        before = np.column_stack([before, out])
    return Chain(list(categories), lexicon, weights, thresholds)


def score_toxicity(docs: DataFrame, chain: Chain, text_col="text") -> DataFrame:
    """docs with ``p_<category>`` and ``is_<category>`` for each category, from the whole text.

    Null and empty texts have no features and get the intercepts' probabilities. Rows, repeated ones
    included, keep all their columns; a column of docs with one of the new names is replaced. An empty
    table gives an empty result.
    """
    names = [f"{a}_{c}" for c in chain.categories for a in ("p", "is")]
    docs = docs.drop(*names)
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    model = spark.sparkContext.broadcast(chain)  # features of at most ``sample`` texts

    def score(batches):
        fitted = model.value
        for batch in batches:
            for part in slices(batch, at):
                p = fitted(*fitted.lexicon(*features(part.column(at))), part.num_rows)
                new = []
                for k, t in enumerate(fitted.thresholds):
                    new += [pa.array(p[:, k]), pa.array(p[:, k] >= t)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots can't be given to a function
    schema = StructType(list(plain.schema.fields))
    for name in names:
        schema = schema.add(name, "boolean" if name.startswith("is_") else "double")
    return plain.mapInArrow(score, schema).toDF(*docs.columns, *names)


CATEGORIES = ("low_quality", "toxic")


def corpus_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain low quality -> toxic, fitted on the labels table."""
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return fit_chain(docs, known, CATEGORIES)
