"""Hierarchical Pitman-Yor language model over words, fitted and applied without leaving the cluster.

Three levels: a restaurant for every preceding word, told apart by the whole word; one parent that all
contexts share; and the add-one distribution of the whole corpus as base.

The cells (context, word) are dealt to tasks by their context, one task for ``BUCKET`` bytes of text;
those of a context with at least ``ROOM`` occurrences by their words too, so that a task's size is
bounded. Tasks are where cells lie and nothing else: in every sweep they send what they hold of each
word's tables to the word's reader, which adds it up over all tasks, seats the parent and answers; the
tables of a context that lies in several tasks, and the sizes of the parent, are added up as well. So
every sweep sees the totals of the whole corpus.

Words become numbers first: every slice of documents sends its distinct words once to the words'
owners, which count them and number them by training count within ``NUMBERS`` groups of words, however
many owners there are. Words are told apart by 64-bit keys, without comparing their letters.

Seating is Gibbs-sampled for all cells at once: given a cell's customers, its number of tables has the
law S_d(c, t) * a**t, with generalised Stirling numbers S_d and a the mass of a new table under the
parent's current predictive probability. Cells of more than ``EXACT`` customers are seated by binomial
leaps of the sequential seating, an approximation. Predictive probabilities are averaged over the
samples and rounded to 32 bits a token. A draw comes from the seed, the sweep and the cell's numbers
alone, so that neither the number of tasks, nor rows outside the training set, nor a repeated task
changes a score.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint, discard, drop_shuffles, materialize
from .textscan import U, mix, slices, words

END = U(0x3C79AC492BA7B653)
OWNER = U(0x5BD1E995)
SLICE = 4 << 20
BUCKET = 6 << 20
NUMBERS = 1 << 16
FAN = 8
ROOM = 1 << 18
EXACT = 256
STRENGTH = 1.0


def _pack(*arrays):
    """Arrays, byte plane by byte plane, compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob, *parts):
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    for kind, n in parts:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return out


def _tokens(column):
    """(keys, document index, tokens per document): the words and one end for each document."""
    keys, doc, offsets = words(column)
    n = len(offsets) - 1
    sizes = np.bincount(doc, minlength=n) + 1
    seq, of = np.full(len(keys) + n, END), np.repeat(np.arange(n), sizes)
    seq[np.arange(len(keys)) + doc] = keys
    return seq, of, sizes


def _cuts(groups):
    """Bounds of the runs of equal values of a sorted array."""
    return [*np.flatnonzero(np.diff(groups, prepend=groups[0] - 1)).tolist(), len(groups)] if len(groups) else []


TEXTS = {"number": "long", "ids": "array<long>", "train": "array<boolean>", "sizes": "array<long>", "tokens": "binary"}
SENT = TEXTS | {"part": "int", "n": "int", "words": "binary"}
COUNTED = {"number": "long", "part": "int", "n": "int", "words": "binary", "tokens": "long", "known": "long", "often": "array<struct<id:long,n:long>>"}


def _schema(kinds):
    return ", ".join(f"{k} {v}" for k, v in kinds.items())


def _batch(rows, kinds):
    """A record batch of dictionaries; what a row doesn't have is null."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<struct<id:long,n:long>>": pa.list_(pa.struct({"id": pa.int64(), "n": pa.int64()}))}
    return pa.record_batch([pa.array([r.get(k) for r in rows], types[v]) for k, v in kinds.items()], list(kinds))


def _group(keys):
    """The group in which a word is numbered."""
    return (mix(keys ^ OWNER) % U(NUMBERS)).astype(np.int64)


def _encode(source, owners) -> DataFrame:
    """Of every slice a row of its documents as places among its words, owner by owner, and its words for each owner."""

    def scan(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                number = (task << 32) | made
                made += 1
                train = part.column(2).to_numpy(zero_copy_only=False)
                seq, of, sizes = _tokens(part.column(1))
                keys, at = np.unique(seq, return_inverse=True)
                every, trained = np.bincount(at, minlength=len(keys)), np.bincount(at[train[of]], minlength=len(keys))
                owner = _group(keys) % owners
                order = np.argsort(owner, kind="stable")
                place = np.empty(len(keys), "<u4")
                place[order] = np.arange(len(keys))
                rows = [{"number": number, "ids": part.column(0).to_pylist(), "train": train.tolist(), "sizes": sizes.tolist(), "tokens": _pack(place[at]), "n": len(keys)}]
                for a, b in zip(cuts := _cuts(owner[order]), cuts[1:], strict=False):
                    own = order[a:b]
                    rows.append({"number": number, "part": int(owner[own[0]]), "n": b - a, "words": _pack(keys[own], every[own].astype("<u4"), trained[own].astype("<u4"))})
                yield _batch(rows, SENT)

    return source.mapInArrow(scan, _schema(SENT))


def _count(sent, owners, least) -> DataFrame:
    """For every slice and owner the words' numbers and training counts, and a row of totals an owner (number -1).

    A word's number is its rank by training count in its group times ``NUMBERS``, plus the group: a word that is
    trained on has the same number whatever the owners and the other rows are.
    often: the words with at least ``least`` occurrences, and their training counts.
    """

    def count(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["number"])
        if not rows:
            return
        part = rows[0]["part"]
        found = [_unpack(r["words"], ("<u8", r["n"]), ("<u4", r["n"]), ("<u4", r["n"])) for r in rows]
        keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        every, n = (np.bincount(at, np.concatenate([f[k] for f in found]), len(keys)).astype(np.int64) for k in (1, 2))
        order, rank = np.lexsort((keys, -n, group := _group(keys))), np.empty(len(keys), np.int64)
        first = _cuts(group[order])
        rank[order] = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
        ids, done = rank * NUMBERS + group, 0
        for r in rows:
            own = at[done : done + r["n"]]
            done += r["n"]
            yield _batch([{"number": r["number"], "part": part, "n": r["n"], "words": _pack(ids[own], n[own])}], COUNTED)
        often = [{"id": i, "n": k} for i, k in zip(ids[every >= least].tolist(), n[every >= least].tolist(), strict=True)]
        yield _batch([{"number": -1, "part": part, "tokens": int(n.sum()), "known": int(np.count_nonzero(n)), "often": often}], COUNTED)

    dealt = sent.where("part is not null").select("number", "part", "n", "words").repartitionById(owners, F.col("part"))
    return dealt.mapInArrow(count, _schema(COUNTED))


class Corpus:
    """What every task knows of the corpus: sizes that don't grow, and the frequent contexts."""

    def __init__(self, rows, owners):
        self.owners, self.readers = owners, math.ceil(owners / FAN)
        self.tokens, self.known = sum(r.tokens for r in rows), sum(r.known for r in rows)
        self.total = self.tokens + self.known + 1
        often = sorted((w.id, w.n) for r in rows for w in r.often)
        self.often = np.array([w[0] for w in often], np.int64)
        self.often_n = np.array([w[1] for w in often], np.int64)

    def base(self, n):
        return (n + 1) / self.total

    def hot(self, ids):
        """Place of each word among the frequent contexts, or -1."""
        if not len(self.often):
            return np.full(len(ids), -1)
        near = np.minimum(np.searchsorted(self.often, ids), len(self.often) - 1)
        return np.where(self.often[near] == ids, near, -1)

    def task(self, ids):
        return (mix(ids.astype(U)) % U(self.owners)).astype(np.int64)


class Slice:
    """The cells of one slice by the numbers of (context, word), each with its task; tokens as places of cells."""

    def __init__(self, row, corpus):
        found = [_unpack(r["words"], ("<i8", r["n"]), ("<i8", r["n"])) for r in sorted(row["words"], key=lambda r: r["part"])]
        ids, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order, place = np.argsort(ids), np.empty(len(ids), np.int64)
        self.ids, self.n, place[order] = ids[order], n[order], np.arange(len(ids))
        (at,) = _unpack(row["tokens"], ("<u4", sum(row["sizes"])))
        self.at = place[at]
        ends = np.cumsum(row["sizes"]) - 1
        before = np.concatenate([[self.at[ends[0]]], self.at[:-1]])
        cells, self.cell = np.unique(before * row["n"] + self.at, return_inverse=True)
        self.context, self.word = cells // row["n"], cells % row["n"]
        home = corpus.task(self.ids)
        hot = corpus.hot(self.ids)[self.context] >= 0
        self.to = np.where(hot, home[self.context] + self.ids[self.word], home[self.context]) % corpus.owners
        self.order = np.argsort(self.to.astype(np.int32), kind="stable")
        self.of = np.repeat(np.arange(len(row["sizes"])), row["sizes"])


def _deal(coded, corpus) -> DataFrame:
    """Every slice's cells and their training customers, to their tasks."""

    def rows(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                s, out = Slice(row, corpus.value), []
                count = np.bincount(s.cell, np.array(row["train"])[s.of], len(s.word))
                for a, b in zip(cuts := _cuts(s.to[s.order]), cuts[1:], strict=False):
                    mine = s.order[a:b]
                    first = _cuts(s.context[mine])
                    heads = s.ids[s.context[mine[first[:-1]]]]
                    blob = _pack(heads, np.diff(first).astype("<u4"), s.ids[s.word[mine]], s.n[s.word[mine]], count[mine].astype("<u4"))
                    out.append({"part": int(s.to[mine[0]]), "number": row["number"], "n": b - a, "heads": len(heads), "cells": blob})
                yield _batch(out, DEALT)

    return coded.mapInArrow(rows, _schema(DEALT)).repartitionById(corpus.value.owners, F.col("part"))


DEALT = {"part": "int", "number": "long", "n": "int", "heads": "int", "cells": "binary"}
SCORED = {"number": "long", "part": "int", "n": "int", "scores": "binary"}


#: What tasks and readers send each other. CELLS: a task's cells; PLACES: of a slice's cells among them; SUMS: tables
#: of its words to a reader, and REPLY: their totals and the parent's tables; TABLES: of its cells with several
#: customers; HELD and READ: ones, twos, customers and tables that are added up over tasks, and over readers.
CELLS, PLACES, SUMS, REPLY, TABLES, HELD, READ = range(7)
FIT = {"kind": "int", "part": "int", "reader": "int", "number": "long", "n": "int", "heads": "int", "words": "int", "blob": "binary", "ones": "long", "twos": "long", "customers": "long", "tables": "long", "often": "array<struct<id:long,n:long>>"}


class Cells:
    """The cells that one task holds, by the numbers of (context, word); its words by (reader, number)."""

    def __init__(self, row, corpus):
        self.part, self.corpus = row["part"], corpus
        kinds = ("<i8", row["heads"]), ("<u4", row["heads"]), ("<i8", row["words"]), ("<i8", row["words"]), ("<u4", row["n"]), ("<u4", row["n"])
        self.contexts, sizes, self.ids, self.n, word, c = _unpack(row["blob"], *kinds)
        self.context, self.word, self.c = np.repeat(np.arange(len(sizes)), sizes), word.astype(np.int64), c.astype(np.int64)
        self.live = np.flatnonzero(self.c > 1)
        self.often = corpus.hot(self.contexts)
        own = np.bincount(self.context, self.c, len(sizes))
        self.customers = np.where(self.often >= 0, corpus.often_n[self.often], own) if len(corpus.often) else own

    @staticmethod
    def rows(dealt, corpus):
        """The row of CELLS of what was dealt to a task, and of PLACES for every slice."""
        found = [_unpack(r["cells"], ("<i8", r["heads"]), ("<u4", r["heads"]), ("<i8", r["n"]), ("<i8", r["n"]), ("<u4", r["n"])) for r in dealt]
        join = lambda k: np.concatenate([f[k] for f in found])
        contexts, at = np.unique(join(0), return_inverse=True)
        ids, first, word = np.unique(join(2), return_index=True, return_inverse=True)
        n = join(3)[first]
        pairs, pair = np.unique(np.repeat(at, join(1)) * len(ids) + word, return_inverse=True)
        c = np.bincount(pair, join(4), len(pairs))
        order, place = np.lexsort((ids, ids % corpus.readers)), np.empty(len(ids), "<u4")
        place[order] = np.arange(len(ids))
        sizes = np.bincount(pairs // len(ids), minlength=len(contexts))
        blob = _pack(contexts, sizes.astype("<u4"), ids[order], n[order], place[pairs % len(ids)], c.astype("<u4"))
        yield {"kind": CELLS, "part": dealt[0]["part"], "n": len(pairs), "heads": len(contexts), "words": len(ids), "blob": blob}
        done = 0
        for r in dealt:
            own = pair[done : done + r["n"]]
            done += r["n"]
            yield {"kind": PLACES, "part": r["part"], "number": r["number"], "n": r["n"], "blob": _pack(np.diff(own, prepend=0).astype("<u4"))}

    def messages(self, t, sweep):
        """Given the cells' tables: what goes to the readers, and what is added up of frequent contexts."""
        reader, c0 = self.ids % self.corpus.readers, np.bincount(self.word, t, len(self.ids)).astype(np.int64)
        for a, b in zip(cuts := _cuts(reader), cuts[1:], strict=False):
            yield {"kind": SUMS, "part": self.part, "reader": int(reader[a]), "n": b - a, "blob": _pack(self.ids[a:b], self.n[a:b], c0[a:b])}
        tables, hot = np.bincount(self.context, t, len(self.contexts)).astype(np.int64), np.flatnonzero(self.often >= 0)
        often = [{"id": i, "n": k} for i, k in zip(self.often[hot].tolist(), tables[hot].tolist(), strict=True)]
        ones, twos = (np.count_nonzero(self.c == k) for k in (1, 2))
        mine = {"part": self.part, "reader": self.part % self.corpus.readers}
        yield mine | {"kind": HELD, "ones": ones, "twos": twos, "often": often}
        if sweep:
            yield mine | {"kind": TABLES, "n": len(self.live), "blob": _pack(t[self.live].astype("<u4"))}

    def tables(self, news):
        """Tables of every cell, from the news of a sweep; without any, one a cell."""
        t = np.minimum(self.c, 1)
        for r in news:
            if r["kind"] == TABLES:
                t[self.live] = _unpack(r["blob"], ("<u4", r["n"]))[0]
        return t

    def given(self, news, fit):
        """Mass of a new table in every context, and the parent's probability of every word, after a sweep."""
        opened = np.bincount(self.context, self.tables(news), len(self.contexts))
        if len(self.corpus.often):
            opened = np.where(self.often >= 0, fit["often"][self.often], opened)
        found = [_unpack(r["blob"], ("<i8", r["n"]), ("<i8", r["n"])) for r in sorted(news, key=lambda r: r["reader"]) if r["kind"] == REPLY]
        c0, t0 = (np.concatenate(x) for x in zip(*found, strict=True))
        return STRENGTH + fit["d1"] * opened, parent(c0, t0, self.corpus.base(self.n), fit["d0"], fit["customers"], fit["tables"])


class Draws:
    """Uniform numbers, one for each key, that hang on the key and the seed alone."""

    def __init__(self, keys, *seed):
        for s in seed:
            keys = mix(keys.astype(U) + mix([s + 1]))
        self.keys = keys

    def random(self, n):
        self.keys = mix(self.keys + OWNER)
        return (self.keys[:n] >> U(11)) * 2.0**-53


def log_stirling(discount, size=EXACT):
    """log of generalised Stirling numbers S_d(c, t), for c and t up to size; -inf outside."""
    table = np.full((size + 1, size + 2), -np.inf)
    table[1, 1] = 0
    t = np.arange(size + 2)
    for c in range(1, size):
        stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        table[c + 1] = np.logaddexp(np.concatenate([[-np.inf], table[c, :-1]]), table[c] + stay)
    return table[:, : size + 1]


def seat(c, mass, discount, table, rng):
    """Numbers of tables for cells of c customers, drawn given the mass of opening a new one; one random number a cell."""
    t, draw = np.minimum(c, 1), rng.random(len(c))
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    for a, b in zip(cuts := _cuts(c[small]), cuts[1:], strict=False):
        at, n = small[a:b], int(c[small[a]])
        for part in np.array_split(at, 1 + len(at) * n // 500_000):
            w = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(mass[part])[:, None]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            t[part] = 1 + (w < draw[part][:, None] * w[:, -1:]).sum(1)
    for k in np.flatnonzero(c > EXACT).tolist():
        own, size, a, tables, done = np.random.Generator(np.random.PCG64(int(draw[k] * 2**53))), int(c[k]), float(mass[k]), 1, 1
        while done < size:
            step = min(max(done // 4, 1), size - done)
            tables += int(own.binomial(step, min(max(a / (a + done - discount * tables), 0.0), 1.0)))
            done += step
        t[k] = tables
    return t


def discount(one, two):
    """From the numbers of ones and twos, as for absolute discounting."""
    return float(np.clip(one / max(1, one + 2 * two), 0.1, 0.95))


def _discount(counts):
    return discount(np.count_nonzero(counts == 1), np.count_nonzero(counts == 2))


def parent(c0, t0, base, d0, customers, tables):
    """The parent's probabilities of words with c0 customers at t0 tables, given those of all words."""
    return (c0 - d0 * t0 + (STRENGTH + d0 * tables) * base) / (STRENGTH + customers)


def chance(c, t, new, below, d1, customers):
    """Predictive probabilities of cells, given the mass of a new table in their contexts."""
    return (c - d1 * t + new * below) / (STRENGTH + customers)


def predictive(c, context, word, base, hot, rooms, burn, samples, rng):
    """Averaged predictive probability of every cell of a model that lies in one place: the fit's sweeps in plain order.

    c, context, word: customers and places of the cells; base: of every word; hot: of every context,
    whether it is a room of a divided one, seated on the base itself and not on the parent;
    rooms: per context (share of the context's customers that the room gets, the base's share of it).
    """
    n_contexts, n_words = len(hot), len(base)
    customers, mine, live = np.bincount(context, c, n_contexts), ~hot[context], np.flatnonzero(c > 1)
    share, part = rooms
    t, mean = np.minimum(c, 1), np.zeros(len(c))
    d1, d0 = _discount(c), _discount(np.bincount(word[mine], t[mine], n_words))
    table1, table0 = log_stirling(d1), log_stirling(d0)
    for sweep in range(burn + samples + 1):  # the first has one table a cell, and one a word
        c0 = np.bincount(word[mine], t[mine], n_words).astype(np.int64)
        t0 = seat(c0, (STRENGTH + d0 * t0.sum()) * base, d0, table0, rng) if sweep else np.minimum(c0, 1)
        above = parent(c0, t0, base, d0, c0.sum(), t0.sum())
        below = np.where(mine, above[word], base[word] / part[context])
        new = (STRENGTH + d1 * np.bincount(context, t, n_contexts))[context]
        if sweep > burn:
            mean += chance(c, t, new, below, d1, customers[context])
        if sweep < burn + samples:
            t[live] = seat(c[live], (new * below)[live], d1, table1, rng)
    return mean / samples * share[context]


def _hold(dealt, corpus) -> DataFrame:
    """Every task's cells as they stay during the fit, and its first messages, of one table a cell."""

    def hold(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["number"])
        if not rows:
            return
        for made in Cells.rows(rows, corpus.value):
            if made["kind"] == CELLS:
                cells = Cells(made, corpus.value)
                yield _batch([made, *cells.messages(cells.tables([]), 0)], FIT)
            else:
                yield _batch([made], FIT)

    return dealt.mapInArrow(hold, _schema(FIT))


def _read(sent, corpus, fit, seed, sweep) -> DataFrame:
    """What the readers answer to a sweep's messages; other rows pass."""

    def read(batches):
        asked = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == SUMS:
                    asked.append(row)
                else:
                    yield _batch([row], FIT)
        if not asked:
            return
        found = [_unpack(r["blob"], ("<i8", r["n"]), ("<i8", r["n"]), ("<i8", r["n"])) for r in asked]
        ids, first, at = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        n = np.concatenate([f[1] for f in found])[first]
        c0 = np.bincount(at, np.concatenate([f[2] for f in found]), len(ids)).astype(np.int64)
        t0 = np.minimum(c0, 1)
        if sweep:
            t0 = seat(c0, (STRENGTH + fit["d0"] * fit["tables"]) * corpus.value.base(n), fit["d0"], log_stirling(fit["d0"]), Draws(ids, seed, sweep, 0))
        done = 0
        for r in asked:
            own = at[done : done + r["n"]]
            done += r["n"]
            yield _batch([{"kind": REPLY, "part": r["part"], "reader": r["reader"], "n": r["n"], "blob": _pack(c0[own], t0[own])}], FIT)
        ones, twos = (np.count_nonzero(c0 == k) for k in (1, 2))
        yield _batch([{"kind": READ, "ones": ones, "twos": twos, "customers": int(c0.sum()), "tables": int(t0.sum())}], FIT)

    return sent.repartitionById(corpus.value.readers, F.col("reader")).mapInArrow(read, _schema(FIT))


def _totals(news, corpus, before) -> dict:
    """The few numbers of a sweep that every task needs: added up by Spark over tasks and readers."""
    sums = {r.kind: r for r in news.where(F.col("kind").isin(HELD, READ)).groupBy("kind").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("ones", "twos", "customers", "tables"))).collect()}
    often = np.zeros(len(corpus.often), np.int64)
    if len(often) and sums:
        for r in news.where(F.col("kind") == HELD).select(F.explode("often").alias("o")).groupBy("o.id").agg(F.sum("o.n").alias("n")).collect():
            often[r.id] = r.n
    first = before or {f"d{k}": discount(sums[kind].ones, sums[kind].twos) if kind in sums else 0.5 for k, kind in ((1, HELD), (0, READ))}
    found = {k: sums[READ][k] if READ in sums else 0 for k in ("customers", "tables")}
    return {"d1": first["d1"], "d0": first["d0"], "often": often} | found


def _meet(held, news, corpus) -> DataFrame:
    """Every task's cells with the news of some sweeps for it; only the news are shuffled."""
    told = reduce(DataFrame.union, [rows.where(F.col("kind").isin(REPLY, TABLES)).select("part", "kind", "reader", "n", "blob", F.lit(sweep).alias("sweep")) for sweep, rows in news])
    told = told.repartition(corpus.owners, "part").groupBy("part").agg(F.collect_list(F.struct("sweep", "kind", "reader", "n", "blob")).alias("news"))
    return held.where(F.col("kind") == CELLS).select("part", "n", "heads", "words", "blob").join(told, "part")


def _sweep(met, corpus, fit, seed, sweep) -> DataFrame:
    """Seats every cell anew, given the news of the sweep before; gives the messages of this one."""

    def step(batches):
        table = log_stirling(fit["d1"])
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                cells = Cells(row, corpus.value)
                (new, above), at, t = cells.given(row["news"], fit), cells.live, cells.tables([])
                context, word = cells.context[at], cells.word[at]
                keys = mix(cells.contexts.astype(U))[context] + cells.ids.astype(U)[word]
                t[at] = seat(cells.c[at], new[context] * above[word], fit["d1"], table, Draws(keys, seed, sweep, 1))
                for made in cells.messages(t, sweep):
                    yield _batch([made], FIT)

    return met.mapInArrow(step, _schema(FIT))


def _score(met, corpus, fits) -> DataFrame:
    """For every slice and task the log10 probabilities of its cells, in the order that they came in."""

    def score(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                cells = Cells(row, corpus.value)
                mean = np.zeros(len(cells.c))
                for sweep, fit in fits.items():
                    news = [r for r in row["news"] if r["sweep"] == sweep]
                    new, above = cells.given(news, fit)
                    mean += chance(cells.c, cells.tables(news), new[cells.context], above[cells.word], fit["d1"], cells.customers[cells.context])
                value = np.log10(mean / len(fits)).astype("<f4")
                for r in row["places"]:
                    (step,) = _unpack(r["blob"], ("<u4", r["n"]))
                    yield _batch([{"number": r["number"], "part": cells.part, "n": r["n"], "scores": _pack(value[np.cumsum(step, dtype=np.int64)])}], SCORED)

    return met.mapInArrow(score, _schema(SCORED))


def _fit(dealt, corpus, burn, samples, seed) -> DataFrame:
    """Sweep after sweep over the tasks' cells, then the scores that the last ``samples`` sweeps average to."""
    known, spark = corpus.value, dealt.sparkSession
    made = materialize(_hold(dealt, corpus))
    drop_shuffles(spark)  # what was dealt, before the cells are dealt so that joins find them
    held = checkpoint(made.where(F.col("reader").isNull()).select("kind", "part", "number", "n", "heads", "words", "blob").repartition(known.owners, "part"))
    drop_shuffles(spark)
    news, fit, kept = materialize(_read(made.where(F.col("reader").isNotNull()), corpus, None, seed, 0)), None, {}
    discard(made)
    drop_shuffles(spark)
    for sweep in range(burn + samples + 1):
        if sweep:
            sent = _sweep(_meet(held, [(sweep - 1, news)], known), corpus, fit, seed, sweep)
            before, news = news, materialize(_read(sent, corpus, fit, seed, sweep))
            if sweep - 1 not in kept:
                discard(before)
            drop_shuffles(spark)
        fit = _totals(news, known, fit)
        if sweep > burn:
            kept[sweep] = news, fit
    places = held.where(F.col("kind") == PLACES).groupBy("part").agg(F.collect_list(F.struct("number", "n", "blob")).alias("places"))
    met = _meet(held, [(sweep, rows) for sweep, (rows, _) in kept.items()], known).join(places, "part")
    return _score(met, corpus, {sweep: totals for sweep, (_, totals) in kept.items()})


def _gather(coded, corpus) -> DataFrame:
    kinds = {"id": "long", "train": "boolean", "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}

    def gather(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                s, docs = Slice(row, corpus.value), len(row["ids"])
                value = np.empty(len(s.word))
                value[s.order] = np.concatenate([_unpack(r["scores"], ("<f4", r["n"]))[0] for r in sorted(row["scores"], key=lambda r: r["part"])])
                n = s.n[s.at]
                add = lambda x: np.bincount(s.of, x, docs)  # noqa: B023, E731
                found = [row["ids"], row["train"], row["sizes"], add(n > 0).astype(np.int64), add(np.log10(corpus.value.base(n))), add(value[s.cell])]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(found, types, strict=True)], list(kinds))

    return coded.mapInArrow(gather, _schema(kinds))


def score_texts(docs: DataFrame, train, id_col="doc_id", text_col="text", burn=2, samples=3, seed=11, buckets=None) -> DataFrame:
    """Scores every row's whole text by a model of the rows where the boolean column ``train`` holds.

    Gives id, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (both log10 of the
    text's probability) and perplexity per token. ``buckets``: number of tasks that hold
    the cells, by default one for ``BUCKET`` bytes of text; scores don't hang on it. Null text is an empty one: its only token is the end. Repeated rows and
    ids count and are scored row by row; ids are whole numbers, a null one is kept; a null ``train`` is false; a long text is
    scored whole. Without training rows every token has probability one under either model. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = buckets or max(1, math.ceil(size / BUCKET))
    parts = max(1, math.ceil(size / (2 * SLICE)))  # a few slices a task
    sent = materialize(_encode(source, owners))
    counted = materialize(_count(sent, owners, ROOM))
    # sizes, and one entry for ROOM tokens at most
    corpus = spark.sparkContext.broadcast(Corpus(counted.where("number = -1").collect(), owners))

    def joined(rows, more, name):
        return rows.join(more.repartition(parts, "number").groupBy("number").agg(F.collect_list(F.struct("part", "n", name)).alias(name)), "number")

    texts = sent.where("part is null").select(*TEXTS, "n").repartition(parts, "number")
    coded = checkpoint(joined(texts, counted.where("number >= 0"), "words"))
    discard(sent, counted)
    drop_shuffles(spark)
    scored = _fit(_deal(coded, corpus), corpus, burn, samples, seed)
    rows = _gather(joined(coded, scored, "scores"), corpus)
    total = F.lit(corpus.value.tokens).cast("long").alias("train_tokens")
    return rows.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", total, "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
