"""Vectorised scanning of text batches, shared by the operators that read whole documents.

A batch of documents is handled as one buffer: token boundaries come from comparing neighbouring
character classes and token keys from differences of prefix sums of a polynomial, so no Python
code runs per token. Every scan works on slices of at most ``CHUNK`` bytes (or one document).
"""

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
BLOCK = 1 << 19
U = np.uint64


def mix(x):
    """Bijective scrambling of 64-bit keys, so that ``x % n`` deals them evenly."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def slices(batch, text, limit=CHUNK, rows=30_000):
    """Consecutive slices of a record batch: at most ``rows`` rows and ``limit`` text bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        stop = min(stop, at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def buffer(column):
    """(bytes as uint8, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask, offsets):
    """Starts and ends of the runs of True in mask; a run never crosses an offset."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@cache
def _powers(base, size):
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(size, base, U)]))


#: (multiplier, its inverse modulo 2**64); multipliers are 3 modulo 4, so that swaps change the key.
BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x5851F42D4C957F2F, 0xD1342543DE82EF97)]
BYTES = [mix(np.arange(1, 257, dtype=U) * U(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Keys:
    """64-bit keys of any spans of one buffer of symbol values: equal spans, equal keys."""

    def __init__(self, values, both=True):
        self.sums, size = [], 1 << max(10, int(len(values[0])).bit_length())
        for (base, inverse), v in zip(BASES[: 1 + both], values):
            total = np.zeros(len(v) + 1, U)
            np.cumsum(v * _powers(base, size)[: len(v)], out=total[1:])
            self.sums.append((total, _powers(inverse, size)))

    def __call__(self, starts, ends):
        found = [(s[ends] - s[starts]) * p[starts] for s, p in self.sums]
        key = mix(found[0] + (ends - starts).astype(U))
        return mix(key ^ (found[1] * U(0x9FB21C651E98DF25))) if len(found) > 1 else key


def span_keys(values, starts, ends, both=True, openings=()):
    """Keys of spans in order that don't overlap; values(lo, hi) gives the symbol values of a part of the buffer.

    With openings, also a list of the keys of every span's first symbols, for each number of them. It
    works on blocks of about ``BLOCK`` symbols, cut between spans, so that memory doesn't follow the buffer.
    """
    found, a = [np.empty(len(starts), U) for _ in range(1 + len(openings))], 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        keys, first, last = Keys(values(lo, ends[b - 1]), both), starts[a:b] - lo, ends[a:b] - lo
        for out, n in zip(found, (None, *openings), strict=True):
            out[a:b] = keys(first, last if n is None else np.minimum(first + n, last))
        a = b
    return (found[0], found[1:]) if openings else found[0]


def word_keys(data, starts, ends, both=True, openings=()):
    """Keys of spans of a byte buffer, A-Z lower-cased; see span_keys()."""
    return span_keys(lambda lo, hi: [t[LOWER[data[lo:hi]]] for t in BYTES[: 1 + both]], starts, ends, both, openings)


def words(column, both=True):
    """(keys, document index, offsets) of the white-space separated words, A-Z lower-cased."""
    data, offsets = buffer(column)
    starts, ends = runs(~SPACE[data], offsets)
    return word_keys(data, starts, ends, both), np.searchsorted(offsets[1:], starts, "right"), offsets


#: The code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@cache
def unassigned():
    """Code points that this Python's Unicode tables don't know, and later tables may."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


@cache
def classes():
    """Class of every code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    kinds = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = 1
        elif k == "N":
            kinds[c] = 2
    kinds[WHITE] = 0
    return kinds


@cache
def library_classes():
    """The same classes as the tiktoken library has them, whose Unicode tables may be later ones.

    What a pattern doesn't match is left out of an encoding, so encoding all code points under a class as
    pattern gives those that the class holds.
    """
    from tiktoken import Encoding

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = np.full(0x110000, 3, np.uint8)
    for kind, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        one = Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        held = bytes(one.encode_ordinary(every)).decode()
        kinds[np.frombuffer(held.encode("utf-32-le"), np.uint32)] = kind
    return kinds


def codepoints(texts):
    """(joined text, code points, offsets) of a list of strings."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def contractions(points, first, opens):
    """Where an apostrophe that starts a match takes one or two letters: (places, letters).

    first: where matches start; opens: where documents start, which a match never crosses.
    """
    wide, shut = np.append(points, [0, 0]), np.append(opens, [True, True])
    at = np.flatnonzero(first & (points == 39))
    a, b = wide[at + 1], wide[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"]) & ~shut[at + 1]
    two = np.zeros(len(at), bool)
    for x, y in ("re", "ve", "ll"):
        two |= (a == ord(x)) & (b == ord(y))
    two &= ~shut[at + 1] & ~shut[at + 2]
    return at[one | two], np.where(one, 1, 2)[one | two]


def pieces(points, offsets, spaced, known=classes):
    """Starts and ends of the pieces that tokenizers split a text into before merging; known() gives the classes.

    spaced=True: runs of letters, of numbers and of other characters, each with one leading space,
    white space otherwise apart, so that pieces cover the text. spaced=False: white space dropped and
    every number character alone. Both split 's 't 're 've 'm 'll 'd from what follows them.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = known()[points]
    opens = np.zeros(n, bool)
    opens[offsets[:-1][offsets[:-1] < n]] = True
    first = opens.copy()
    first[1:] |= kinds[1:] != kinds[:-1]
    if spaced:
        after = np.flatnonzero(first[1:] & (kinds[:-1] == 0) & ~opens[1:]) + 1  # ends of white space inside a text
        first[after - 1] = True
        first[after[points[after - 1] == 32]] = False
    else:
        first |= kinds == 2
    at, letters = contractions(points, first, opens)
    first[at + 1] = False
    rest = at + 1 + letters
    rest = rest[rest < n]
    first[rest] = True
    if not spaced:
        first |= kinds == 0
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    keep = slice(None) if spaced else kinds[starts] > 0
    return starts[keep], ends[keep]


def point_keys(points, starts, ends):
    """Keys of spans of code points."""

    def values(lo, hi):
        v = points[lo:hi].astype(U) + U(1)
        return [mix(v * U(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    return span_keys(values, starts, ends)


def gather(lengths, starts, index):
    """Positions of the items of ragged rows ``index`` laid end to end, and the end of each."""
    n = lengths[index]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - n), n), ends
