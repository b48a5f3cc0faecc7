"""Byte-level BPE by prefix dynamic programming, exact under the merge rules of the vocabulary.

Every prefix of a byte string has one valid last token: the token that ends the prefix's own
encoding. It is the one that fits the prefix and whose predecessor, the last token of the shorter
prefix, stays apart from it under the merges. Storing the last token of every prefix gives the
encoding of any prefix by walking back, appends by adding entries, and edits by recomputing
entries only until they agree with the old ones.
"""

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Memo
from .textscan import codepoints, gather, library_classes, pieces, point_keys, slices


class Vocabulary:
    """Token bytes and their merge ranks (= ids)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path):
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """Encoding by repeatedly merging the leftmost adjacent pair of lowest rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for a byte, None if merges never make it."""
        if token not in self._halves:
            data = self.tokens[token]
            rank = self.ranks.pop(data)  # merged without the last step
            parts = self.merge(data) if len(data) > 1 else [token, token]
            self.ranks[data] = rank
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two adjacent tokens leaves exactly these two.

        The bytes next to the seam grow by merges inside either token, in order of rank. The seam holds
        unless at some moment the parts touching it have a merge that comes before both of their own next
        merges; a tie in rank goes to the merge further left.
        """
        known = self._apart.get((left, right))
        if known is None:
            known = self._apart[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left, right):
        lefts, rights = [left], [right]  # the parts at the seam, from whole down to a byte
        while len(self.tokens[lefts[-1]]) > 1:
            lefts.append(self.halves(lefts[-1])[1])
        while len(self.tokens[rights[-1]]) > 1:
            rights.append(self.halves(rights[-1])[0])
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            across = self.ranks.get(self.tokens[lefts[i]] + self.tokens[rights[j]])
            next_left = lefts[i - 1] if i else None  # rank at which the left part grows
            next_right = rights[j - 1] if j else None
            if across is not None and (next_left is None or across < next_left) and (next_right is None or across <= next_right):
                return False
            if next_left is None and next_right is None:
                return True
            if next_right is None or (next_left is not None and next_left <= next_right):
                i -= 1
            else:
                j -= 1


class PrefixTable:
    """The last token of every prefix of a growing and editable byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _entry(self, data, last, end):
        ranks, v = self.vocabulary.ranks, self.vocabulary
        for start in range(max(0, end - v.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and (v.halves(token) is not None) and (start == 0 or v.apart(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self._entry(self.data, self.last, end))

    def edit(self, start: int, removed: int, inserted: bytes) -> int:
        """Replace bytes and repair the table; returns how many entries were computed anew."""
        old, shift = self.last, len(inserted) - removed
        self.data = self.data[:start] + inserted + self.data[start + removed :]
        self.last, same, reach = old[: start + 1], 0, self.vocabulary.longest
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(self.data, self.last, end))
            after = end - start - len(inserted)
            same = same + 1 if after > 0 and self.last[-1] == old[end - shift] else 0
            if same >= reach and after >= reach:  # later entries read nothing that changed
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece: the piece's own id if it is a token, else the walk back through its prefix table."""
    own = vocabulary.ranks.get(piece)
    return [own] if own is not None else PrefixTable(vocabulary, piece).tokens()


@cache
def _loaded(path):
    vocabulary = Vocabulary.load(path)
    size = max(vocabulary.tokens, default=0) + 1
    lengths = np.zeros(size, np.int64)
    for i, t in vocabulary.tokens.items():
        lengths[i] = len(t)
    flat = np.frombuffer(b"".join(vocabulary.tokens.get(i, b"") for i in range(size)), np.uint8)
    return vocabulary, lengths, np.cumsum(lengths) - lengths, flat, Memo()


def token_ids(texts, path):
    """(ids of all texts laid end to end as uint32, end of each text among them)."""
    vocabulary, *_, memo = _loaded(path)
    joined, points, offsets = codepoints([t or "" for t in texts])
    starts, ends = pieces(points, offsets, True, library_classes)
    keys, first, at = np.unique(point_keys(points, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first].tolist(), ends[first].tolist()

    def encode(missing):
        for i in missing:
            yield np.array(encode_piece(vocabulary, joined[a[i] : b[i]].encode("utf-8", "surrogatepass")), np.uint32).tobytes()

    coded = memo.get(keys.tolist(), encode)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    flat = np.frombuffer(b"".join(coded), np.uint32)
    place, done = gather(sizes, np.cumsum(sizes) - sizes, at)
    return flat[place], np.concatenate([[0], done])[np.searchsorted(starts, offsets[1:])]


def decode(ids, path) -> bytes:
    """The bytes that ids stand for."""
    _, lengths, starts, flat, _ = _loaded(path)
    return flat[gather(lengths, starts, ids)[0]].tobytes()


def encode_documents(docs: DataFrame, path: str, id_col="doc_id", text_col="text", keep_ids=True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every row's whole text, null as empty.

    The ids are decoded again for the second digest. Repeated rows are encoded row by row, an empty
    table gives an empty result, other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, ends = token_ids(part.column(1).to_pylist(), path)
                own = np.split(ids.astype("<u4"), ends[:-1])
                lists = {"ids": pa.array([x.tolist() for x in own], pa.list_(pa.int32()))} if keep_ids else {}
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "n_tokens": pa.array([len(x) for x in own], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in own],
                        "decoded_sha256": [hashlib.sha256(decode(x, path)).hexdigest() for x in own],
                        **lists,
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
