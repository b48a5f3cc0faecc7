"""Ids of odd code points and combining marks, against the tokenizer libraries themselves."""

import random
import time

import numpy as np
import public_tokenizers
import tiktoken.load
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, packing, textscan

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def split(ids, ends):
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_byte_ids_of_odd_code_points():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(BPE), special_tokens={})
    own, later = textscan.classes(), textscan.library_classes()
    strange = np.flatnonzero(own != later)
    assert {0x1C89, 0xA7CB, 0x105C0} <= {*strange.tolist()}
    assert textscan.unassigned()[strange].all()
    points = [*strange.tolist(), *(c for c in random.Random(1).sample(range(0x110000), 4000) if not 0xD800 <= c < 0xE000)]
    texts = [form.replace("c", chr(c)) for c in points for form in ("c's", "c'll", "ac", " c", "1c", "c c\n")]
    assert split(*byte_bpe.token_ids(texts, BPE)) == library.encode_ordinary_batch(texts)


def test_classes_are_made_fast():
    textscan.library_classes.cache_clear()
    began = time.perf_counter()
    textscan.library_classes()
    assert time.perf_counter() - began < 10


def test_word_ids_of_combining_marks():
    model, r = Tokenizer.from_file(WORD), random.Random(3)
    marks = [chr(c) for c in (0x300, 0x301, 0x307, 0x31F, 0x323, 0x327, 0x345, 0x130, 0x1E9E, 0x3A3, 0x212B, 0x1100, 0x1161, 0x11A8, 0xFB01, 0x200D, 0x1F600)]
    texts = ["aİ̟b", *("".join(r.choice([*"abİΣ 1'sée\n", *marks]) for _ in range(r.randrange(1, 14))) for _ in range(40_000))]
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert split(*packing.token_ids(texts, WORD)) == want
