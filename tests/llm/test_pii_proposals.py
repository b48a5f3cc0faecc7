"""Spans that gazetteers and contexts propose: planted, labelled ones found, decoys left, EM deciding."""

import random
import re

import pytest

from tessera.llm import pii
from tests.llm.test_text_ops import slow_base

COUNTRIES = ["DE", "GB", "NL", "ES", "FR", "BE"]


def account(r, good):
    country = r.choice(COUNTRIES)
    body = "".join(r.choice("0123456789") for _ in range(pii.IBAN_LENGTHS[country] - 4))
    number = int("".join(str(int(x, 36)) for x in body + country + "00"))
    check = 98 - number % 97
    plain = country + f"{check if good else (check + 7) % 97 + 1:02d}" + body
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if r.random() < 0.5 else plain


def planted(seed, n=500):
    """(texts, the spans in each that are personal data beyond the base patterns)."""
    r = random.Random(seed)
    given, last = ["John", "Maria", "Sophie", "Peter", "Laura"], ["Smith", "Garcia", "Müller", "Dubois", "Rossi"]
    filler = ["the river was high", "we met again", "it rained in the valley", "nobody knew why", "they went home"]
    texts, truth = [], []
    for i in range(n):
        person, year = f"{r.choice(given)} {r.choice(last)}", r.randrange(1930, 2005)
        ssn = f"{r.randrange(1, 600):03d}-{r.randrange(1, 99):02d}-{r.randrange(1, 9999):04d}"
        good = [
            ("bank account ", account(r, True), "iban"),
            ("please transfer to IBAN ", account(r, True), "iban"),
            ("her SSN is ", ssn, "id"),
            ("passport number ", f"{r.choice('CXL')}{r.randrange(10**7, 10**8)}", "id"),
            ("we asked Dr. ", person, "name"),
            ("my name is ", person, "name"),
            ("she lives at ", f"{r.randrange(1, 300)} {r.choice(['Baker', 'Mill', 'Long'])} {r.choice(['Street', 'Road', 'Lane'])}", "address"),
            ("born on ", f"{year}-{r.randrange(1, 13):02d}-{r.randrange(1, 28):02d}", "birth"),
            ("geboren am ", f"{r.randrange(1, 28)}.{r.randrange(1, 13)}.{year}", "birth"),
        ]
        bad = [
            ("part code ", account(r, False), "iban"),
            ("serial order ", f"{r.choice(['000', '666', '950'])}-{r.randrange(1, 99):02d}-0000", "id"),
            ("version born of build ", f"{r.randrange(3000, 9000)}-{r.randrange(13, 99)}-{r.randrange(40, 99)}", "birth"),
        ]
        lead, span, kind = r.choice(good if i % 4 else bad)
        text = f"{r.choice(filler)}, {lead}{span} {r.choice(filler)}, mail a{i}@b.com"
        texts.append(text)
        at = text.index(span)
        truth.append({(kind, at, at + len(span))} if i % 4 else set())
    return texts, truth


@pytest.fixture(scope="module")
def detector(spark):
    texts, _ = planted(1)
    return pii.fit_detector(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_planted_spans_are_added_and_decoys_left(detector):
    texts, truth = planted(2)
    found = wanted = right = 0
    for text, want in zip(texts, truth, strict=True):
        base, spans = detector.spans(text)
        assert base == slow_base(text) and {*base} <= {*spans}
        own = {*spans} - {*base}
        found, wanted, right = found + len(own), wanted + len(want), right + len(own & want)
    print(f"precision {right / found:.3f}, recall {right / wanted:.3f} of {wanted}")
    assert right / found >= 0.9 and right / wanted >= 0.9


def test_reliabilities_change_the_outcome():
    """Where most labelers err, equal votes accept what the estimated reliabilities reject."""
    r = random.Random(5)
    right = [0.52, 0.97, 0.55, 0.95, 0.5]  # pattern, gazetteer and boundary hardly tell anything here
    counts, truth = {}, []
    for _ in range(5000):
        z = r.random() < 0.4
        votes = tuple(1 if (r.random() < p) == z else -1 for p in right)
        counts["iban", votes] = counts.get(("iban", votes), 0) + 1
        truth.append((votes, z))
    belief = pii.estimate(counts)
    weighed = sum((belief["iban", v] > 0.5) == z for v, z in truth) / len(truth)
    equal = sum((sum(v) > 0) == z for v, z in truth) / len(truth)
    assert weighed > equal + 0.1 and weighed > 0.9
    assert belief["iban", (1, -1, 1, -1, 1)] < 0.5 < belief["iban", (-1, 1, -1, 1, -1)]


def test_proposals_of_odd_and_long_texts():
    kinds = lambda t: [(c.kind, t[c.start : c.end]) for c in pii.candidates(t) if not c.base]
    assert kinds("") == kinds("Dr. ") == kinds("born 99.99") == []
    assert kinds("Calle de Alcalá, 45. Hauptstraße 12a") == [("address", "Calle de Alcalá, 45"), ("address", "Hauptstraße 12a")]
    assert kinds("Me llamo Juan Pérez-Díaz y vivo") == [("name", "Juan Pérez-Díaz")]
    assert kinds("mail 123-45-6789@x.com") == []  # inside a base span
    assert [k for k, _ in kinds("IBAN DE89 3704 0044 0532 0130 00")] == ["iban"]
    for text in ("Dr. Ann " * 200_000, "AB12" + "0000" * 500_000, "born " * 400_000 + "1", "12 Abc " * 300_000 + "Street", "ssn " + "x" * 10**6 + "1"):
        assert isinstance(kinds(text), list)
    assert pii.mask("I am Dr. Tom Hill.", [("name", 9, 17)]) == "I am Dr. [NAME]."
    assert all(re.fullmatch("[a-z]+", k) for k in pii.ALL)
