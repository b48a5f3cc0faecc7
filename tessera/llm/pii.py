"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are the spans of the base patterns, of wider ones (spelled-out addresses, national phone
numbers, short card numbers, IPv6), and what gazetteers and contexts propose by themselves: account
numbers by country, streets by their endings, names by titles; national ids, names and dates of birth by
the words that lead to them. Five labelers vote for, against or abstain on each: pattern, validity,
gazetteer, context and boundary. Expectation-maximisation over the counts of all
documents' vote patterns estimates each labeler's reliability by kind; its posteriors train a
logistic span classifier on a bounded sample of candidates. Base spans always stay; the classifier
decides about the others.
"""

import datetime
import hashlib
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import discard, materialize
from .textscan import slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds without a base pattern, which come after these.
PROPOSED = ("iban", "id", "name", "address", "birth")
ALL = KINDS + PROPOSED
#: Linear-time forms of the base patterns: a digit run has one possible start and end.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)+", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone": re.compile(r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-.])[2-9][0-9]{2}[-.][0-9]{4}"),
}
#: Without a match of these a wide pattern has none.
NEEDS = {"email": re.compile(r"[\[(]at[\])]", re.I), "ip": re.compile(":"), "phone": re.compile(r"[0-9][-.][0-9]{4}")}
DIGIT = re.compile(r"[0-9]")
NO_DIGITS = re.compile(r"[^0-9]")
#: Gazetteers: endings of addresses, phone country codes, first digits of card issuers.
ENDINGS = frozenset("com org net edu gov mil int info biz io ai dev app de fr es it uk us ca au nl be ch at se no fi dk pl pt br mx jp cn in ru eu".split())
COUNTRIES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "94", "98")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
CUES = {
    "email": frozenset("email mail contact write address reach e-mail correo courriel".split()),
    "ip": frozenset("ip host server client address login from addr gateway".split()),
    "card": frozenset("card credit visa mastercard amex payment pay debit karte carte tarjeta".split()),
    "phone": frozenset("call phone tel telephone mobile fax cell contact dial telefon teléfono".split()),
}
CUES |= {
    "iban": frozenset("iban account bank transfer konto bankverbindung cuenta compte".split()),
    "id": frozenset("ssn social security passport national identity id nss dni pasaporte passeport ausweis steuer".split()),
    "name": frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora name named called heiße llamo appelle".split()),
    "address": frozenset("address live lives living at home adresse wohnt wohne habite vive dirección domicilio".split()),
    "birth": frozenset("born birth birthday dob geboren geburtsdatum né née nacido nacida nacimiento".split()),
}
#: Lengths of account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}
GIVEN = frozenset("alice amy andrea andrew anna antonio bob carlos carmen charles claire daniel david elena emily emma eva frank george hans helen isabel jack james jane javier jean john jorge josé juan julia karl kate laura louis lucas lucía maria marie mark martin mary michael miguel nina oliver olivia pablo paul peter pierre robert sarah sofia sophie susan thomas tom ursula victor walter william".split())
WORD_NAME = r"[A-ZÀ-ÖØ-Þ][^\W\d_]{1,24}(?:['’-][^\W\d_]{1,24})?"
NAMES = rf"({WORD_NAME}(?: {WORD_NAME}){{0,2}})"
DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])"
#: By kind: strings of which a text must hold one, and patterns whose first group is the span.
PROPOSALS = {
    "iban": ((), [r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"]),
    "id": (
        ("-",),
        [r"(?<![0-9A-Za-z-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])"],
    ),
    "name": (
        ("Mr", "Ms", "Dr", "Prof", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor", "name", "Name", "heiße", "llamo", "appelle"),
        [
            rf"(?<!\w)(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?)\.? {NAMES}",
            rf"(?<!\w)(?:[Mm]y name is|[Nn]ame:|[Ii]ch heiße|[Mm]e llamo|[Jj]e m'appelle) {NAMES}",
        ],
    ),
    "address": (
        ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "straße", "strasse", "platz", "gasse", "rue ", "Calle ", "Avenida ", "Plaza "),
        [
            rf"(?<![\w.-])([0-9]{{1,5}} (?:{WORD_NAME} ){{1,3}}(?:Street|Road|Avenue|Lane|Drive|Boulevard))(?!\w)",
            r"(?<!\w)([A-ZÄÖÜ][^\W\d_]{1,30}(?:straße|strasse|platz|gasse) [0-9]{1,4}[a-z]?)(?!\w)",
            rf"(?<![\w.-])([0-9]{{1,4}},? rue (?:de la |de |du |des )?{WORD_NAME})",
            rf"(?<!\w)((?:Calle|Avenida|Plaza) (?:de la |del |de )?{WORD_NAME},? [0-9]{{1,4}})(?!\w)",
        ],
    ),
    "birth": (
        ("born", "Born", "birth", "Birth", "DOB", "eboren", "eburtsdatum", "né le", "née le", "nacid", "nacimiento"),
        [rf"(?:[Bb]orn|[Bb]irth(?:day|date)?|DOB|[Gg]eboren|[Gg]eburtsdatum|née? le|nacid[oa]|nacimiento)[^\n0-9]{{0,20}}{DATE}"],
    ),
}
PROPOSALS = {k: (needs, [re.compile(p) for p in patterns]) for k, (needs, patterns) in PROPOSALS.items()}
CUED_ID = re.compile(r"(?i:ssn|social security|passport|passeport|pasaporte|national id|identity card|dni|nss|ausweis)[^\n0-9]{0,24}?((?<![A-Za-z0-9])[A-Z]{0,2}[0-9][0-9A-Z-]{5,13})(?![0-9A-Za-z-])")
ID_NEEDS = ("ssn", "SSN", "ocial", "assp", "asap", "ational", "dentity", "dni", "DNI", "nss", "NSS", "usweis")
AGAINST = frozenset("version v isbn issn doi sha md5 token id serial order invoice section chapter table build uuid".split())
LABELERS = 5
WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
BINS = 64


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain.domain``, found from the at signs, in linear time."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def valid(kind: str, span: str) -> bool:
    """What a base match must also satisfy."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in span.split(".")))
    digits = NO_DIGITS.sub("", span)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...] = ()
    words: tuple[str, ...] = ()


def real_date(span: str) -> tuple[bool, int]:
    """Whether the date exists, day first unless the year is; and its year."""
    parts = [int(x) for x in re.split("[./-]", span)]
    year, month, day = parts if "-" in span else parts[::-1]
    try:
        datetime.date(year, month, day)
    except ValueError:
        return False, year
    return True, year


def _opinions(kind: str, span: str) -> tuple[bool, bool, bool]:
    """What pattern, validity and gazetteer say of a span of a proposed kind."""
    if kind == "iban":
        plain = span.replace(" ", "")
        number = "".join(str(int(x, 36)) for x in plain[4:] + plain[:4])
        return len(plain) == IBAN_LENGTHS.get(plain[:2], 0), int(number) % 97 == 1, plain[:2] in IBAN_LENGTHS
    if kind == "id":
        plain = re.fullmatch(r"([0-9]{3})-([0-9]{2})-([0-9]{4})", span)
        sound = plain is None or (plain[1] not in ("000", "666") and plain[1] < "900" and plain[2] != "00" and plain[3] != "0000")
        return plain is not None, sound, sum(x.isdigit() for x in span) >= 7
    if kind == "name":
        words = re.split("[ '’-]", span)
        return " " in span, all(w[1:].islower() for w in words if len(w) > 1), any(w.lower() in GIVEN for w in words)
    if kind == "address":
        number = NO_DIGITS.sub("", span)
        return True, not number.startswith("0"), len(span.split()) >= 3 or "str" in span
    exists, year = real_date(span)
    return True, exists, 1900 <= year <= 2025


def _judge(text, c: Candidate) -> Candidate:
    """Fill in the labelers' votes and the neighbouring words."""
    span, kind = text[c.start : c.end], c.kind
    digits = NO_DIGITS.sub("", span)
    before, after = WORD.findall(text[max(0, c.start - 32) : c.start].lower())[-3:], WORD.findall(text[c.end : c.end + 24].lower())[:2]
    words, pattern = (*before, *after), c.base
    if kind in PROPOSALS:
        pattern, sound, known = _opinions(kind, span)
    elif kind == "email":
        sound = ".." not in span and len(span) <= 254
        known = re.split(r"[^A-Za-z]+", span)[-1].lower() in ENDINGS
    elif kind == "ip":
        sound = ":" in span or valid(kind, span)
        known = not re.match(r"(?:0|127|255)\.|10\.|192\.168\.", span)
    elif kind == "card":
        sound = 13 <= len(digits) <= 19 and luhn(digits)
        known = bool(ISSUERS.match(digits))
    else:
        sound = 8 <= len(digits) <= 15
        known = digits.startswith(COUNTRIES) if "+" in span else len(digits) == 10
    near = 1 if CUES[kind] & {*words} else -1 if AGAINST & {*words} else 0
    left, right = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    apart = not (left.isalnum() or left in ("_", "=", "/", "#", "+", "-", "@")) or not left
    apart = apart and not (right.isalnum() or right in ("_", "=", "/", "@"))
    c.votes = (1 if pattern else -1, 1 if sound else -1, 1 if known else -1, near, 1 if apart else -1)
    c.words = words
    return c


def candidates(text: str) -> list[Candidate]:
    """All candidate spans of a text, base spans first within a kind, none overlapping a base span of its kind."""
    found = []
    digits = DIGIT.search(text) is not None
    for kind in KINDS:
        if "@" not in text if kind == "email" else "+" not in text if kind == "phone" else not digits:
            spans = []
        else:
            spans = emails(text) if kind == "email" else [m.span() for m in BASE[kind].finditer(text)]
        own = [Candidate(kind, a, b, True) for a, b in spans if valid(kind, text[a:b])]
        if kind == "card":
            more = [s for s in spans if 13 <= len(NO_DIGITS.sub("", text[slice(*s)])) <= 15]
        elif NEEDS[kind].search(text):
            more = [m.span() for m in WIDE[kind].finditer(text)]
        else:
            more = []
        ends = [c.end for c in own]
        for a, b in more:
            k = bisect_right(ends, a)  # the first base span that ends after a
            if k == len(ends) or own[k].start >= b:
                own.append(Candidate(kind, a, b, False))
        found += [_judge(text, c) for c in own]
    taken = sorted((c.start, c.end) for c in found if c.base)
    for kind, a, b in proposals(text, digits):
        k = bisect_right(taken, (a, a))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            found.append(_judge(text, Candidate(kind, a, b, False)))
    return found


def proposals(text: str, digits: bool) -> list[tuple[str, int, int]]:
    """Spans that gazetteers and contexts propose, by kind and start, none overlapping another of its kind."""
    out = []
    for kind, (needs, patterns) in PROPOSALS.items():
        if not digits and kind != "name" or needs and not any(n in text for n in needs):
            spans = set()
        else:
            spans = {m.span(1) for p in patterns for m in p.finditer(text)}
        if kind == "id" and digits and any(n in text for n in ID_NEEDS):
            spans |= {m.span(1) for m in CUED_ID.finditer(text)}
        done = 0
        for a, b in sorted(spans):
            if a >= done:
                out.append((kind, a, b))
                done = b
    return out


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds=100) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) pattern being personal data, by EM with independent labelers.

    Per kind: a prior, and for either class each labeler's probabilities of its three votes (smoothed
    by one). It starts from the share of votes in favour, which fixes which class is which.
    """
    out = {}
    for kind in ALL:
        own = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        if not own:
            continue
        votes, n = np.array([v for v, _ in own]) + 1, np.array([n for _, n in own], float)
        p = ((votes == 2).sum(1) + 0.5) / ((votes != 1).sum(1) + 1)
        for _ in range(rounds):
            prior, logs = [], []
            for w in (n * (1 - p), n * p):
                prior.append(np.log(w.sum() + 1))
                table = np.array([[w[votes[:, j] == v].sum() + 1 for v in range(3)] for j in range(LABELERS)])
                table = np.log(table / table.sum(1, keepdims=True))
                logs.append(prior[-1] + table[np.arange(LABELERS), votes].sum(1))
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        out |= {(kind, v): float(x) for (v, _), x in zip(own, p, strict=True)}
    return out


def features(kind, votes, length, words) -> np.ndarray:
    first = 1 + len(ALL)
    x = np.zeros(first + 3 * LABELERS + 1 + BINS)
    x[0] = 1
    x[1 + ALL.index(kind)] = 1
    for j, v in enumerate(votes):
        x[first + 3 * j + v + 1] = 1
    x[first + 3 * LABELERS] = min(length, 64) / 32
    for w in words:
        x[first + 1 + 3 * LABELERS + zlib.crc32(w.encode("utf-8", "surrogatepass")) % BINS] = 0.5
    return x


def fit_classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds=25) -> np.ndarray:
    """Ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Detector:
    """Weights of the span classifier; None (nothing was seen to learn from) keeps base spans only."""

    weights: np.ndarray | None

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans), each by kind and start, in code points."""
        found = candidates(text or "")
        base = [(c.kind, c.start, c.end) for c in found if c.base]
        more = [c for c in found if not c.base]
        if more and self.weights is not None:
            score = np.array([features(c.kind, c.votes, c.end - c.start, c.words) for c in more]) @ self.weights
            more = [c for c, s in zip(more, score, strict=True) if s > 0]
        else:
            more = []
        whole = base + [(c.kind, c.start, c.end) for c in more]
        return base, sorted(whole, key=lambda s: (ALL.index(s[0]), s[1]))


def fit_detector(docs: DataFrame, text_col="text", sample=20_000, seed=3) -> Detector:
    """Votes are counted over all documents; the classifier learns from at most ``sample`` candidates."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 0):
                found = (c for text in part.column(0).to_pylist() for c in candidates(text or ""))
                rows = [(c.kind, ",".join(map(str, c.votes)), c.end - c.start, " ".join(c.words)) for c in found]
                yield pa.record_batch([pa.array(v, k) for v, k in zip([*zip(*rows, strict=True)] or [[]] * 4, [pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["kind", "votes", "length", "words"])

    # equal candidates weigh by their number; both results have fixed bounds
    found = docs.select(text_col).mapInArrow(scan, "kind string, votes string, length int, words string")
    found = found.groupBy("kind", "votes", "length", "words").agg(F.count("*").alias("n"))
    found = materialize(found)
    read = lambda s: tuple(map(int, s.split(",")))
    counts = {(r.kind, read(r.votes)): r.n for r in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return Detector(None)
    belief = estimate(counts)
    rows = found.orderBy(F.xxhash64(F.lit(seed), "kind", "votes", "length", "words"), "kind", "votes", "length", "words").limit(sample).collect()
    discard(found)
    x = np.array([features(r.kind, read(r.votes), r.length, r.words.split()) for r in rows])
    y = np.array([belief[r.kind, read(r.votes)] for r in rows])
    return Detector(fit_classifier(x, y, np.array([r.n for r in rows], float)))


def _listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, detector: Detector, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, base counts by kind, base_sha256 and spans, from the whole text (null: empty).

    Spans of the kinds without a base pattern (PROPOSED) follow those of the others. A text without spans has the digest of the empty string and an empty ``spans``. Repeated rows
    count row by row, an empty table gives an empty result, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def scan(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                found = [own.spans(t) for t in part.column(1).to_pylist()]
                base = [b for b, _ in found]
                counts = {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS}
                digests = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]
                yield pa.record_batch({"id": part.column(0), **counts, "base_sha256": digests, "spans": [_listed(s) for _, s in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def mask(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans merge under the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, detector: Detector, text_col="text", size_col=None) -> DataFrame:
    """docs with all spans of the text masked (null stays null), and ``size_col`` its new length if given."""
    shared, at = docs.sparkSession.sparkContext.broadcast(detector), docs.columns.index(text_col)

    def scan(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, at):
                texts = [None if t is None else mask(t, own.spans(t)[1]) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots can't be given to a function
    out = plain.mapInArrow(scan, StructType(list(plain.schema.fields))).toDF(*docs.columns)
    return out if size_col is None else out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
