"""Filter audit, conversation trie and line dedup against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_trie, filter_audit, line_dedup, queries
from tests.test_queries import SF, TABLES, rows

SPACES = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_conversation_trie", "op13_line_dedup"])
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# filter audit


def slow_audit(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, *own in labels if own[k] == 1 and i is not None} for k in (0, 1))
    masks = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split(f"[{SPACES}]+", text) if w]
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = [len(words) < 50, 100 * len({*words}) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        masks.append((i, part or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}))
    out, total = [], Counter()
    for part in {p for _, p, _ in masks}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, m) for i, p, m in masks if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [i for i, m in left if x in m]
                redundant = sum(x in m for _, m in gone)
                gone += [(i, m) for i, m in left if x in m]
                left = [(i, m) for i, m in left if x not in m]
                unique = sum(m == {x} for _, p, m in masks if p == part)
                total[part, x] += len(removed)
                out.append((part, "".join(order), step, len(left), len(removed), redundant, unique, sum(i in good for i in removed), sum(i in toxic for i in removed)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_plain_code(spark, odd_docs):
    r = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "zeta", "eta", "theta"]
    docs = [(r.choice([*range(40), None]), r.choice([None, "", " ", "A" * 9, " ".join(r.choice(words) + str(r.randrange(r.choice([2, 900]))) for _ in range(r.choice([3, 49, 50, 51, 80])))]), r.choice([None, "", "s1", "s2"])) for _ in range(60)]
    docs += [(i, t, "odd") for i, t in ((x.doc_id, x.text) for x in odd_docs.collect())] + docs[:5]
    labels = [(r.choice([*range(40), None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "mask", "n", "words", "digest", "first", "step")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(df, known)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert sorted(map(tuple, got.collect())) == slow_audit(docs, labels)
    assert filter_audit.audit_filters(df.where("false"), known).count() == 0
    assert filter_audit.audit_filters(df, known.where("false")).agg(F.sum("good_lost")).first()[0] == 0


# conversations


def slow_trie(turns):
    """turns: (conv_id, turn, role, text), no equal turns of different content."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, held in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: ",".join(str(c) for c in sorted(nodes[p]) if built[c] == p)
    return sorted((min(v), len(p), min(nodes[p[:-1]]) if p else -1, len(v), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, v in nodes.items())


def trie(spark, turns, **widths):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("id", "hash", "pos", "i", "fp", "variant", "n", "total")})
    return sorted(map(tuple, conversation_trie.conversation_trie(df.repartition(5), **widths).fillna(-1, ["parent_conv_id"]).collect()))


def some_turns(seed, convs=60):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "a", "b", "hello there", "é" * 40])
    ids = [0, 5, 100, 101, -3, -150, 10**12, *r.sample(range(700), convs)]
    turns = [(c, t or None, r.choice(["user", "assistant", None]), text()) for c in ids for t in range(r.choice([0, 1, 2, 4, 9]))]
    return turns + turns[:7] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("widths", [{}, {"hash_bits": 2}, {"bits": 3}, {"bits": 4, "hash_bits": 1}])
def test_trie_equals_plain_code(spark, widths):
    turns = some_turns(len(widths))
    assert trie(spark, turns, **widths) == slow_trie(turns)


def test_trie_of_colliding_and_long_conversations(spark):
    """Thue-Morse sequences of two turns collide in any polynomial modulo a power of two."""
    bit = lambda i: bin(i).count("1") & 1
    turns = [(c, i, "user", "xy"[bit(i) ^ flip]) for c, flip in ((1000, 0), (2000, 1), (3000, 0)) for i in range(2100)]
    got = trie(spark, turns)
    assert len(got) == len({(c, d) for c, d, *_ in got}) and sum(r[5] for r in got if r[1] == 0) == 2
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (1000, 2000, 3000)}
    assert [r[3] for r in got if r[1] == 2100] == [2, 1] and h is not None
    assert sum(r[4] == 0 for r in got) == 2
    top = next(r for r in got if r[1] == 0)
    assert top[3:5] == (3, 2) and top[6] == 2100


def test_trie_of_no_turns_and_one_crowd(spark):
    assert trie(spark, [(None, 1, "user", "x")]) == []
    crowd = [(c, 1, "user", "same") for c in range(0, 700)]
    assert trie(spark, crowd) == slow_trie(crowd)


def test_running_sums_pass_partitions(spark):
    df = spark.createDataFrame([(g, i) for g, n in ((1, 5), (2, 4000), (3, 1), (4, 800)) for i in range(n)], "g long, i long").repartition(3)
    out = conversation_trie.running(df, "g", ["i"], lambda b: b.column("i").to_numpy().view("uint64") + conversation_trie.U(1))
    assert all(r.total == (r.i + 1) * (r.i + 2) // 2 for r in out.collect())


# lines


def slow_lines(docs, least=5, length=40):
    key = lambda s: s.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    last = {k: max(v, key=order) for k, v in held.items() if len(k) >= length and len(v) >= least}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [s for s in lines if last.get(key(s), i) == i]
        out.append((order(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 2, 4, 7])
def test_lines_equal_plain_code(spark, odd_docs, batches):
    r = random.Random(batches)
    common = [f"{'A common LINE é of some length ' * 2}{k}" for k in range(6)] + ["short", "", "x" * 39, "y" * 40, "É" * 45, "é" * 45]
    dress = lambda s: r.choice(["", " ", "\t", "\x0b"]) + r.choice([s, s.upper(), s.lower()] if s.isascii() else [s]) + r.choice(["", "\r", "  "])
    docs = [(r.choice([*range(-5, 60), None]), "\n".join(dress(r.choice(common)) if r.random() < 0.4 else f"own line {r.random()} and more of it, long enough" for _ in range(r.randrange(9)))) for _ in range(90)]
    docs += docs[:6] + [(x.doc_id, x.text) for x in odd_docs.collect()] + [(77, "\n".join(["y" * 40] * 5000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("a", "b", "id", "last", "place", "batch", "lines", "n", "lost")})
    got = line_dedup.drop_repeated_lines(df, batches=batches)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(((i is not None, i or 0), *own) for i, *own in map(tuple, got.collect())) == slow_lines(docs)
    assert not any(t.name.startswith("run_") for t in spark.catalog.listTables())
    assert line_dedup.drop_repeated_lines(df.where("false"), batches=batches).count() == 0


def test_runs_join_and_merge_without_shuffles(spark):
    lines = spark.range(4000).selectExpr("id % 1500 as a", "id % 7 as b", "id")
    runs = line_dedup.SortedRuns(spark)
    for k in range(5):
        runs.add(lines.where(f"id % 5 = {k}"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    one, other = (runs.read(n) for n in runs.runs())
    plan = one.join(other, ["a", "b"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {(r.a, r.b) for r in runs.frequent(3).collect()}
    assert got == {k for k, n in Counter((i % 1500, i % 7) for i in range(4000)).items() if n >= 3}
