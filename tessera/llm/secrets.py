"""Secrets in texts: candidate tokens, and a random forest that removes false positives.

DataFrame operations only. Candidates are what follows a credential's name and a sign (any text of four
characters or more), tokens of known forms, headers of private keys, and runs of at least 16 token
characters with a digit. The forest reads a candidate's length, character transitions, dictionary
coverage, path and neighbouring words, and is trained from labelled findings: any table of them, or the
synthetic one built here. The dictionary is the corpus' own: its common words, as a bitmap of fixed size.
"""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKEN = "A-Za-z0-9_+/-"
OPEN, CLOSE = "\ue000", "\ue001"
BEFORE, AFTER = 48, 16

#: Fragments of ordinary words and identifiers, for dictionary coverage.
FRAGMENTS = "tion|ment|able|ence|ance|ough|ight|ould|the|and|ing|ent|ion|ter|con|pro|com|per|ver|age|est|ess|all|one|our|out|man|der|ich|sch|ung|que|los|des|les|test|user|name|data|file|page|item|list|part|version|example|sample|index|image|class|value|number|order|table"
CUE = "(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?|signature)"
INNOCENT = "(?i)(?:commit|sha-?(?:1|256|512)?|md5|checksum|digest|hash|uuid|guid|version|build|revision|card|phone|order|invoice|isbn|doi|serial)"
KNOWN = "(?:A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{8,}|AIza[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}+(?:[.][A-Za-z0-9_-]++)*+|glpat-[A-Za-z0-9_-]{10,}|npm_[A-Za-z0-9]{16,}|SG[.][A-Za-z0-9_.-]{16,}|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\\s]*+-----END [A-Z ]{0,32}PRIVATE KEY-----)?+)"
#: A credential's name, a sign and a quote; then its value, which ends before a closing mark.
LEAD = f"(?:{CUE}[\"'`]?\\s{{0,3}}(?:=>|:=|[:=])\\s{{0,3}}[\"'`]?)"
#: One character after another: a counted repeat, and a repeated group that may give back, take stack by length.
VALUE = "(?:" + 3 * "[^\\s\"'`<>,;]" + "[^\\s\"'`<>,;]*[^\\s\"'`<>,;.:)\\]}])"
CANDIDATE = f"({LEAD})({VALUE})|((?<![{TOKEN}]){KNOWN}|(?<![{TOKEN}])(?=[A-Za-z_+/-]*[0-9])[{TOKEN}]{{16,}}={{0,2}})"
DOUBTFUL_PATH = "(?i)(?:test|example|sample|mock|fixture|doc|readme|demo)"


def _transitions(c: Column) -> Column:
    """How often the class (lower, upper, digit, other) changes between neighbours."""
    shape = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "+/-_=", "-----")
    return F.length(shape) - 1


def _share(c: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


#: Bits of the dictionary.
BITS = 1 << 20


def corpus_dictionary(docs: DataFrame, text_col="text", least=3, share=1e-4) -> bytes:
    """Bitmap of the hashes of all words of three letters or more in at least ``least`` documents and ``share`` of them."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), "[^a-z]+"))).alias("word")
    counts = docs.select(word).where("length(word) >= 3").groupBy("word").count()
    common = counts.where(F.col("count") >= max(least, share * docs.count()))
    spot = F.pmod(F.xxhash64("word"), F.lit(BITS))
    held = common.select(F.floor(spot / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit"))
    out = np.zeros(BITS // 64, np.int64)
    for r in held.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most BITS / 64 rows
        out[r["at"]] = r["bits"]
    return out.astype("<i8").tobytes()


def _covered(c: Column, dictionary: bytes | None) -> Column:
    """Letters of a token's words (cut at other characters and inner capitals) that the dictionary holds."""
    if dictionary is None:
        return F.lit(0)
    words = F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"), lambda w: F.length(w) >= 3)
    spot = lambda w: F.pmod(F.xxhash64(w), F.lit(BITS))
    byte = lambda w: F.conv(F.hex(F.substring(F.lit(dictionary), (F.floor(spot(w) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = lambda w: F.call_function("shiftright", byte(w), (spot(w) % 8).cast("int")).bitwiseAND(F.lit(1))
    return F.aggregate(words, F.lit(0), lambda a, w: a + held(w) * F.length(w))


def features(dictionary: bytes | None = None) -> dict[str, Column]:
    """Feature columns over token, before, after and path; zero where there is no token."""
    t, n = F.col("token"), F.length("token")
    near = F.regexp_extract("before", r"([\p{L}0-9_-]+)\W{0,4}$", 1)  # the word that leads to the token
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": n,
        "transitions": _transitions(t) / n,
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / n,
        "digits": _share(t, "[0-9]"),
        "upper": _share(t, "[A-Z]"),
        "vowels": _share(t, "[aeiouAEIOU]"),
        "symbols": _share(t, "[+/_=-]"),
        "hexadecimal": flag(t.rlike("^[0-9a-f]+$") | t.rlike("^[0-9A-F]+$")),
        "numeric": flag(t.rlike("^[0-9+/_-]+$")),
        "uuid": flag(t.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "dictionary": _covered(t, dictionary) / n,
        "fragments": _share(F.lower(t), FRAGMENTS),
        "placeholder": flag(t.rlike("(?i)^(?:[*x.#-]+|[$%{\\[(].*|your.*|none|null|true|false)$")),
        "longest_word": F.array_max(F.transform(F.split(t, "[^A-Za-z]+"), F.length)) / n,
        "known_form": flag(t.rlike(f"^{KNOWN}")),
        "cue": flag(near.rlike(CUE)),
        "cue_nearby": flag(F.col("before").rlike(CUE)),
        "innocent": flag(near.rlike(INNOCENT)),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "in_address": flag(F.col("before").rlike("[@.:/#?&]$") | F.col("after").rlike("^[@.:]\\w")),
        "doubtful_path": flag(F.col("path").rlike(DOUBTFUL_PATH)),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()}


def labelled_findings(spark: SparkSession, rows=6000) -> DataFrame:
    """Synthetic labelled findings: token, before, after, path, label (1: a secret). Deterministic."""
    r = lambda k: F.conv(F.substring(F.md5(F.concat_ws("/", F.col("id"), F.lit(k))), 1, 8), 16, 10).cast("long")
    text = lambda k: F.sha2(F.concat_ws("/", F.col("id"), F.lit(k)), 512)
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(r(k), F.lit(len(values))) + 1).cast("int"))
    base64 = lambda k: F.regexp_replace(F.base64(F.unhex(text(k))), "\\s|=+$", "")
    lead = pick("lead", ["the ", "and of ", "in der ", "que la ", "", "x ", "see "])
    cued = F.concat(lead, pick("cue", ["password", "token", "secret", "api_key", "auth_token", "pwd", "access_key"]), pick("sep", ["=", " = ", ": ", ' = "', "='", ':"']))
    plain = F.concat(lead, pick("w", ["of ", "the ", "und ", "de ", "with ", "que ", "on "]))
    word = F.concat(*(pick(f"p{i}", ["tion", "the", "er", "ing", "and", "ment", "page", "user", "on", "ver", "list", "item", "es", "data"]) for i in range(5)))
    number = F.concat(F.lit("4"), F.lpad(F.conv(F.substring(text("n"), 1, 12), 16, 10), 15, "7"))
    u = text("u")
    uuid = F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12))
    some_length = (16 + F.pmod(r("len"), F.lit(32))).cast("int")
    hexed = F.substring(text("h"), F.lit(1), some_length)
    common = lambda k: pick(k, ["correct", "horse", "battery", "staple", "required", "string", "house", "river", "garden", "window", "people", "always", "number", "simple", "letter", "summer"])
    leet = F.concat(F.initcap(F.translate(common("l1"), "aeo", "430")), pick("sym", ["!", "@", "#", "&", "_", "$", "-"]), F.pmod(r("l2"), F.lit(10000)).cast("string"))
    letters = F.substring(F.translate(F.upper(text("L")), "0123456789", "GHJKMNPQRS"), 1, 16)
    kinds = [
        (1, leet, cued),
        (1, F.concat(common("c1"), common("c2"), common("c3"), common("c4")), cued),
        (1, F.concat(F.lit("AKIA"), letters), F.when(F.pmod(r("c"), F.lit(2)) == 0, cued).otherwise(plain)),
        (1, F.concat(F.lit("-----BEGIN "), pick("pk", ["RSA ", "EC ", "", "OPENSSH "]), F.lit("PRIVATE KEY-----")), plain),
        (0, common("c1"), cued),
        (0, pick("ph", ["None", "null", "YOUR_API_KEY", "your-token-here", "********", "xxxxxxxx", "${PASSWORD}", "{{secret}}", "$TOKEN", "true", "false", "(optional)"]), cued),
        (1, hexed, cued),
        (1, F.substring(text("h"), 1, 40), cued),
        (1, F.substring(base64("b"), F.lit(1), some_length), cued),
        (1, F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(base64("k"), "+/", "77")), 1, 16)), F.when(F.pmod(r("c"), F.lit(3)) == 0, cued).otherwise(plain)),
        (1, F.concat(pick("pre", ["ghp_", "xoxb-", "sk_live_", "glpat-"]), F.substring(F.translate(base64("g"), "+/", "aZ"), 1, 36)), F.when(F.pmod(r("c"), F.lit(2)) == 0, cued).otherwise(plain)),
        (0, number, F.when(F.pmod(r("c"), F.lit(4)) == 0, F.concat(lead, F.lit("card "))).otherwise(plain)),
        (0, uuid, F.concat(lead, pick("i", ["id ", "uuid: ", "guid=", ""]))),
        (0, F.substring(text("h"), 1, 40), F.concat(lead, pick("i", ["commit ", "sha1: ", "sha256:", "md5 ", "checksum=", "hash: "]))),
        (0, F.concat(word, F.pmod(r("d"), F.lit(1000)).cast("string")), plain),
        (0, F.concat_ws("-", word, F.lit("version"), F.pmod(r("d"), F.lit(100)).cast("string")), F.concat(plain, pick("u", ["http://a.example/", "/usr/lib/", ""]))),
    ]
    made = F.array(*(F.struct(F.lit(y).alias("label"), t.alias("token"), b.alias("before")) for y, t, b in kinds))
    chosen = F.element_at(made, (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int"))
    after = F.when(F.col("f.before").rlike("\"$"), '"').when(F.col("f.before").rlike("'$"), "'").otherwise(pick("a", [" the", ", and", ".", " of the", ""]))
    return spark.range(rows).withColumn("f", chosen).select("f.label", "f.token", "f.before", after.alias("after"), pick("path", ["src1", "src2", "tests/a.py", "docs/readme.md", "app/main.py"]).alias("path"))


def train_forest(findings: DataFrame, trees=24, depth=7, seed=17, dictionary: bytes | None = None) -> RandomForestClassificationModel:
    """Forest of labelled findings (token, before, after, path, label)."""
    made = features(dictionary)
    data = VectorAssembler(inputCols=list(made), outputCol="features").transform(findings.select(F.col("label").cast("double").alias("label"), *(c.alias(k) for k, c in made.items())))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(data)


def scan_candidates(docs: DataFrame, id_col="doc_id", text_col="text", path_col: str | None = None) -> DataFrame:
    """row, id, path, and for each candidate token, start (code points), before and after; one row without a token a document."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, "  ")
    parts = F.split(F.regexp_replace(text, CANDIDATE, f"$1{OPEN}$2$3{CLOSE}"), OPEN)
    item = lambda p, i: F.struct(
        F.when(i > 0, F.substring_index(p, CLOSE, 1)).alias("token"),
        (F.length(p) - F.when(i > 0, 1).otherwise(0)).alias("size"),
        F.substring(F.substring_index(p, CLOSE, -1), 1, AFTER).alias("after"),
        F.substring(F.translate(p, CLOSE, ""), -BEFORE, BEFORE).alias("tail"),
    )
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), path.alias("path"), F.transform(parts, item).alias("items"))
    rows = rows.select("row", "id", "path", F.posexplode("items").alias("i", "item"))
    order = Window.partitionBy("row").orderBy("i")
    start = F.coalesce(F.sum("item.size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("row", "id", "path", "i", "item.token", "item.after", start.alias("start"), F.lag("item.tail").over(order).alias("before"))


def find_secrets(docs: DataFrame, forest: RandomForestClassificationModel, id_col="doc_id", text_col="text", path_col: str | None = None, threshold=0.5, dictionary: bytes | None = None) -> DataFrame:
    """One row per row: id, n_candidates, n_secrets and spans ("start:end", comma-joined, code points).

    Whole texts are scanned; null and empty ones have no candidates. Repeated rows are kept, a null
    path has no path features, an empty table gives an empty result, other columns are ignored. The
    private-use characters U+E000 and U+E001 read as spaces. dictionary: that of the forest's training.
    """
    made = features(dictionary)
    found = scan_candidates(docs, id_col, text_col, path_col)
    found = VectorAssembler(inputCols=list(made), outputCol="features").transform(found.withColumns(made))
    scored = forest.transform(found).withColumn("secret", F.col("token").isNotNull() & (vector_to_array("probability")[1] >= threshold))
    span = F.when(F.col("secret"), F.struct("start", (F.col("start") + F.length("token")).alias("end")))
    out = scored.groupBy("row", "id").agg(F.count("token").alias("n_candidates"), F.count(F.when(F.col("secret"), 1)).alias("n_secrets"), F.sort_array(F.collect_list(span)).alias("found"))
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(F.col("id").alias(id_col), "n_candidates", "n_secrets", joined.alias("spans"))
