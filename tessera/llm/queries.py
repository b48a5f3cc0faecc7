"""The queries of this subpackage, each over a whole table, and their DuckDB counterparts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    from .toxicity import corpus_chain, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, corpus_chain(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_hpy_lm(spark, sf_dir):
    from .hpy_lm import score_texts

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    found = score_texts(table(spark, sf_dir, "documents"), ~held)
    return found.withColumn("held_out", ~F.col("train")).drop("train")


def op3_simhash_dedup(spark, sf_dir):
    from .simhash_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_sharding(spark, sf_dir):
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op5_bitsliced_topk(spark, sf_dir):
    from .bitsliced import topk_inner_product

    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    vectors = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", scaled.alias("vector"))
    return topk_inner_product(vectors, vectors.where("vec_id % 20 = 0"), id_col="vec_id")


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=False)


def op7_secrets(spark, sf_dir):
    from .secrets import corpus_dictionary, find_secrets, labelled_findings, train_forest

    docs = table(spark, sf_dir, "documents")
    words = corpus_dictionary(docs)
    return find_secrets(docs, train_forest(labelled_findings(spark), dictionary=words), path_col="source", dictionary=words)


def op8_pii(spark, sf_dir):
    from .pii import find_pii, fit_detector

    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit_detector(docs))


def op9_fingerprints(spark, sf_dir):
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_filter_audit(spark, sf_dir):
    from .filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark, sf_dir):
    from .conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark, sf_dir):
    from .line_dedup import drop_repeated_lines

    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


ORACLES: dict[str, str] = {
    "op5_bitsliced_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                min(doc_id) OVER (PARTITION BY text) AS first
            FROM t
        ), known AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), masks AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (len(words) < 50)::INT
                + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
                + 8 * regexp_matches(text, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > first, false)::INT AS mask
            FROM w LEFT JOIN known USING (doc_id)
        ), cells AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
        ), letters AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
        ), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
        ), steps AS (
            SELECT filter_order, step, letter, bit,
                (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE position(l.letter IN filter_order) < step)::INT AS earlier
            FROM orders, range(1, 6) r(step), letters
            WHERE substr(filter_order, step, 1) = letter
        ), counts AS (
            SELECT part, filter_order, step, letter,
                sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM cells, steps
            GROUP BY part, filter_order, step, letter
        )
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
            redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
            toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
        FROM counts
    """,
    "op12_conversation_trie": """
        WITH o AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n,
                list_reduce(
                    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END,
                    4294967295
                ) AS inverted
            FROM o GROUP BY conv_id
        ), h AS (
            SELECT *, xor(inverted, 4294967295) % 6 AS head FROM c
        ), s AS (
            SELECT h.conv_id, h.base, h.head, least(h.head, coalesce(b.n, 0)) AS lent
            FROM h LEFT JOIN h b ON b.conv_id = h.base
        ), r AS (
            SELECT s.conv_id, i AS pos, role, text FROM s JOIN o ON o.conv_id = s.base AND i <= lent
            UNION ALL
            SELECT s.conv_id, i - head + lent, role, text FROM s JOIN o USING (conv_id) WHERE i > head
        ), p AS (
            SELECT conv_id, pos, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS path, length(text) AS size FROM r
            UNION ALL
            SELECT conv_id, 0, [], 0 FROM s
        ), l AS (
            SELECT *, max(pos) OVER (PARTITION BY conv_id) AS turns FROM p
        ), n AS (
            SELECT path, pos, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saves,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE pos = turns), '')) AS ends_sha256
            FROM l GROUP BY path, pos
        ), k AS (
            SELECT path[1:pos - 1] AS path, count(*) AS n_children FROM n WHERE pos > 0 GROUP BY ALL
        ), m AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)
        ), a AS (
            SELECT path, pos, n_children, saves, unnest(range(0, pos + 1)) AS upto FROM m
        ), b AS (
            SELECT path[1:upto] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saves) AS saved_tokens FROM a GROUP BY ALL
        )
        SELECT m.conv_id, m.pos::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children,
            n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
        FROM m JOIN b USING (path) LEFT JOIN m u ON m.pos > 0 AND u.path = m.path[1:m.pos - 1]
    """,
    "op13_line_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), p AS (
            SELECT *, unnest(range(1, len(lines) + 1)) AS place FROM d
        ), l AS (
            SELECT *, lines[place] AS line,
                translate(trim(lines[place], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM p
        ), k AS (
            SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), r AS (
            SELECT row, doc_id, place, line, last IS NOT NULL AND doc_id <> last AS lost FROM l LEFT JOIN k USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM r GROUP BY row, doc_id
    """,
}


def oracle_sql():
    return dict(ORACLES)
