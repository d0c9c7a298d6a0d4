"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import block_naming, decontaminate, mixing, ngram_join, periodic_runs, pii, prefix_trie, secrets, sharding, spans, token_ids, toxicity, url_rules, warc
from furrow.llm.common import running, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the token files and back."""
    folder = token_ids.token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_ids.read_ids(spark, folder, with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probabilities and the draw, for every document."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url.  A page is labelled bad if the label row of
    its number marks it toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_rules.judge(table(spark, sf_dir, "pages"), labels).drop("url")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; its source owns it, source and language make a repository."""
    docs = table(spark, sf_dir, "documents")
    out = secrets.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans.line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      spans.line(F.col("all")).alias("spans"), "n_live", "n_example")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of similar texts of every document."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")), with_payload=False)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return block_naming.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    out = pii.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans.line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      spans.line(F.col("all")).alias("spans"), "n_ctx")


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, sizes and checksums from the dealt files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.read_shards(spark, sharding.write_shards(docs, 16))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
                       "shard", "slot", sharding.shard_of(sharding.key_of(rows, "doc_id"), 17).alias("grown_shard"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """Documents with the tail of every tenth (by crc32 of its number) made
    periodic, as the contract of op12 has it; a null number leaves a text alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("w")
    p = F.col("n") - F.col("a")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g")) \
        .withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))) \
        .withColumn("p", 1 + F.floor(p / (3 + F.col("g") % 8)))
    made = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
                                        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """Columns of op12's contract from the runs and the collapsed texts."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return runs_digest(periodic_runs.find_runs(repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def rebuilt_conversations(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation with its first turns taken from the one
    whose number is the next lower multiple of 20, as the contract of op13 has it."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    turns = running(prefix_trie.turn_rows(convs), "conv_id", ["turn", "t1", "t2"], name="own-turns")
    own = turns.where(F.col("at") >= h).select("conv_id", (F.col("at") + 3).alias("turn"), "t1", "t2", "words")
    ids = turns.where("at = 0").select("conv_id")
    # at most three turns of a head, for at most twenty conversations
    heads = turns.where("conv_id % 20 = 0 AND at < 3").select(F.col("conv_id").alias("head"), F.col("at").alias("turn"), "t1", "t2", "words")
    taken = ids.withColumn("head", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "head").where(F.col("turn") < h)
    return own.unionByName(taken.select(*own.columns)), ids


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


REGISTRY = {f.__name__: f for f in (op1_token_ids, op2_mixing, op3_toxicity, op4_url_rules, op5_decontamination, op6_secrets, op7_ngram_join, op8_warc, op9_exact_dedup, op10_pii,
                                    op11_jump_shards, op12_periodic_runs, op13_prefix_trie)}

#: the table of the crc32 (polynomial 0xEDB88320, fixed) and the crc32 of a list of bytes, in SQL
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b:
                    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)))"""


def _crc32_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})),
                    lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])))"""


ORACLE = {
    "op11_jump_shards": f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        jumps AS (
            SELECT doc_id, doc_id::HUGEINT AS k, 0::BIGINT AS j FROM d
            UNION ALL
            SELECT doc_id, k2 AS k, floor((j + 1) * (2147483648.0::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT AS j
            FROM (SELECT doc_id, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jumps WHERE j < 17)),
        s AS (SELECT doc_id, max(j) FILTER (j < 16)::INT AS shard, max(j) FILTER (j < 17)::INT AS grown_shard FROM jumps GROUP BY doc_id)
        SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, {_crc32_sql("t")} AS text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
        FROM d JOIN s USING (doc_id), crc""",
    "op13_prefix_trie": f"""
        WITH {_CRC_TABLE},
        own AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
                FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT conv_id, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
        turns AS (
            SELECT conv_id, 1 AS part, pos, t FROM own JOIN ids USING (conv_id) WHERE pos >= h
            UNION ALL
            SELECT ids.conv_id, 0 AS part, pos, t FROM ids JOIN own ON own.conv_id = ids.conv_id - ids.conv_id % 20 AND pos < h),
        paths AS (SELECT conv_id, coalesce(list(t ORDER BY part, pos) FILTER (t IS NOT NULL), []) AS path FROM ids LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
        steps AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths),
        nodes AS (
            SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
            FROM steps GROUP BY ALL),
        kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children,
                              CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
                       FROM nodes LEFT JOIN kids USING (prefix))
        SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves, b.saved_tokens, a.ends_sha256
        FROM full_nodes a
        JOIN (SELECT x.prefix, count(*) FILTER (y.n_children = 0) AS n_leaves, sum(y.saved)::BIGINT AS saved_tokens
              FROM full_nodes x JOIN full_nodes y ON y.depth >= x.depth AND y.prefix[1:x.depth] = x.prefix GROUP BY x.prefix) b ON a.prefix = b.prefix
        LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.prefix = a.prefix[1:a.depth - 1]""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM w""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
}
