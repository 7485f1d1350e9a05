"""The registered queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import chat, covering, decontam, exact, langid, merkle, near, packing, pii, quality, substring, warc, whiten
from wellspring.llm.tables import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


@_register(
    "op8_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY text)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_register("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


@_register("op1_chat_formatting")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame(
        [(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(planted)))


@_register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.drop("ids")


@_register(
    "op5_warc",
    """
    WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
         d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM t),
         m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS answer
               FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN answer <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN answer <> page_id THEN answer END AS refers_to
    FROM m
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(archives, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op9_order_minhash")
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@_register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~langid.held_out()).select("doc_id", "quality")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


@_register("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_register("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).drop("found")


@_register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@_register("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register(
    "op13_merkle",
    """
    WITH RECURSIVE bits AS (
        SELECT i, 0 AS step, i AS c FROM range(256) t(i)
        UNION ALL
        SELECT i, step + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE step < 8
    ),
    crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE step = 8),
    d AS (
        SELECT row_number() OVER () AS id, doc_id, lang, text, source, n_chars,
               coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') ||
               coalesce(octet_length(encode(source)) || ':' || source, '-') ||
               coalesce(octet_length(encode(lang)) || ':' || lang, '-') ||
               coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS front,
               xor(4294967295, list_reduce(
                   list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS sum
        FROM documents, crc
    ),
    l AS (
        SELECT id, doc_id, lang,
               sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
               sha256(front || coalesce(octet_length(encode(text)) || ':' ||
                   CASE WHEN sum % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END,
                   '-')) AS given
        FROM d
    ),
    p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                 row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 count(*) OVER (PARTITION BY lang) AS size FROM l),
    low AS (
        SELECT g, 0 AS level, pos, size AS n, leaf AS h FROM p
        UNION ALL
        SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
        FROM low WHERE n > 1 GROUP BY g, level, pos // 8, n
    ),
    tops AS (SELECT g, h AS subroot, level AS steps FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS level, g AS pos, count(*) OVER () AS n, subroot AS h FROM tops
        UNION ALL
        SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 8, n
    ),
    root AS (SELECT h AS root FROM high WHERE n = 1),
    nodes AS (
        SELECT g, level, pos, h FROM low WHERE n > 1
        UNION ALL
        SELECT t.g, t.steps + x.level, x.pos, x.h FROM tops t, high x WHERE x.n > 1
    ),
    own AS (
        SELECT p.id, p.g, k.level,
               CASE WHEN k.level < t.steps THEN p.pos // (8::BIGINT ** k.level)::BIGINT
                    ELSE p.g // (8::BIGINT ** (k.level - t.steps))::BIGINT END AS pos
        FROM p JOIN tops t USING (g) JOIN (SELECT DISTINCT g, level FROM nodes) k USING (g)
    ),
    sides AS (
        SELECT o.id, o.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < o.pos), '') AS lft,
               coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > o.pos), '') AS rgt
        FROM own o JOIN nodes x ON x.g = o.g AND x.level = o.level AND x.pos // 8 = o.pos // 8
        GROUP BY o.id, o.level
    ),
    walk AS (
        SELECT id, 0 AS level, given AS h FROM p
        UNION ALL
        SELECT w.id, w.level + 1, sha256(s.lft || w.h || s.rgt) FROM walk w JOIN sides s ON s.id = w.id AND s.level = w.level
    ),
    folded AS (SELECT id, arg_max(h, level) AS folded_root FROM walk GROUP BY id),
    proof AS (SELECT id, sha256(string_agg(lft || rgt, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY id)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM p JOIN tops USING (g) JOIN folded USING (id) LEFT JOIN proof USING (id) CROSS JOIN root
    """,
)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = docs.columns
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    parts = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in columns]
    load = F.struct("doc_id", F.when(changed, merkle.leaf_hash(*parts)).alias("given"))
    found = merkle.manifest(docs, columns, "lang", "doc_id", load)
    folded = merkle.fold(F.coalesce("load.given", "leaf"), F.col("path"))
    return found.select(
        "load.doc_id", "leaf", "subroot", "root", merkle.sha(merkle.siblings(F.col("path"))).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
