"""Queries opN_* over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, language, licenses, main_text, pieces, release, simhash, token_counts, toxicity, trie, warc
from .workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    archives = warc.write_bundles(_table(spark, sf_dir, "pages"), ws.path("bundles"), workspace=ws)
    return warc.read_bundles(archives).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN low IS NULL OR low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN low <> page_id THEN low END AS refers_to
FROM q
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    # The stored table's last entry is the count of the whole text.
    n_tokens = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0))
    return counted.select("doc_id", "n_bytes", n_tokens.cast("long").alias("n_tokens"), (n_tokens > 2048).alias("over_limit"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return scanned.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_statements"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("confirmed_families"),
        F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["probability"])), F.lit(0.0)), 4).alias("best_probability"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity_model(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    p = F.col("toxicity.toxic")
    return scored.select("doc_id", F.round(p, 6).alias("p_toxic"), (p >= toxicity.THRESHOLD).alias("toxic"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ChainModel:
    """The labels' own categories, the last one being the one that decides."""
    return toxicity.train(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, F.col("toxic") == 1)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    report = decontaminate.decontamination_report(docs, _table(spark, sf_dir, "benchmark"), pass_columns=["doc_id"])
    c = F.col("contamination")
    return report.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


_ASCII = ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(translate(coalesce(text, '')" + _ASCII + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i2 AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS win
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i2)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, model, decoded_col="decoded")
    return out.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("pieces_xxh64"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    shout = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(shout).alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = chat.read_windows(chat.format_windows(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(_table(spark, sf_dir, "documents"))
    found = language.identify(_table(spark, sf_dir, "pages"), model)
    return found.select("page_id", "lang", F.round("probability", 4).alias("probability"), "declared", "host")


def op11_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = release.replay(_table(spark, sf_dir, "conversations"))
    return released.select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")


# DuckDB has no CRC-32: a table of its 256 steps and a fold over the bytes of a text.
_CRC = """
crc_table AS (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS steps FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    """SQL for the checksum of a text; ``steps`` must be in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {_CRC},
t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(text, '') AS text FROM conversations),
h AS (SELECT t.*, list_transform(range(7), lambda n: {_crc32("n || ':' || conv_id || ':' || turn")}) AS h, {_crc32("text")} AS crc FROM t, crc_table),
n AS (SELECT conv_id, turn, p, crc, 7 * p AS arrival, h[2] % 101 < 20 AS faulty, 7 * p + h[3] % 101 AS repair,
             [h[4] % 3 = 0, h[5] % 3 = 0, h[6] % 3 = 0, h[7] % 3 = 0] AS unlucky,
             CASE WHEN h[1] % 7 BETWEEN 1 AND p THEN p - h[1] % 7 END AS parent FROM h),
tried AS (
  SELECT conv_id, turn, p, crc, true AS tried, s, 
         CASE WHEN NOT faulty THEN 1 ELSE list_position(list_transform(range(4), lambda a: s + 20 * (2 ** a - 1) >= repair AND NOT unlucky[a + 1]), true) END AS won
  FROM (SELECT *, arrival AS s FROM n WHERE parent IS NULL)
  UNION ALL
  SELECT conv_id, turn, p, crc, tried, s,
         CASE WHEN NOT tried THEN NULL WHEN NOT faulty THEN 1 ELSE list_position(list_transform(range(4), lambda a: s + 20 * (2 ** a - 1) >= repair AND NOT unlucky[a + 1]), true) END
  FROM (SELECT n.*, u.won IS NOT NULL AS tried, greatest(n.arrival, u.s + 20 * (2 ** (u.won - 1) - 1)) AS s
        FROM n JOIN tried u ON n.conv_id = u.conv_id AND n.parent = u.p)),
o AS (SELECT conv_id, turn, crc, won,
             CASE WHEN won IS NOT NULL THEN 'delivered' WHEN tried THEN 'dead' ELSE 'blocked' END AS status,
             CASE WHEN NOT tried THEN 0 ELSE coalesce(won, 4) END AS attempts,
             CASE WHEN tried THEN s END::BIGINT AS first_at,
             CASE WHEN tried THEN s + 20 * (2 ** (coalesce(won, 4) - 1) - 1) END::BIGINT AS last_at FROM tried),
r AS (SELECT *, CASE WHEN won IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, won IS NOT NULL ORDER BY last_at, turn) END AS release_no FROM o)
SELECT conv_id, turn, status, attempts::INTEGER AS attempts, first_at, last_at, release_no,
       CASE WHEN won IS NOT NULL THEN sum(release_no * crc) OVER (PARTITION BY conv_id, won IS NOT NULL ORDER BY release_no) END::BIGINT AS state
FROM r
"""


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text.extract_main_text(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = f"""
WITH {_CRC},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations),
own AS (SELECT conv_id, list(x ORDER BY p) AS xs FROM t GROUP BY conv_id),
h AS (SELECT own.*, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM own, crc_table),
c AS (SELECT h.conv_id, coalesce(list_slice(b.xs, 1, h), []) || coalesce(list_slice(h.xs, h + 1, len(h.xs)), []) AS xs
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
s AS (SELECT conv_id, d, list_slice(xs, 1, d) AS xs, d = len(c.xs) AS last FROM c, unnest(range(len(c.xs) + 1)) u(d)),
n AS (SELECT xs, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends,
             CASE WHEN d > 0 THEN octet_length(encode(xs[d].text)) ELSE 0 END AS bytes FROM s GROUP BY xs, d),
k AS (SELECT list_slice(xs, 1, d - 1) AS xs, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.xs = k.xs AND n.d = k.d),
a AS (SELECT list_slice(xs, 1, e) AS xs, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
      FROM w, unnest(range(w.d + 1)) u(e) GROUP BY ALL)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN a ON w.xs = a.xs AND w.d = a.d LEFT JOIN n up ON up.d = w.d - 1 AND up.xs = list_slice(w.xs, 1, w.d - 1)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_chat": op9_chat,
    "op10_language": op10_language,
    "op11_release": op11_release,
    "op12_main_text": op12_main_text,
    "op13_trie": op13_trie,
}
SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op3_warc": OP3_SQL, "op7_decontaminate": OP7_SQL, "op11_release": OP11_SQL, "op13_trie": OP13_SQL}
