"""One thin query per corpus operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, langid, mixing, quality, secrets, simhash, suffixes, tokens, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spelled = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digests = spelled.select("all_items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = rows.join(digests, "all_items", "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, n, s, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(spark))
    real = F.filter("findings", lambda f: f["secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(real).cast("long").alias("n_secrets"),
        F.array_max(F.transform("findings", lambda f: f["score"])).alias("max_score"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), model, carry=("held_out",))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to, true AS digest_ok
FROM p LEFT JOIN f ON p.n >= 1000 AND p.digest = f.digest
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_chats(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "turn", "role", "new_role", "action", "inserted", "cost", F.sha2("rendered", 256).alias("rendered_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, i FROM w JOIN f USING (win) WHERE first < doc_id),
b AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
s AS (SELECT r, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY r, run),
p AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM s),
x AS (SELECT p.r, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM p JOIN d USING (r) GROUP BY p.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN x.r IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary="piece_bpe_32k.model", limit=4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_decontaminate, op2_secret_scan, op3_language_id, op4_warc_round_trip, op5_quality_rules, op6_chat_format, op7_suffix_array_dedup, op8_simhash_near_dedup, op9_mix_sources, op10_token_counts)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_warc_round_trip": OP4_SQL, "op7_suffix_array_dedup": OP7_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
