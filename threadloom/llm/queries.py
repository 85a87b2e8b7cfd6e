"""Thin queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.ann import nearest
from threadloom.llm.decontaminate import scan_documents
from threadloom.llm.pii import find_pii
from threadloom.llm.secrets import find_secrets
from threadloom.llm.sentencepiece_bpe import encode_texts
from threadloom.llm.sharding import shard_by_bytes
from threadloom.llm.simhash import near_duplicates
from threadloom.llm.spans import joined
from threadloom.llm.substring import dedup_substrings
from threadloom.llm.suffix import dedup_suffixes
from threadloom.llm.toxicity import fit, fold, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_columns(find_pii(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_columns(find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


QUERIES = {
    "op2_pii": op2_pii,
    "op10_secrets": op10_secrets,
    "op6_toxicity": op6_toxicity,
    "op1_nearest": op1_nearest,
    "op9_simhash": op9_simhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_shard_bytes": op5_shard_bytes,
    "op8_decontaminate": op8_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
}

SQL: dict[str, str] = {}

SQL["op1_nearest"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op8_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bn AS (SELECT item, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT item, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM bn),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM bw),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n),
m AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s FROM dw),
h AS (SELECT m.r, m.i, m.n, win.item FROM m JOIN win ON win.s = m.s AND win.n = m.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(range(n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
w AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
c AS (SELECT DISTINCT r, i + unnest(range(13)) AS i FROM w JOIN f USING (s) WHERE m < doc_id),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT u.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN c ON c.r = u.r AND c.i = u.i WHERE c.i IS NULL GROUP BY u.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

SQL["op7_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, doc_id, i, md5_number(substring(h, 2 * i - 1, 100)) AS s FROM (SELECT r, doc_id, h, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT w.r, w.i FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
s AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, run),
k AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS b, run FROM s UNION ALL SELECT r, max(b), NULL, 1000000000 FROM s GROUP BY r),
t AS (SELECT k.r, string_agg(CASE WHEN k.b IS NULL THEN substring(d.h, CAST(2 * k.a - 1 AS BIGINT)) ELSE substring(d.h, CAST(2 * k.a - 1 AS BIGINT), CAST(2 * (k.b - k.a) AS BIGINT)) END, '' ORDER BY k.a) AS kept FROM k JOIN d USING (r) GROUP BY k.r),
z AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (r) LEFT JOIN t USING (r)
"""
