"""One query per operator, over the whole tables; SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, codes, htmltext, linededup, merkle, minhash, mixing, pii, sql, tiff, topk, toxicity, urlfilter
from strandline.runtime import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """STRANDLINE_TOKENIZERS names the folder of vocabulary files; else the installed public files are used."""
    folder = os.environ.get("STRANDLINE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=0.8)


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.text_media(table(spark, sf_dir, "documents"))
    stored = media.select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff.tiff_pages(stored, "media", keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return pages.select("doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


URL_RULES = [
    urlfilter.Rule("com", "/", "allow"),
    urlfilter.Rule("example.com", "/en/", "block"),
    urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"),
    urlfilter.Rule("net", "/fr/", "block"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(pages, URL_RULES, seen=urlfilter.token_counts(pages, URL_RULES))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.drop_lines(table(spark, sf_dir, "documents"), min_docs=10, marks=("n_lines", "n_dropped", "n_recurring"))
    return cut.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.col("n_recurring").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_tiff_media": op2_tiff_media,
        "op3_toxicity": op3_toxicity,
        "op4_bpe": op4_bpe,
        "op5_url_rules": op5_url_rules,
        "op6_quote_links": op6_quote_links,
        "op7_main_text": op7_main_text,
        "op8_mix": op8_mix,
        "op9_line_templates": op9_line_templates,
        "op10_top_k": op10_top_k,
        "op11_manifest": op11_manifest,
        "op12_vector_codes": op12_vector_codes,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": OP5, "op8_mix": OP8, "op10_top_k": OP10, "op11_manifest": sql.merkle(), "op12_vector_codes": sql.codes(), "op13_personal_data": sql.private()}


OP5 = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
best AS (SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM numbered, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM numbered LEFT JOIN best USING (n)
"""

OP8 = r"""
WITH d0 AS (SELECT doc_id, coalesce(source, '') AS source, source IS NOT NULL AS has, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || '|' || CASE WHEN source IS NULL THEN '0' ELSE '1' END || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS k FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY k) - 1 AS nth FROM d0), d AS (SELECT *, ('0x' || substr(md5(k || ':' || nth), 1, 15))::BIGINT AS h FROM n),
s AS (SELECT source, has, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY has DESC, source) AS i FROM d GROUP BY source, has),
w AS (SELECT *, 1 + (i - 1) % 3 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (1 + (i - 1) % 3) AS fills FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fills, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY fills, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, has, source_size, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE level <= fills ORDER BY fills, i LIMIT 1)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
g AS (SELECT source, has, h, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY source, has ORDER BY h) AS upto FROM g),
x AS (SELECT source, has, h, upto - n / 2.0 <= target - (rounds * source_size)::DOUBLE AS more FROM c JOIN b USING (source, has))
SELECT doc_id, size, source_size, target, size * (rounds + CASE WHEN more THEN 1 ELSE 0 END) AS taken FROM d JOIN b USING (source, has) JOIN x USING (source, has, h)
"""

OP10 = r"""
WITH good AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score FROM good q JOIN good r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
