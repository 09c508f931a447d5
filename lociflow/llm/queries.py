"""The query of each operator over its whole table, and the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociflow.llm import (alignment, credentials, decontaminate, dialogue, exact_dedup, licenses, packing, pii, quality, shards, simhash, toxicity, urls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PII_KEY = "key of the named query"
BLOCK, ALLOW = ("com/en/", "example.net/de/8", "org/es/"), ("example.com/en/7", "net/de/")
BENCHMARK_WINDOW, CAPACITY = 10, 2048
SHARDS = 40


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_dedup", r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)""")
def op1(spark, sf_dir):
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).drop("row_key")


@query("op2_pii_pseudonyms")
def op2(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_decontaminate")
def op4(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BENCHMARK_WINDOW).drop("items", "row_key")


@query("op5_secrets")
def op5(spark, sf_dir):
    return credentials.find_secrets(table(spark, sf_dir, "documents"))


@query("op6_url_filter", r"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
    ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
judged AS (SELECT doc_id, max((quality = 0)::int) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, coalesce(sum(bad), 0)::double AS k, count(bad)::double AS n, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
                 string_split(host, '.')[-1] AS suffix
          FROM parsed LEFT JOIN judged ON doc_id = page_id GROUP BY host),
share AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS prior FROM hosts),
l1 AS (SELECT suffix, sum(k) AS k, sum(n) AS n, (SELECT prior FROM share) AS prior FROM hosts GROUP BY suffix),
s1 AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum(power(k - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0.001))) - 1 AS s FROM l1),
p1 AS (SELECT suffix, (prior * s + k) / (n + s) AS prior FROM l1, s1),
l2 AS (SELECT suffix, domain, sum(k) AS k, sum(n) AS n, any_value(prior) AS prior FROM hosts JOIN p1 USING (suffix) GROUP BY suffix, domain),
s2 AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum(power(k - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0.001))) - 1 AS s FROM l2),
p2 AS (SELECT suffix, domain, (prior * s + k) / (n + s) AS prior FROM l2, s2),
l3 AS (SELECT host, k, n, prior FROM hosts JOIN p2 USING (suffix, domain)),
s3 AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum(power(k - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0.001))) - 1 AS s FROM l3),
low AS (SELECT host, (prior * s + k) / (n + s) AS m, n + s AS total FROM l3, s3)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (total + 1)) > (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 1 END FROM hosts) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN fit USING (host, path) LEFT JOIN low USING (host)""")
def op6(spark, sf_dir):
    """Pages have no labels of their own, so the quality label of the document of the same number judges a page. In these
    tables the two have nothing else in common, so what the reputation finds is chance; with outcomes of pages it is not."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), outcomes, BLOCK, ALLOW).drop("bad_low")


@query("op7_quality")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY)


@query("op9_simhash")
def op9(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("kept", "row_key")


@query("op10_licenses")
def op10(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_hilbert_shards", shards.oracle_sql({"lang": "lang", "source": "source", "bytes": "strlen(text)"}, SHARDS))
def op11(spark, sf_dir):
    placed = shards.hilbert_shards(table(spark, sf_dir, "documents"), {"lang": "lang", "source": "source", "bytes": "octet_length(text)"}, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model")).documents


@query("op13_dialogue_repair")
def op13(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return dialogue.repaired_summary(conversations, dialogue.damage(conversations))
