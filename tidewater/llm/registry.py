"""The registered queries of the training-data operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tidewater.llm import decontaminate, exact_dedup, line_dedup, sentencepiece_bpe, sharding, simhash, substring_dedup, toxicity, url_filter, warc
from tidewater.llm.common import scratch_path, table


def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode(docs, model, decoded="decoded"))


def op2_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_dedup(spark, sf_dir):
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        "deleted",
        "sources",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_decontamination(spark, sf_dir):
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op10_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digests(sharding.shuffle(docs, scratch_path(spark, "shards")))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
}

#: Base32 of a SHA-1: each five hex digits are four characters of five bits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31 AS INTEGER), 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

ORACLES = {
    "op2_warc": f"""
        WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS x FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
        SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d
    """,
}
