"""Cleans a corpus and turns it into tokens, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written
as Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, line_dedup, sentencepiece_bpe, simhash, toxicity
from tidewater.llm.common import fresh, scratch_path, table

#: What line deduplication left of a copy is no document if it is under this share of the text and has fewer words than this.
REMAINDER, OWN = 0.2, 50
#: Near duplicates: shingles of five words, fingerprints that differ in at most so many bits, or sets of shingles at least so similar.
SHINGLE, NEAR_BITS, SIMILAR = 5, 4, 0.8


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels that belong to docs.

    Null, empty and blank texts score 0 and stay, and so does everything where no label is toxic;
    repeated rows go or stay together; long texts are scored whole; other columns aren't read.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxicity < 0.5").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with earlier ones.

    A document of which less than REMAINDER and fewer than OWN words are left is a copy and goes; any other
    stays with what is left. Null and empty texts stay; n_chars of a shortened text is its new length; rows that
    share an id aren't compared with each other; rows without an id come after all others.
    """
    before = fresh(docs, "before")
    cut = line_dedup.line_dedup(docs.withColumn(before, F.coalesce(F.length("text"), F.lit(0))))
    words = F.size(F.split(F.trim("text"), "\\s+"))
    kept = cut.where(F.col("deleted").isNull() | (F.length("text") >= REMAINDER * F.col(before)) | (words >= OWN))
    return kept.withColumn("n_chars", F.when(F.col("deleted").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Null, empty and blank texts are one group; rows without an id stay only where their group has no id, and
    then, as where the smallest id repeats, the first in the order of the input.
    """
    return simhash.keep_first(docs, SHINGLE, NEAR_BITS, SIMILAR)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is decided by its own text; null and empty ones stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text and what they decode to, as digests.

    A row each, repeated ones too; null and empty texts have no ids and decode to the empty text.
    """
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    coded = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), model, decoded="decoded")
    return sentencepiece_bpe.digests(coded, "lang", "source", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding and decoding", tokenised),
]

#: Training, alignment and tokenising have no SQL; tests compare the stages with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
