"""A corpus pipeline: quality filter, near-duplicate removal, surrogates for personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes each result as
Parquet into the shared scratch folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import mixed_rows
from tessera.llm.partenum import one_of_each
from tessera.llm.pieces import encoded
from tessera.llm.pii import replace_entities
from tessera.llm.quality import accepted
from tessera.scratch import cut
from tessera.workers import reach


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted to the labels of these documents, scores 0.5 or more."""
    reach(spark)
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by shingle Jaccard 0.8 or more."""
    reach(spark)
    return one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by keyed surrogates."""
    reach(spark)
    return replace_entities(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    reach(spark)
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit, begin and end included) and the decoded text's digest."""
    import public_tokenizers

    reach(spark)
    out = encoded(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("pii_surrogates", surrogates),
    ("source_mixing", source_mix),
    ("sentencepiece", token_ids),
]

#: The first two stages train and iterate, so SQL can't express the rows of run(); tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
