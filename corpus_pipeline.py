"""A training corpus from raw documents: identified, near-deduplicated, decontaminated, mixed, and written as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm.decontamination import keep_clean
from rankweave.llm.language_id import fit, keep_identified
from rankweave.llm.mixing import mixed_documents
from rankweave.llm.near_dedup import keep_one_of_each
from rankweave.llm.token_output import token_output
from rankweave.session import stored
from rankweave.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or with a score under 0.3 go."""
    return keep_identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of the sources takes them."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_ids),
]

#: Models, components and token files are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
