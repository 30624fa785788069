"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm import chat, decontaminate, language, licenses, mixing, pii, quality
from inkgraph.llm.near_dup import near_duplicate_classes
from inkgraph.llm.registry import SQL, query, table
from inkgraph.llm.token_files import written_and_read
from inkgraph.llm.tokens import token_counts

#: Folder of the vocabulary files, the same on every machine.
TOKENIZERS = os.environ.get("INKGRAPH_TOKENIZERS", "")


def vocabulary(name: str) -> str:
    """Where a vocabulary file is: the folder named in INKGRAPH_TOKENIZERS, else the installed package's."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles, similarity 0.8 or more."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of the threshold table for all documents."""
    return quality.quality_measures(table(spark, sf_dir, "documents")).select(*quality.RESULT)


SQL["op9_quality_rules"] = quality.SQL


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the 32k piece vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select(*mixing.RESULT)


SQL["op2_mix_sources"] = mixing.SQL


@query
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.span_digests(pii.pii_spans(table(spark, sf_dir, "documents")))


@query
def op6_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as range-coded blocks and read back."""
    return written_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted in windows and read back."""
    return chat.read_back(chat.chat_windows(chat.with_probe(table(spark, sf_dir, "conversations"))))


SQL["op3_chat_windows"] = chat.SQL


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of the benchmark."""
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumn("n_items", F.size("item_ids").cast("long"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"), inline=True)


SQL["op10_license_scan"] = licenses.SQL
