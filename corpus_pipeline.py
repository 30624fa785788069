"""A corpus pipeline of five stages; each works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of documents. ``run`` applies them to the documents of a folder.

Defined cases, for every stage: an empty table gives an empty one; texts are taken whole whatever their
length; other columns ride along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkgraph.llm import decontaminate, language, mixing
from inkgraph.llm.near_dup import deduplicated
from inkgraph.llm.queries import vocabulary
from inkgraph.llm.registry import table
from inkgraph.llm.token_files import written_and_read
from inkgraph.plans.tables import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or in no known language go.

    Null and empty texts go. Rows with a null doc_id or lang are judged like others, but not learned
    from; if there is nothing to learn from, all go. Repeated rows stay or go together.
    """
    return language.identified(docs, language.train(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    The one of least doc_id stays. Rows equal in doc_id and text are one; the rows of a doc_id with
    several texts are one document. Null and empty texts are near nothing; a row without a doc_id
    goes if its text is that of a document with one.
    """
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found.

    Null and empty texts hold none; with an empty benchmark all stay; repeated rows stay or go together.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: repeated documents are repeated rows.

    A null source is a source of its own; texts without words are in no mix; ties of the random key
    are rows equal in doc_id, told apart by their texts' hash.
    """
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document in them.

    Null and empty texts are the end id alone; null doc_ids come first, equal ones by their texts.
    """
    return written_and_read(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_output", token_output),
]

#: The language stage's code lengths and the minima of the near-duplicate stage are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    written: list[str] = []
    for name, stage in STAGES:
        docs, at = scratch.keep_at(stage(spark, docs, sf_dir), name)
        written.append(at)
        if len(written) > 1:
            scratch.drop(written.pop(0))
    return docs
