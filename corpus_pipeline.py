"""The corpus pipeline: from raw documents to packed training windows.

Stages: language ID drops texts without a language, and those for which no language is likelier than
all others together (a score under 0.5); exact dedup keeps one row per text; near-dedup keeps one
document per group; the secret scan masks what it finds and keeps the documents; packing cuts the rest
into windows. Every stage but the last returns the columns of ``documents``, whatever their names.

Nulls and odd input, the same in all stages: a null text counts as empty. The language stage drops
null, empty and letterless texts; given such rows, the later stages keep them (of equal ones exact
dedup keeps one, near-dedup links none, the secret scan leaves them as they are, packing gives them the
end id alone). A null id is passed on; exact dedup prefers any id to it, and near-dedup never drops such
a row. Of rows equal in id and text one stays, with the greatest other columns. Texts are read whole at
any length. An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from speechmart.llm.common import materialize, table
from speechmart.llm.exact_dedup import keep_first_texts
from speechmart.llm.language_id import keep_identified
from speechmart.llm.near_dedup import keep_representatives
from speechmart.llm.packing import pack_documents
from speechmart.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifiers know, with a score of 0.5 or more."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every distinct text (A-Z lower-cased): the one with the largest id."""
    return keep_first_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for every group of near copies, linked at a similarity of 0.8 or more."""
    return keep_representatives(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` set anew where that changed a text."""
    return redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
