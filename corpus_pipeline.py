"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the
next one; all but the last return the columns of ``documents``. Rows may have nulls in any column, empty or very
long texts, repeated rows and further columns; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import langid, mixing, packing, pii, simhash
from riskloom.llm._common import staged, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
SHINGLE_WORDS = 3
MOST_BITS = 3


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, if there, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language the compression classifier rejects: no letter, or a margin under 1 %.

    The dictionaries come from the documents' own languages; without any, no document is known and none stays.
    """
    found = langid.identify(docs, langid.fit(docs), prefix="_language_")
    return found.where("_language_accepted").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id; repeated rows come once.

    Documents link where the SimHash fingerprints of their three-word shingles differ in at most 3 bits. Unlike texts
    under one doc_id are documents of their own; those without a doc_id link like others and come last in their group.
    """
    row = next(name for name in (f"_row{n}" for n in itertools.count()) if name not in docs.columns)
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), ident.alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(others).alias("rest"))
    rows = docs.withColumn(row, key)
    parts = simhash.near_duplicate_components(rows, row, radius=MOST_BITS, size=SHINGLE_WORDS)
    first = parts.where(F.col(row) == F.col("component_id")).select(row).distinct()
    return rows.join(first, row, "left_semi").dropDuplicates([row]).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """E-mail and IP addresses, card and phone numbers give way to their kind in brackets; no document goes."""
    return _with_length(pii.redact(docs, pii.fit(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut or left out as the mix takes their words."""
    return _with_length(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2,048-token sequences with their token ids, each window of sequences in the mix of the sources."""
    return packing.pack(docs, tokenizer_path(TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
# Trained models, hashes and draws decide the rows; SQL cannot say them. The tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
