"""A cleaning pipeline over ``documents``: each stage's rows are written and read as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailfold.llm import language, line_dedup, packing, personal_data, probminhash
from mailfold.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express compression or tokenisers; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language by compression; documents of undecided language go."""
    return language.keep_decided(docs, language.learn(docs, ~language.held_out()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of lines leave the texts."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return probminhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    seen = settle(personal_data.found(docs), "llm-personal")
    return personal_data.masked(docs, personal_data.accepted_patterns(seen))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
