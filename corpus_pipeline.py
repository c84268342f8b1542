"""The corpus pipeline: five operators over ``documents``, each on all that its predecessor kept.

Defined cases: a null text has no letter and goes at the first stage; null ids come after all others
where one row of several stays; rows alike in id and text are copies, of which one stays; an empty
table passes as one. All stages but the last return the columns of their input, extra ones and names
that the operators use inside included; the last returns what it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, decontam, exact_dedup, langid, simhash
from tidegauge.llm.common import durable, table
from tidegauge.llm.queries import vocabulary_path

#: Texts farther than this from every language profile have none (1: no n-gram in common). Held-out
#: labelled documents lie below 0.55 and pieces of two words or more below 0.69; random letters of
#: ten words or more lie above 0.72 and languages that were not learned above 0.77.
MAX_DISTANCE = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like none of the languages learned from the labelled ones, go.

    Where no document is labelled nothing can be learned, and all stay.
    """
    profiles = langid.train(docs.where(langid.remainder() != 0))
    return langid.keep_languages(docs, profiles, MAX_DISTANCE) if profiles.languages else docs


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, then the least id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar five-word shingle sets stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item, or all of a shorter one, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids."""
    return bpe.round_trip(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: SQL expresses neither the profiles' n-gram ranks, the fingerprints nor the merges. What decides in a stage
#: is tested against brute-force versions; the chain as a whole by what must hold after each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
