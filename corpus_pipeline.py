"""A corpus from raw documents to packed sequences, in five stages of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage sees what its predecessor kept, written as Parquet and read again. So when a stage begins, what its predecessor
wrote for its own use is deleted: a stage's frame must have been written or collected before the next stage is called.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrata.llm import jaccard, langid, packing, pii, quality
from varstrata.llm.common import stash, table
from varstrata.scratch import discard, give_back, made

#: A text whose best language has a smaller score is in none of the languages learned.
LEAST_SCORE = 0.2


#: What the last stage has written for its own use.
_left: list = []


def stage(work):
    """work as a stage of the pipeline, which clears up after the stage before."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(_left)
        give_back(spark)
        with made() as tables:
            out = work(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return run


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it a new column."""
    while name in docs.columns:
        name += "_"
    return name


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null, have no letter or fit no language go. Learns from docs itself."""
    lang, score = (unused(docs, name) for name in ("lang_pred", "score"))
    told = langid.identify(docs, langid.train(docs), docs.columns, names=(lang, score))
    return told.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond the fences of their language and source go."""
    return quality.keep_good(docs)


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies on word 5-grams at a similarity of 0.8: of each group the document with the smallest doc_id stays."""
    return jaccard.first_of_each(docs, n=5, percent=80)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is masked."""
    return pii.redact(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids and places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: Support vector machines and packing are beyond SQL; tests hold run() against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stash(work(spark, docs, sf_dir), name)
    return packing.places(STAGES[-1][1](spark, docs, sf_dir))
