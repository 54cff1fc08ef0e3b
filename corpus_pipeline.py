"""The corpus pipeline: toxicity, language identification, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import jaccard, language, packing, toxicity
from sluice.llm.common import materialize, short_batches, table

#: Share of letters in the main language below which a text counts as a jumble of languages.
LEAST_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Null and empty texts score by the
    classes' shares alone and so stay where toxic documents are the smaller class; repeated rows
    share one fate; an empty table gives an empty one; columns of any other name pass through."""
    short_batches(spark)
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least half of them in one language. Null and empty texts and those
    without a letter go; ties between languages go to the first by name; repeated rows share one
    fate; an empty table, or one without a known language, gives an empty one; columns of any other
    name pass through."""
    short_batches(spark)
    # a text without a known language has share 0
    found = language.predictor(spark, language.fit(docs))(F.col("text"))
    return docs.where(found["share"] >= LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Null and empty
    texts link with nothing and stay; of equal rows one stays; where ids repeat, each row is a
    document of its own; an empty table gives an empty one; other columns pass through."""
    short_batches(spark)
    return jaccard.one_per_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed into sequences. A null or empty text is one piece, the end id;
    a long one is cut; repeated rows are packed each; an empty table gives no rows."""
    short_batches(spark)
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL cannot train the stages' models; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
