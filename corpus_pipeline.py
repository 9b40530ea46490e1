"""A training-data pipeline over ``documents``: each stage works on what its predecessor kept.

Stages judge rows one by one or by groups, as their operators define: a null text is an empty one,
null ids, repeated rows and extra columns of any name pass through, and an empty table gives
an empty table. All but the last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, langid, line_dedup, packing, quality_rules
from tidemark.llm.common import materialise, released

#: A language whose posterior probability is less than this isn't trusted.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; trained on the labelled rows of ``docs``.

    Null and empty texts and texts without a letter have no language and go; without a labelled row
    nothing has one. Rows with null ids are judged like others but aren't learned from.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = langid.identify(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and no learned rule rejects.

    Rules come from ``labels`` of documents that are still there; without labels of both classes
    only the base rules hold. Null and empty texts fail these.
    """
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality_rules.apply_rules(docs, rules).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from texts; every document stays and ``n_chars`` follows its text.

    Rows with one id are one document. A null text stays null, with the ``n_chars`` it had.
    """
    out = line_dedup.drop_repeated_lines(docs, distinct_ids=True).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    chars = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the least id, null ids last.

    Texts without words are in no group, and all stay; rows equal in id and text are one document.
    """
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; every row, a null or empty text too, is in one."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]

#: Language ID, learned rules and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is a written table, and what a stage
    wrote on the way is deleted when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with released(spark):
            made = stage(spark, docs, sf_dir)
            docs = materialise(made, f"stage-{k}", keep=True)
    return docs
