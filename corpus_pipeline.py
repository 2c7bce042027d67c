"""Cleans and packs the documents: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the shared
folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm import jaccard, langid, packing, suffixes, toxicity
from reelquarry.llm.common import materialize, split_by_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated string; passages of fifty words are longer.
PASSAGE_BYTES = 200
#: A document in which no language has this share is no text of a known language.
LEAST_SHARE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic; it is fitted on the labelled input documents."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(whole, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score_documents(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, those whose languages are so mixed that none has a fair share, and those in no learned language.

    The last are told by n-grams less likely than those of any fitted text; text in a language close to a learned one stays.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_share") >= LEAST_SHARE) & (F.col("lang_fit") >= model.least_fit)
    return langid.identify(docs.select(*COLUMNS), model).where(known).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group alike in five-word shingles at 0.8 or more.

    The rows of one id count as one document: they stay if one of them stands for its group. Rows without an id stay.
    """
    found = jaccard.near_duplicates(docs.select("doc_id", "text"), 5, 80, 100)
    losers = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays")).where("NOT stays").select("doc_id")
    # only rows that may go are shuffled
    losers = materialize(losers, "losers")
    some, rest = split_by_ids(docs.select(*COLUMNS), losers)
    return some.join(losers.hint("merge"), "doc_id", "left_anti").select(*COLUMNS).union(rest)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; bytes of a character that is cut go with it."""
    cut = suffixes.remove_repeats(docs.select(*COLUMNS), PASSAGE_BYTES)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = cut.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4096 tokens, one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: SQL can't express the classifiers; tests/llm/test_pipeline.py holds the stages against brute force and labels instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
