"""The training-data pipeline: documents through five of the corpus operators, stage by stage.

A stage takes what its predecessor kept, as reread from Parquet. All but the last return the
columns of documents; the last returns the tokens. No stage crashes on nulls, repeated rows or
an empty table; each defines their result with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import encoded
from tidemark.llm.common import fresh, marked, stored
from tidemark.llm.language import UNDETERMINED, fit_language, language
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mixed
from tidemark.llm.queries import table, vocabulary
from tidemark.llm.toxicity import fit_toxicity, toxicity_score

TOXIC = 0.7
# A text of at least so many characters must show its language in half of its letters.
JUDGED_CHARS = 100
LEAST_LANGUAGE = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7; labels come from the labels table."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    scored = docs.withColumn(score, toxicity_score(docs, F.col("text"), model))
    return scored.filter(F.col(score) < TOXIC).drop(score)


def reject_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language; short ones are judged only on having letters."""
    model = fit_language(docs.select("doc_id", "text", "lang"))
    found = fresh(docs, "language")
    labelled = docs.withColumn(found, language(docs, F.col("text"), model))
    sure = (F.length("text") < JUDGED_CHARS) | (F.col(found)["score"] >= LEAST_LANGUAGE)
    return labelled.filter((F.col(found)["lang_pred"] != UNDETERMINED) & sure).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8.

    Repeated rows of one doc_id count once; rows without an identifier pass.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    by_id = judged.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if("kept").alias("_rows"))
    by_id = stored(by_id, "judged")
    # Few documents are dropped: only those whose mark may be that of a dropped one are shuffled.
    dropped = stored(by_id.filter("_rows = 0").select("doc_id"), "dropped")
    maybe = fresh(docs, "dropped")
    found = marked(docs.filter("doc_id IS NOT NULL"), "doc_id", dropped, maybe)
    doubtful = found.filter(F.col(maybe)).select(docs.columns).join(dropped, "doc_id", "left_anti")
    stay = found.filter(~F.col(maybe)).select(docs.columns).unionByName(doubtful.select(docs.columns))
    if not by_id.filter("_rows > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, none more than three times; rows repeat as often as taken."""
    return mixed(docs, epochs=3)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document and the digest of what they decode to."""
    coded = docs.select(
        "doc_id", "source", "lang", encoded(docs, F.col("text"), vocabulary("word_bpe_49k.json")).alias("c")
    )
    return coded.select(
        "doc_id",
        "source",
        "lang",
        F.size("c.ids").cast("long").alias("n_tokens"),
        F.col("c.ids").alias("ids"),
        F.sha2(F.col("c.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_languages),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe_coding", encode_texts),
]

# SQL expresses neither the trained models nor the automaton; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
