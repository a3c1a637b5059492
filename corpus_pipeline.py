"""A training corpus from raw documents: toxicity, language, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes each result
as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, langid, neardup, packing, toxicity
from riskspark.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of its words that a document's first language must have.
LEAST_SHARE = 0.5
#: A text with a word has something besides ASCII white space.
WORDED = r"[^ \t\n\x0B\f\r]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, doesn't call toxic."""
    labels = toxicity.learning_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.learn(toxicity.learning_rows(docs), labels)
    return toxicity.score(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: one of them has at least LEAST_SHARE of the words."""
    model = langid.learn(langid.learning_rows(docs))
    found = langid.identify(docs.select(COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id, a null id being the largest; rows without words stay.

    Rows are told by id and text, so null and repeated ids decide nothing about other rows. Rows with equal id and
    text are one row before any join (partial minima, so copies leave a task as one).
    """
    rows = docs.select(COLUMNS).withColumn("_mark", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(WORDED), F.lit(False))
    groups = neardup.near_duplicates(rows.where(worded).select("doc_id", "text", "_mark"), carry=["_mark"])
    # A null id in a key of its own: null = null never matches.
    null, least = F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id")
    first = groups.groupBy("root").agg(F.min(F.struct(null, least, "_mark")).alias("_first")).select("_first.*")
    own = ["_null", "_id", "_mark"]
    single = rows.where(worded).select("*", null, least).groupBy(*own).agg(F.min(F.struct(*COLUMNS)).alias("_row"))
    return single.join(first, own, "left_semi").select("_row.*").unionByName(rows.where(~worded).select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.packed_documents(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Trained models have no SQL; the stages are tested one by one against brute force and labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
