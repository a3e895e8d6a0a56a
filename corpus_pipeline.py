"""From raw documents to token ids, in five stages; each works on all that the one before it kept.

All stages take an empty table (and give one), null ids, and further columns of any name, which all but the last keep
as they are. A null text counts as an empty one wherever texts are judged and stays null where it is kept. What a stage
does with repeated rows and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm import bpe, decontam, secrets, simhash, toxicity
from condensa.llm.common import scratch
from condensa.llm.queries import table, tokenizer

#: Documents from this score on are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier rejects; labels are learned as in op1.

    Null and empty texts have the score of the bias alone, like all others without known words; repeated rows go or stay
    together. A document at the limit itself goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model, name="__toxic").where(F.col("__toxic") < TOXIC_FROM).drop("__toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8 or more: that of smallest id.

    Candidates are found by SimHash, an inverted index of the fingerprints' bytes in place and a tally of shared bytes, as in
    op4; the exact similarity decides.

    Rows that are repeated, and all null and empty texts (and those of white space only), are groups too, of which one
    row stays; of a group without any id, one row. Of rows with equal ids that stand for a group the one with the
    smallest hash of its text stays.
    """
    return simhash.drop_similar(docs, shingle_words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold ten successive words of a benchmark item (or all words of a shorter one).

    Texts are judged, not rows: rows of equal text go or stay together, whatever their ids are. Null and empty texts stay.
    """
    content = F.md5(F.coalesce("text", F.lit("")))
    found = decontam.contamination(docs.select(content.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("__content")).distinct()
    return docs.withColumn("__content", content).join(bad, "__content", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark, and n_chars of the text that is left (null for a null text)."""
    model = secrets.train(secrets.labelled_samples(docs))
    clean = secrets.redact(secrets.find_secrets(docs, model, name="__secret_spans"), spans="__secret_spans")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of the text that is left; one row for each document, null texts without tokens."""
    ids = bpe.encode(docs, tokenizer("byte_bpe_50k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Hashes of shingles, the classifier and the tokenizer cannot be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
