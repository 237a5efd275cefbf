"""A training corpus from raw documents: language, near copies, repeats, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``; ``n_chars`` is kept true when a text is cut.

Defined cases: documents without a letter (null texts too) go, which is what the
classifier calls no language; if no document names its language all others stay; of a component of near copies the smallest id stays; texts lose repeated
strings but a document stays even if nothing is left of its text; documents
that hold any benchmark window go; all others are encoded. Empty tables give
empty results; columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import bpe, decontaminate, jaccard_join, langid, suffix_dedup
from lumenloom.runtime import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier recognises; with no labelled text to learn from, all that have a letter."""
    names = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"
    model = langid.fit(docs)
    learned = bool(model[0])
    judged = langid.predict(marked, model, text=text).where("lang_pred <> 'und'") if learned else marked.where(langid.has_letter(F.col(text)))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked at five-word shingles and a similarity of 0.8."""
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes or more that occur twice."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_documents(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL cannot express the classifier; the tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
