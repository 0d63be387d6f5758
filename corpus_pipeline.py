"""The training-text pipeline: each stage reads what the one before it wrote.

Counted as part of the package's llm folder. Every stage but the last returns the columns of
``documents``; the last writes the token files and returns a row for each document in them.
An empty table gives an empty one in every stage. In all stages but the last, other columns, whatever their names, pass
unchanged; mixing cuts ``text`` and sets ``n_chars`` to fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagefacts.llm.common import materialize
from pagefacts.llm.decontamination import without_copies
from pagefacts.llm.jaccard_join import one_of_each_group
from pagefacts.llm.mixing import mixed_documents
from pagefacts.llm.sequences import encode_and_read
from pagefacts.llm.tokens import tokenizer_path
from pagefacts.llm.toxicity import without_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more. A null text scores as an empty one, repeated rows score alike, whole
    texts count; without labels all stay."""
    return without_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each component; documents without words (null or empty texts among
    them) or without doc_id all stay. Of rows that share the doc_id that is kept, one stays."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item. Null and empty texts stay, repeated rows fare alike; items
    without words are no items."""
    return without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and pass that the mix takes, with the words taken. Null and empty texts are not in the
    mix; a null source is a source of its own; repeated rows are taken each for itself."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all texts as Arrow sequences and returns what the files hold. A null text is an empty one, with the end id
    alone; repeated rows and ids are written each."""
    return encode_and_read(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]
#: Learning, alignment and tokenizing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it; the rows of the last one.
    An empty table of documents gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
