"""The registered queries over the given tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, hard_negatives, licenses, line_dedup
from .alignment import aligned_documents
from .decontamination import benchmark_copies
from .fingerprints import fingerprints
from .jaccard_join import jaccard_components
from .mixing import taken_words
from .sequences import encode_and_read
from .substring_dedup import repeated_passages
from .tokens import token_counts, tokenizer_path
from .toxicity import with_toxicity

TOKENIZER = "byte_bpe_50k.json"
QUERIES: dict = {}
ORACLES: dict[str, str] = {"op5_license_scan": licenses.sql(), "op8_line_dedup": line_dedup.sql(), "op11_chat_format": chat_format.sql(), "op13_hard_negatives": hard_negatives.SQL}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by shared shingles: doc_id, n_shingles, component_id (see ``jaccard_components``)."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts (see ``fingerprints``)."""
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document (see ``taken_words``)."""
    return taken_words(table(spark, sf_dir, "documents"))


@query
def op4_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in Arrow files, read back (see ``encode_and_read``)."""
    return encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of all documents that hold any (see ``licenses.scan``)."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null doc_id is not held out, as no label tells of it (see ``with_toxicity``)."""
    scored = with_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of benchmark items in all documents (see ``benchmark_copies``)."""
    return benchmark_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without their hosts' boilerplate lines (see ``line_dedup.without_boilerplate``)."""
    return line_dedup.without_boilerplate(table(spark, sf_dir, "pages"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that stand elsewhere too (see ``repeated_passages``)."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents (see ``token_counts``)."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations as formatted and read back (see ``formatted_conversations``)."""
    return chat_format.formatted_conversations(table(spark, sf_dir, "conversations"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut all documents, with corpus-wide counts (see ``aligned_documents``)."""
    return aligned_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors among all vectors (see ``mined_negatives``)."""
    return hard_negatives.mined_negatives(table(spark, sf_dir, "embeddings"))
