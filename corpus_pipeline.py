"""The corpus pipeline: documents in, encoded documents out.

Each stage calls one operator and works on all that the stage before it kept;
between stages the documents are a Parquet table in the shared folder.

Defined results: null texts count as empty; so of null and empty texts one stays, and
its encoding is null or empty.  Rows that repeat are one document after exact dedup.
Ties go to the largest doc_id among equal texts and to the smallest among near copies;
null ids come last in both.  Very long texts are read whole, empty tables give empty
ones, and extra columns of any name are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, pieces, queries, simhash, toxicity
from lodestone.llm.workspace import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, queries.toxicity_model(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near copies connect (five-word shingles, Jaccard similarity of 0.8
    or more) the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, and whether decoding gives the text back."""
    model = queries.tokenizer_path("piece_bpe_32k.model")
    # A smaller dictionary than the operator's own: the workers of the earlier stages still hold memory.
    rows = pieces.encode(docs.select("doc_id", "text"), model, decoded_col="decoded", dictionary_words=250_000)
    return rows.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "piece_ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        out = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
        ws.drop(docs)
        docs = out
    return docs
