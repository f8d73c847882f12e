"""A corpus pipeline of five operators; each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ready, table
from lodestone.llm.jaccard import link_documents
from lodestone.llm.language import identify
from lodestone.llm.mixing import mixed_documents, quality_domains
from lodestone.llm.packing import pack_documents
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.sieve import without_ids
from lodestone.llm.suffixes import remove_repeats
from lodestone.session import ensure_checkpoint_dir

# Packing into sequences is a plan over all lengths, which SQL cannot state; the tests restate each stage.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; null texts and texts without a letter go."""
    # All columns travel as one, so that none clashes with what the operator adds.
    rows = docs.select("text", F.struct(*docs.columns).alias("__row"))
    return identify(rows, docs, ["__row"]).where("lang_pred <> 'und'").select("__row.*")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 0.8); rows without an id stay."""
    copies = link_documents(docs, shingle=5, percent=80, rare=True).where("component_id <> doc_id").select("doc_id")
    return without_ids(docs, copies)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents, n_chars counted anew; documents of which nothing is left go."""
    others = [name for name in docs.columns if name != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("__row"))
    left = remove_repeats(rows, keep=["__row"], kept_text=True).where("n_removed < n_bytes OR n_bytes = 0")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[changed.get(name, F.col(f"__row.{name}")).alias(name) for name in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of domains asks for."""
    return mixed_documents(docs, quality_domains(table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs, tokenizer_path())


def prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ready(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", prepared(language_stage)),
    ("ngram_jaccard", prepared(jaccard_stage)),
    ("suffix_dedup", prepared(repeats_stage)),
    ("mixing", prepared(mixing_stage)),
    ("packing", prepared(packing_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; results between stages go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
