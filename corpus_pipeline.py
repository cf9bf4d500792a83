"""A training corpus from `documents`: quality rules, near-duplicates, secrets, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import jaccard, mixing, packing, quality_rules, secrets
from shelfscope.llm.queries import tokenizer_path
from shelfscope.llm.store import written


#: Columns that stages read or write; all others only pass through.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names of our own, which no operator uses."""
    return docs.toDF(*(x if x in READ else f"own_{i}" for i, x in enumerate(docs.columns)))


def restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs alone, the others under their own names again."""
    return out.select(*(F.col(x if x in READ else f"own_{i}").alias(x) for i, x in enumerate(docs.columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null, empty and wordless texts go; repeated rows and ties are judged each by
    itself; all columns pass through, whatever their names; an empty table gives an empty one."""
    return restored(quality_rules.judged(shielded(docs)).where("rejected_by is null"), docs)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id (nulls last). Rows without words are in no
    group and stay; repeated rows become one; all columns pass through; an empty table gives an empty one."""
    return restored(jaccard.one_per_group(shielded(docs)), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the spans of secrets masked. Nulls stay null; repeated rows are scanned each by itself; all columns pass
    through; an empty table gives an empty one."""
    return restored(secrets.redacted(shielded(docs)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many repetitions of each document as its source's target asks for. Null sources are one source; rows without words
    are taken no times; which of several equal rows gives more is open; all columns pass through; an empty table gives an
    empty one."""
    own = shielded(docs)
    return restored(mixing.repeated(mixing.mix(own), own.columns), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 2048 tokens. Null and empty texts are one token; repeated rows are documents
    of their own; only doc_id and text are read; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_per_group),
    ("secret_scans", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Near-duplicate search and tokenization are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
