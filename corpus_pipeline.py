"""Raw documents to training text: quality rules, line dedup, near dedup, decontamination, BPE ids.

Each stage works on all rows that its predecessor kept, whole, and changes or
drops them; all but the last return the columns of documents.  ``n_chars``
follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm import bpe, fmindex, linededup, rules, simhash
from evalspark.llm.frames import documents, free_name, materialize
from evalspark.llm.queries import tokenizer_path


def _sized(rows: DataFrame, columns: list[str]) -> DataFrame:
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return rows.select(*[length.alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of repeated line runs."""
    names = free_name(docs, "removed"), free_name(docs, "n_removed")
    return _sized(linededup.dedup_lines(docs, names=names), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of benchmark phrases."""
    return _sized(fmindex.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded."""
    out = bpe.encode(docs, tokenizer_path(), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("encoding", encoding)]

#: The rules' exact binomial cutoffs and the tokenizer have no SQL form; tests/llm holds the rows against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
