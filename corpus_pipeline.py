"""Corpus pipeline over the documents table: language, lines, near-duplicates, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its result as Parquet in the shared folder and rereads it as
the next stage's input. All stages but the last return the columns of ``docs``, whatever they are.

Defined results: rows with a null text or no letter are rejected by the first stage; an empty table passes through all stages
and packs to nothing; near-duplicates are told apart by row, so rows that share an id or have none are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from creditloom.llm.common import held, numbered, read, sized, staged

#: A text that needs more bits a character than this in its best language is in none of the languages (noise needs about 15).
MOST_BITS = 10.0
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that parse in one of the languages of the labelled rows."""
    samples = language_id.training_samples(docs.filter(~held("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").alias("text"))
    found = language_id.predict(whole, samples)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits") <= MOST_BITS)).select("__doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines whose template recurs across documents."""
    return line_dedup.drop_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the one with the smallest id (a null id is the largest), of each group of near-duplicates."""
    rows = numbered(docs)
    found = near_dedup.near_duplicates(rows.select("__row", "text"), id_col="__row").select(F.col("doc_id").alias("__row"), "component_id", "kept")
    found = staged(found, "rows")
    groups = staged(found.filter("not kept").select("component_id").distinct(), "groups")
    members = found.join(sized(groups, groups.count()), "component_id", "left_semi").join(rows.select("__row", "doc_id"), "__row")
    members = staged(members.select("__row", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "__row").alias("at")), "members")
    first = members.groupBy("component_id").agg(F.min("at").alias("first"))
    gone = staged(members.join(first, "component_id").filter(F.col("at") != F.col("first")).select("__row"), "gone")
    return rows.join(sized(gone, gone.count()), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; documents that are mostly benchmark go."""
    return decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.packed_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The stages can't be written as SQL (suffix automata, tokenizer); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
