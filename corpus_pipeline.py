"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as a table and reads it again as
the next one's docs. All stages but the last return the columns of documents.

Null and empty texts score low and go with the first stage. Repeated rows count as often as they occur until the
third stage, which keeps one. A very long text is one row in every stage; columns beside doc_id and text are carried along.
An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import drop_scratch, materialize, table
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.mixing import mix
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.packing import pack_documents
from tideline.llm.quality_classifier import fit_on_labels, score_texts, stats_table

MIN_QUALITY = 0.7
#: Repeated runs of fewer than three lines go from so many words on.
RUN_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least MIN_QUALITY."""
    model = fit_on_labels(materialize(stats_table(docs), "stats"), table(spark, sf_dir, "labels"))
    return score_texts(docs, model, out="_score").filter(F.col("_score") >= MIN_QUALITY).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line runs that came before; documents with nothing else in them go."""
    out = dedup_lines(docs, words=RUN_WORDS).withColumn("n_chars", F.length("text").cast("long"))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.filter(~emptied).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Documents without an id stay, and so do different texts under one id."""
    first = near_duplicates(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, those without an id too. No domain is raised: the texts are deduplicated by now."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    taken = mix(packed, table(spark, sf_dir, "labels"), keep=("row",), upsample=False).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the trained models and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            drop_scratch(docs)
        docs = made
    return docs
