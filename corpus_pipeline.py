"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

All stages take rows as they are: texts may be null, empty or very long, doc_ids null or repeated, and rows may stand several
times. Each row is judged by its own text; an empty table gives no rows. Other columns pass through, but for the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Scratch, numbered, table
from folio.llm.decontaminate import decontaminate
from folio.llm.mixing import mixed_documents
from folio.llm.parity_join import link_components
from folio.llm.token_output import token_digest
from folio.llm.toxicity import without_toxic

#: SQL cannot express the trained model and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject; null text counts as empty and stays."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id stays, one row of it; a null doc_id comes last. Rows without
    words have no links and all stay."""
    scratch = Scratch(spark, "near_duplicates")
    rows = numbered(docs, scratch)
    linked = link_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    staying = linked.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(least.alias("stays")).select("stays._row")
    staying = scratch.keep(staying, "staying")  # its size is known to the join: texts are shuffled only if it is large
    return rows.join(staying, "_row", "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; rows without words give nothing."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files that are written."""
    import public_tokenizers

    return token_digest(docs, public_tokenizers.path("word_bpe_49k.json")).drop("shard", "seq")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        was, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(was)
    return docs
