"""A corpus from raw documents to training sequences, in four stages.

Each stage takes all documents that its predecessor kept and returns those that it keeps,
with the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.llm.common import saved
from censorium.llm.jaccard_join import similar_components
from censorium.llm.language_id import fit, held_out, predict
from censorium.llm.packing import pack_documents
from censorium.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in COLUMNS] or docs.columns


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, or only below the calibrated score, go."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).where("not rejected").select(_columns(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays: that with the smallest doc_id, a null one last.

    Rows equal in all columns are one row, told apart from others by a 64-bit hash; of different rows with
    one doc_id in a component that with the smallest hash stays.  Documents without words have no
    other duplicates and stay.
    """
    names = _columns(docs)
    # hashes pass over nulls, so where they are is hashed too
    rows = docs.select(*names, F.xxhash64(*(x for c in names for x in (F.col(c), F.col(c).isNull()))).alias("_row"))
    named = similar_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = rows.groupBy("_row").agg(F.min("doc_id").alias("doc_id"))
    keep = named.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("x")).select("x._row")
    # equal rows meet before the shuffle
    return rows.dropDuplicates(["_row"]).join(keep, "_row", "left_semi").select(names)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out; documents with nothing left go."""
    rows = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = rows.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, with their ids."""
    return pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Language identification and tokenization have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
