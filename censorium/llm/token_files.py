"""Token-ID files: Parquet list columns with dictionary-coded ids.

Layout: one Parquet file per range of ascending ids, one row per document:
``doc_id, part, seq, n_tokens, ids``.  ``ids`` is dictionary coded (a row group sees
far fewer distinct ids than ids; falling back to delta coding is the format's own
rule under writer version 2), row groups and pages are bounded, and the page index is
on, so that a reader of some documents, or of the metadata columns alone, touches only
those pages.  Spark's own writer and commit protocol make it safe to lose executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from censorium.llm.common import scratch, table, text_or_empty
from censorium.llm.tokens import encode_lists, pretokens, with_end

#: Parquet settings of the format: bytes of a row group and of a page, rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
END_ID = 2


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int | None = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode ``docs(doc_id, text)`` and write token files in ascending doc_id order.

    Null text is an empty text (only the end id).  A null doc_id sorts first, equal
    doc_ids follow one another, ordered by a hash of their texts.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for first, flat, counts in encode_lists(batch.column(2), tokenizer):
                if end_id is not None:
                    flat, counts = with_end(flat, counts, end_id)
                n = len(counts)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.arange(seq, seq + n)), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "part", "seq", "n_tokens", "ids"],
                )
                seq += n

    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    split = ordered.select("doc_id", F.spark_partition_id().alias("part"), pretokens(F.col("text")).alias("words"))
    rows = split.mapInArrow(run, "doc_id long, part int, seq long, n_tokens long, ids array<int>")
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *, tokens: bool = True) -> DataFrame:
    """The rows of token files; without ``tokens`` only the metadata columns are read.

    A filter on doc_id reaches the scan and, by the page index, skips pages.
    """
    rows = spark.read.schema("doc_id long, part int, seq long, n_tokens long, ids array<int>").parquet(path)
    return rows if tokens else rows.drop("ids")


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, seq, start, n_tokens)``: start counts the ids of all rows before.

    Reads metadata pages only.  Running sums are taken inside each file range; what
    meets in one place is one row per range.
    """
    rows = read_tokens(spark, path, tokens=False)
    per_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = per_part.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(F.broadcast(before), "part").select("doc_id", "part", "seq", (F.col("before") + F.col("inside")).alias("start"), "n_tokens")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def token_digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, part, seq, ids_crc32)`` of token-file rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = np.asarray(lists.flatten()).astype("<u4"), np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "part", "seq", "ids_crc32"])

    return rows.select("doc_id", "part", "seq", "ids").mapInArrow(run, "doc_id long, part int, seq long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files read back."""
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    sums = token_digests(read_tokens(spark, path))
    return token_offsets(spark, path).join(sums.drop("doc_id"), ["part", "seq"]).select("doc_id", "start", "n_tokens", "ids_crc32")
