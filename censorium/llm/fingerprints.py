"""Canonical exact fingerprints of documents.

Canonical text: Unicode compatibility composition (NFKC), full case folding, composed
again, runs of white space as one space, trimmed.  Its 128-bit xxHash is the bucket; texts
that share a bucket are compared byte by byte, and should different texts ever share one,
each but the first gets a number after the hash.  So two documents have equal fingerprints
exactly if their canonical texts are equal, and the likeness of two is 1 or 0.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from censorium.llm.common import rows_are_few, saved, table, text_or_empty

#: Shared buckets that are sent to all executors at most; beyond it the comparison is a shuffled join.
BROADCAST_ROWS = 500_000


def canonical(text: str) -> str:
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def digests(text: str) -> tuple[str, bytes]:
    """Bucket and SHA-256 of a canonical text."""
    raw = text.encode()
    return xxhash.xxh128_hexdigest(raw), hashlib.sha256(raw).digest()


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal fingerprints, else 0.0; null if one is missing."""
    return (a == b).cast("double")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint)`` for each row; null text is empty, repeated rows stay.

    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digests(canonical(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], names=[id_col, "bucket", "digest"])

    texts = df.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    rows = saved(texts.mapInArrow(run, f"`{id_col}` {kind}, bucket string, digest binary"), "fingerprints")
    pairs = rows.select("bucket", "digest")
    return numbered(rows, "bucket", "digest", "fingerprint", numbers(pairs, collided(pairs, texts)))


def collided(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(bucket)`` of those in which the texts' bytes differ: next to always empty.

    Only texts in buckets with several rows are compared, and copies meet before the
    shuffle: grouping by bucket and text compares bytes and keeps one row per task.
    """
    shared = pairs.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [canonical(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digests(x)[0] for x in whole], pa.string()), pa.array(whole, pa.string())], names=["bucket", "canonical"])

    if rows_are_few(shared, BROADCAST_ROWS):
        shared = F.broadcast(shared)
    distinct = texts.select("text").mapInArrow(run, "bucket string, canonical string").join(shared, "bucket", "left_semi").groupBy("bucket", "canonical").agg(F.lit(1).alias("one"))
    return distinct.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")


def numbers(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``(bucket, digest, number)`` for buckets in which bytes, or else digests, differ."""
    kinds = pairs.groupBy("bucket", "digest").agg(F.lit(1).alias("one"))
    unequal = kinds.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket").union(found).distinct()
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("digest")) - 1
    return kinds.join(unequal, "bucket", "left_semi").select("bucket", "digest", rank.alias("number"))


def numbered(rows: DataFrame, bucket: str, digest: str, out: str, found: DataFrame) -> DataFrame:
    """The bucket and digest columns as a fingerprint."""
    right = found.select(F.col("bucket").alias(bucket), F.col("digest").alias(digest), F.col("number").alias("_number"))
    joined = rows.join(right, [bucket, digest], "left")
    return joined.withColumn(out, F.when(F.col("_number") > 0, F.concat_ws("-", F.col(bucket), F.col("_number").cast("string"))).otherwise(F.col(bucket))).drop("_number", bucket, digest)


EDITED = "doc_id long, n_chars long, edited_sha256 string, bucket string, digest binary, edited_bucket string, edited_digest binary, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _row(doc_id: int | None, text: str, after: str, own: tuple[str, str, bytes], nxt: str) -> tuple:
    new = edited(text, after)
    whole = canonical(new)
    return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own[1], own[2], *digests(whole), float(whole == own[0]), float(own[0] == nxt))


def with_edited(docs: DataFrame) -> DataFrame:
    """Each document's digests beside those of its edited text (see ``edited``), in ascending doc_id order.

    Documents are dealt out by ranges of doc_id (null first, equal ids by a hash of the
    text); a task compares neighbours.  Only the first and last text of each range meet
    in a second step to join the ranges up, the last document being followed by the first.
    """
    kinds = "part int, place int, text string, " + EDITED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, own = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                whole = canonical(text)
                mine = (whole, *digests(whole))
                if held is None:
                    out.append((part, 0, text, doc_id, *[None] * 8))
                else:
                    out.append((part, 1, None, *_row(*held, text, own, whole)))
                held, own = (doc_id, text), mine
            yield to_batch(out)
        if held is not None:
            yield to_batch([(part, 2, held[1], held[0], *[None] * 8)])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, after in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                whole = canonical(text)
                out.append((0, 1, None, *_row(doc_id, text, after, (whole, *digests(whole)), canonical(after))))
            yield to_batch(out)

    import re

    names = re.findall(r"(\w+) \w+(?:,|$)", kinds)
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[t] for t in re.findall(r"\w+ (\w+)(?:,|$)", kinds)]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = saved(ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, kinds), "edited")
    edges = rows.where("place != 1").select("part", "place", "doc_id", "text")
    in_order = Window.orderBy("part", "place")  # two rows a range
    following = edges.withColumn("after", F.coalesce(F.lead("text").over(in_order), F.first("text").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = following.where("place = 2").select("doc_id", "text", "after").mapInArrow(join_up, kinds)
    return rows.where("place = 1").unionByName(ends).drop("part", "place", "text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and what they say of each other and of the next document."""
    docs = table(spark, sf_dir, "documents")
    rows = with_edited(docs)
    pairs = rows.select("bucket", "digest").union(rows.select("edited_bucket", "edited_digest"))
    found = numbers(pairs, collided(rows.select("bucket", "digest"), docs.select(text_or_empty().alias("text"))))
    out = numbered(numbered(rows, "bucket", "digest", "fingerprint", found), "edited_bucket", "edited_digest", "edited_fingerprint", found)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
