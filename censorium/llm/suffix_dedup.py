"""Removal of passages that occur in earlier documents, by levels of sorted hashes at anchors.

A byte goes if it is covered by a string of ``least`` bytes that also starts in a document
with a smaller doc_id.  Full suffix arrays of a corpus take many times its size, so none are
built: a position is an *anchor* if the hash of its first GRAM bytes is the
smallest of some window, which makes anchors depend on content alone and puts one into every
string of ``least`` bytes.  What is kept are sorted hashes, without positions or suffix order,
dealt out to buckets by the leading bits.

Documents come in blocks of ascending doc_id.  In each bucket, within one call that has all its
blocks, a block's array is a new batch: it is merge-scanned against the existing levels, then added as a level, and levels of
like size are merged, so that sizes stay geometric.  Four scans narrow the work down, and
only what survives one reaches the next:

1. anchors' grams (40 bits each): which occur in several documents;
2. of those, the whole context that strings around the anchor can cover: an equal context in
   an earlier document settles all its strings at once (the inside of every long match);
3. of contexts that no earlier block has, the grams again: which of them stand in several contexts;
4. of anchors with those (the edges of matches), each string of ``least`` bytes.

What goes back to the blocks is one flag an entry.  Blocks lie in a table bucketed by
block, so text is shuffled once.  Every block sends an entry once however often it holds it, and
contexts are dealt out by their own hash, not by their gram's, so neither a passage nor a gram of
a third of all documents costs a bucket more than an entry per block.  Contexts and strings are
told apart by 96 bits: a 64-bit key and 32 bits of another hash beside it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.llm.common import saved, table, text_or_empty
from censorium.llm.shingles import mix

LEAST, GRAM = 50, 24
#: Text bytes of a block and of a bucket's share; positions hashed at once.
BLOCK_BYTES, BUCKET_BYTES, SLICE = 4 << 20, 16 << 20, 1 << 19
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_PAD = 128


class Levels:
    """Sorted arrays of keys with geometrically falling sizes; beside each may stand a second hash of each key's owner."""

    def __init__(self) -> None:
        self.arrays: list[np.ndarray] = []
        self.beside: list[np.ndarray | None] = []

    def seen(self, keys: np.ndarray, beside: np.ndarray | None = None) -> np.ndarray:
        """Which of the sorted keys some level holds, with the same second hash if there is one: a merge scan of each level."""
        found = np.zeros(len(keys), dtype=bool)
        for level, other in zip(self.arrays, self.beside, strict=True):
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            equal = level[at] == keys
            if beside is None:
                found |= equal
                continue
            open_, at = np.flatnonzero(equal), at[equal]
            while len(open_):
                same = other[at] == beside[open_]
                found[open_[same]] = True
                # equal keys with different second hashes stand side by side
                open_, at = open_[~same], at[~same] + 1
                on = at < len(level)
                on[on] = level[at[on]] == keys[open_[on]]
                open_, at = open_[on], at[on]
        return found

    def add(self, keys: np.ndarray, beside: np.ndarray | None = None) -> None:
        """A new level of sorted keys; levels not larger than twice the new one merge with it."""
        if not len(keys):
            return
        while self.arrays and len(self.arrays[-1]) <= 2 * len(keys):
            keys, other = np.concatenate((self.arrays.pop(), keys)), self.beside.pop()
            if beside is None:
                keys.sort(kind="stable")  # merges two runs
            else:
                order = np.argsort(keys, kind="stable")
                keys, beside = keys[order], np.concatenate((other, beside))[order]
        self.arrays.append(keys)
        self.beside.append(beside)


def _among(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, keys), len(sorted_set) - 1)] == keys


class Block:
    """The texts of a run of documents, one after another, and what the scans say of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, least: int, bits: int) -> None:
        self.ids, self.sizes, self.least, self.bits = ids, sizes, least, bits
        self.n = len(data)
        self.data = np.frombuffer(data + bytes(_PAD), dtype=np.uint8)
        self.words = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        #: Documents with equal ids have equal ranks.
        self.rank = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, dtype=np.int64)

    def _gram(self, at: np.ndarray | slice) -> np.ndarray:
        if isinstance(at, slice):
            x = [self.words[at.start + o : at.stop + o] for o in (0, 8, 16)]
        else:
            x = [self.words[at + o] for o in (0, 8, 16)]
        h = x[0] * _K[0]
        h ^= h >> np.uint64(29)
        h += x[1] * _K[1]
        h ^= h >> np.uint64(32)
        h += x[2] * _K[2]
        return mix(h)

    def anchor_grams(self) -> np.ndarray:
        """Grams of the anchors, hashed once more: an anchor's hash is the smallest of a window, so its leading bits would fill few buckets."""
        return mix(self._gram(self.at) + _K[1])

    def anchors(self) -> None:
        """Positions, documents and grams of the anchors."""
        w = self.least - GRAM + 1
        found = []
        for a in range(0, self.n, SLICE):
            # a margin of one window on both sides shows every window that a position is in
            lo, hi = max(0, a - w), min(self.n, a + SLICE + w)
            key = (self._gram(slice(lo, hi)) >> np.uint64(32)).astype(np.uint32)
            if len(key) < w:
                continue
            lows = _running(key, w, np.minimum)
            padded = np.concatenate((np.zeros(w - 1, dtype=np.uint32), lows, np.zeros(w - 1, dtype=np.uint32)))
            best = _running(padded, w, np.maximum)
            at = np.flatnonzero(best == key) + lo
            found.append(at[(at >= a) & (at < a + SLICE)])
        at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        doc = np.searchsorted(self.ends, at, side="right")
        keep = (at + GRAM <= self.ends[doc]) & (self.sizes[doc] >= self.least) if len(at) else np.zeros(0, dtype=bool)
        self.at, self.doc = at[keep], doc[keep]
        self.gram = self.anchor_grams()

    # -- scan 1: grams
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct leading bits of the grams, and which several documents of the block have."""
        short = self.gram >> np.uint64(32 - self.bits)
        keys, self.of_gram = np.unique(short, return_inverse=True)
        return keys, _several(self.of_gram, self.rank[self.doc], len(keys))

    def use_grams(self, flags: np.ndarray) -> None:
        keep = flags[self.of_gram]
        self.at, self.doc, self.gram = self.at[keep], self.doc[keep], self.gram[keep]

    # -- scan 2: contexts
    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the distinct contexts, sorted."""
        left = np.maximum(self.at - (self.least - GRAM), self.begins[self.doc])
        right = np.minimum(self.at + self.least, self.ends[self.doc])
        h = mix((self.at - left).astype(np.uint64) * _K[3] + (right - self.at).astype(np.uint64))
        e = h.copy()
        for o in range(0, 2 * self.least - GRAM, 8):
            rest = np.clip(right - left - o, 0, 8)
            v = self.words[np.minimum(left + o, self.n)] & _MASK[rest]
            h = mix((h ^ v) * _K[0] + np.uint64(o))
            e = _other(e, v)
        keys, beside, self.of_context, at = _distinct(h, e)
        self.context_gram = self.gram[at]
        self.first_rank = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(self.first_rank, self.of_context, self.rank[self.doc])
        return keys, beside

    # -- scan 3: grams of the contexts that are new
    def open_grams(self, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct leading bits of these grams, and which have several of the block's new contexts."""
        self.settled = settled
        keys, self.of_new = np.unique(self.context_gram[~settled] >> np.uint64(32 - self.bits), return_inverse=True)
        return keys, np.bincount(self.of_new, minlength=len(keys)) > 1

    def use_contexts(self, flags: np.ndarray) -> None:
        """Marks the strings of settled anchors; keeps the positions of strings to look at one by one."""
        fine = np.zeros(len(self.settled), dtype=bool)
        fine[~self.settled] = flags[self.of_new]
        first = self.rank[self.doc] == self.first_rank[self.of_context]
        done = self.settled[self.of_context] | ~first
        self.starts = np.zeros(self.n + 1, dtype=bool)
        self.starts[self._strings(done)] = True
        self.look = self._strings(fine[self.of_context] & first)

    def _strings(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of the strings inside a document that hold a chosen anchor's gram."""
        at, doc = self.at[chosen], self.doc[chosen]
        low, high = np.maximum(at + GRAM - self.least, self.begins[doc]), np.minimum(at, self.ends[doc] - self.least)
        edges = np.zeros(self.n + 2, dtype=np.int32)
        ok = low <= high
        np.add.at(edges, low[ok], 1)
        np.add.at(edges, high[ok] + 1, -1)
        return np.flatnonzero(np.cumsum(edges) > 0)

    # -- scan 4: strings
    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the distinct strings to look at, sorted."""
        h = np.full(len(self.look), self.least, dtype=np.uint64)
        e = h.copy()
        for i, o in enumerate((*range(0, self.least - 7, 8), self.least - 8)):
            v = self.words[self.look + o]
            h = mix((h ^ v) * _K[i % 4] + np.uint64(i))
            e = _other(e, v)
        keys, beside, self.of_string, _ = _distinct(h, e)
        rank = self.rank[np.searchsorted(self.ends, self.look, side="right")]
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, self.of_string, rank)
        self.later = rank > least[self.of_string]
        return keys, beside

    def use_strings(self, seen: np.ndarray) -> None:
        self.starts[self.look[seen[self.of_string] | self.later]] = True

    def removed(self) -> np.ndarray:
        """Which bytes go."""
        at = np.flatnonzero(self.starts)
        edges = np.zeros(self.n + self.least + 1, dtype=np.int32)
        edges[at] += 1
        edges[at + self.least] -= 1
        return np.cumsum(edges)[: self.n] > 0


def _running(x: np.ndarray, w: int, f: Callable) -> np.ndarray:
    """f over each run of w values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def _other(e: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One step of the second hash."""
    e = (e + v) * _K[2]
    return e ^ (e >> np.uint64(29))


def _distinct(h: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of h and 32 bits of e in order of h; for each row its pair; for each pair one of its rows."""
    beside = (mix(e) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(h, kind="stable")
    keys, others = h[order], beside[order]
    if len(h) and np.any((keys[1:] == keys[:-1]) & (others[1:] != others[:-1])):
        order = np.lexsort((beside, h))
        keys, others = h[order], beside[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    of = np.empty(len(h), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return keys[new], others[new], of, order[new]


def _several(of: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, of, rank)
    np.maximum.at(high, of, rank)
    return low < high


def _u8(column: pa.ChunkedArray, i: int, dtype: str) -> np.ndarray:
    return np.frombuffer(column[i].as_py(), dtype=dtype)


def _split(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Edges of the buckets in sorted keys of ``width`` bits."""
    return np.searchsorted(keys >> np.uint64(width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


ENTRIES = "bucket int, block long, a binary, b binary"
FLAGS = "block long, scan int, bucket int, flags binary"


def _entries(block: int, bits: int, width: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    edges = _split(keys, bits, width)
    full = [i for i in range(1 << bits) if edges[i] < edges[i + 1]]
    cut = lambda x: pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary())
    return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "a": cut(a), "b": cut(b)})


def _gram_entries(row: pa.Table, bits: int, keys: np.ndarray, several: np.ndarray) -> pa.Table:
    return _entries(row.column("block")[0].as_py(), bits, bits + 32, keys, keys.astype("<u4"), several.astype(np.uint8))


def _pair_entries(row: pa.Table, bits: int, keys: np.ndarray, beside: np.ndarray) -> pa.Table:
    return _entries(row.column("block")[0].as_py(), bits, 64, keys, keys, beside)


def _reply(scan: int, bucket: int, blocks: list[int], flags: list[np.ndarray]) -> pa.Table:
    n = len(blocks)
    return pa.table({"block": pa.array(blocks, pa.int64()), "scan": pa.array([scan] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "flags": pa.array([f.astype(np.uint8).tobytes() for f in flags], pa.binary())})


def _in_order(rows: pa.Table) -> tuple[pa.Table, list[int], int]:
    rows = rows.sort_by("block")
    return rows, rows.column("block").to_pylist(), rows.column("bucket")[0].as_py()


def _scan_grams(rows: pa.Table, scan: int) -> pa.Table:
    """Which grams several blocks have, or one block several times."""
    rows, blocks, bucket = _in_order(rows)
    levels, hits = Levels(), []
    for i in range(len(blocks)):
        keys, several = _u8(rows.column("a"), i, "<u4"), _u8(rows.column("b"), i, "u1").astype(bool)
        seen = levels.seen(keys)
        levels.add(keys[~seen])
        hits.append(keys[seen | several])
    wanted = np.unique(np.concatenate(hits))
    return _reply(scan, bucket, blocks, [_among(_u8(rows.column("a"), i, "<u4"), wanted) for i in range(len(blocks))])


def _scan_earlier(rows: pa.Table, scan: int) -> pa.Table:
    """Which contexts or strings an earlier block has."""
    rows, blocks, bucket = _in_order(rows)
    levels, flags = Levels(), []
    for i in range(len(blocks)):
        keys, beside = _u8(rows.column("a"), i, "<u8"), _u8(rows.column("b"), i, "<u4")
        seen = levels.seen(keys, beside)
        levels.add(keys[~seen], beside[~seen])
        flags.append(seen)
    return _reply(scan, bucket, blocks, flags)


def _flags(rows: pa.Table, scan: int) -> np.ndarray:
    part = rows.filter(pa.compute.equal(rows.column("scan"), scan)).sort_by("bucket")
    return np.frombuffer(b"".join(part.column("flags").to_pylist()), dtype=np.uint8)


def _replayed(row: pa.Table, flags: pa.Table, upto: int, least: int, bits: int) -> Block:
    """A block brought to where the next scan's entries can be taken from it."""
    block = Block(_u8(row.column("ids"), 0, "<i8"), _u8(row.column("sizes"), 0, "<i8"), row.column("data")[0].as_py(), least, bits)
    gaps = _u8(row.column("anchors"), 0, "<u4")
    block.at = gaps.astype(np.int64)
    block.doc = np.searchsorted(block.ends, block.at, side="right")
    block.gram = block.anchor_grams()
    block.grams()
    if upto >= 1:
        block.use_grams(_flags(flags, 1).astype(bool))
        block.entries = block.contexts()
    if upto >= 2:
        block.entries = block.open_grams(_flags(flags, 2).astype(bool))
    if upto >= 3:
        block.use_contexts(_flags(flags, 3).astype(bool))
        block.entries = block.strings()
    if upto >= 4:
        block.use_strings(_flags(flags, 4).astype(bool))
    return block


def _blocks(least: int, columns: list[str], block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (doc_id, text, part, other columns) as blocks that end where doc_id changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            rows = pa.Table.from_batches(held)
            texts = [t.encode() for t in rows.column("text").to_pylist()]
            ids, sizes = np.asarray(rows.column("doc_id")), np.array([len(t) for t in texts], dtype=np.int64)
            data = b"".join(texts)
            block = Block(ids, sizes, data, least, 0)
            block.anchors()
            sink = pa.BufferOutputStream()
            rest = rows.select(columns)
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest)
            number = (rows.column("part")[0].as_py() << 24) + seq
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([sizes.astype("<i8").tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([block.at.astype("<u4").tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([len(data)])],
                names=["block", "ids", "sizes", "data", "anchors", "rest", "n_bytes"],
            )

        last = None
        for batch in batches:
            ids = np.asarray(batch.column(0))
            sizes = np.asarray(pa.compute.binary_length(batch.column(1)), dtype=np.int64)
            begin = 0
            for i in range(len(ids)):
                if size >= block_bytes and ids[i] != last:
                    if begin < i:
                        held.append(batch.slice(begin, i - begin))
                    yield flush()
                    held, size, begin = [], 0, i
                size += int(sizes[i])
                last = ids[i]
            if begin < len(ids):
                held.append(batch.slice(begin))
        if held:
            yield flush()

    return run


def remove_repeats(docs: DataFrame, *, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``kept string, n_bytes, n_removed, n_spans long, kept_sha256 string``.

    ``kept`` is the text without its removed bytes; a character of several bytes that is
    removed in part stays whole in ``kept`` (``kept_sha256`` is of the exact bytes).  Null text is
    an empty text.  Rows with equal doc_id don't remove from one another; a row without
    doc_id has no place in the order and stays whole.  All other columns come through
    (those named like an output column are replaced); an empty table gives no rows.
    """
    if least < GRAM + 8:
        raise ValueError(f"strings of at least {GRAM + 8} bytes")
    spark = docs.sparkSession
    made = [T.StructField("kept", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    docs = docs.drop(*(f.name for f in made)).withColumn("doc_id", F.col("doc_id").cast("long"))
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *made])
    others = [c for c in columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    rows = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"), F.col("text").isNull().alias("no_text"), rest.alias("rest"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id().cast("long"))
    blocks = ordered.mapInArrow(_blocks(least, ["no_text", "rest"], block_bytes), "block long, ids binary, sizes binary, data binary, anchors binary, rest binary, n_bytes long")
    name = f"blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(parts, "block").option("compression", "zstd").saveAsTable(name)
    try:
        stored = spark.table(name)
        total = stored.agg(F.sum("n_bytes")).first()[0] or 0
        bits = max(4, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))
        flags = spark.createDataFrame([], FLAGS)
        wide = lambda x: x.select("block", "ids", "sizes", "data", "anchors")

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = pa.Table.from_batches([batch.slice(i, 1)])
                    b = Block(_u8(row.column("ids"), 0, "<i8"), _u8(row.column("sizes"), 0, "<i8"), row.column("data")[0].as_py(), least, bits)
                    b.at = _u8(row.column("anchors"), 0, "<u4").astype(np.int64)
                    b.doc = np.searchsorted(b.ends, b.at, side="right")
                    b.gram = b.anchor_grams()
                    keys, several = b.grams()
                    yield from _gram_entries(row, bits, keys, several).to_batches()

        def contexts(row: pa.Table, found: pa.Table) -> pa.Table:
            return _pair_entries(row, bits, *_replayed(row, found, 1, least, bits).entries)

        def open_grams(row: pa.Table, found: pa.Table) -> pa.Table:
            return _gram_entries(row, bits, *_replayed(row, found, 2, least, bits).entries)

        def strings(row: pa.Table, found: pa.Table) -> pa.Table:
            return _pair_entries(row, bits, *_replayed(row, found, 3, least, bits).entries)

        def beside(f: Callable, kinds: str | T.StructType, left: DataFrame) -> DataFrame:
            return left.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(f, kinds)

        one = wide(stored).mapInArrow(first, ENTRIES)
        flags = saved(one.groupBy("bucket").applyInArrow(lambda rows: _scan_grams(rows, 1), FLAGS), "flags")
        two = beside(contexts, ENTRIES, wide(stored))
        flags = flags.union(saved(two.groupBy("bucket").applyInArrow(lambda rows: _scan_earlier(rows, 2), FLAGS), "flags"))
        three = beside(open_grams, ENTRIES, wide(stored))
        flags = flags.union(saved(three.groupBy("bucket").applyInArrow(lambda rows: _scan_grams(rows, 3), FLAGS), "flags"))
        four = beside(strings, ENTRIES, wide(stored))
        flags = flags.union(saved(four.groupBy("bucket").applyInArrow(lambda rows: _scan_earlier(rows, 4), FLAGS), "flags"))

        def last(row: pa.Table, found: pa.Table) -> pa.Table:
            return _results(row, _replayed(row, found, 4, least, bits), columns, others)

        out = saved(beside(last, schema, stored.select("block", "ids", "sizes", "data", "anchors", "rest")), "kept")
    finally:
        spark.sql(f"drop table if exists {name}")
    text = text_or_empty()
    loose = docs.where("doc_id is null").select("*", text.alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return out.union(loose)


def _results(row: pa.Table, block: Block, columns: list[str], others: list[str]) -> pa.Table:
    rest = pa.ipc.open_stream(row.column("rest")[0].as_py()).read_all()
    gone = block.removed()
    raw = block.data[: block.n]
    # whole characters only: a character stays in the text if one of its bytes stays
    inner = (raw & 0xC0) == 0x80
    char = np.cumsum(~inner) - 1
    stays = np.zeros(int(char[-1]) + 1 if block.n else 0, dtype=bool)
    stays[char[~gone]] = True
    whole = stays[char] if block.n else stays
    edges = np.concatenate(([False], gone)).astype(np.int8)
    rises = np.diff(edges) > 0
    texts, kept, sizes, spans, sums = [], [], [], [], []
    no_text = rest.column("no_text").to_pylist()
    for a, b, null in zip(block.begins.tolist(), block.ends.tolist(), no_text, strict=True):
        part, out = raw[a:b], gone[a:b]
        text = part.tobytes()
        texts.append(None if null else text.decode())
        if not out.any():
            kept.append(text.decode())
            sizes.append(0)
            spans.append(0)
            sums.append(hashlib.sha256(text).hexdigest())
            continue
        kept.append(part[whole[a:b]].tobytes().decode())
        sizes.append(int(out.sum()))
        spans.append(int(rises[a + 1 : b].sum()) + int(out[0]))
        sums.append(hashlib.sha256(part[~out].tobytes()).hexdigest())
    inner_rest = rest.column("rest").combine_chunks()
    if isinstance(inner_rest, pa.ChunkedArray):
        inner_rest = inner_rest.chunk(0)
    data = {"doc_id": pa.array(block.ids), "text": pa.array(texts, pa.string())} | {c: inner_rest.field(c) for c in others}
    out = {c: data[c] for c in columns} | {"kept": pa.array(kept, pa.string()), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(sizes, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
    return pa.table(out)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
