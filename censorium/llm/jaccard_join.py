"""Exact Jaccard join of word-shingle sets, by components.

Plan (no step sees all pairs of a group, and nothing is capped):

1. Equal sets become one class with one representative, so copies cost nothing further.
2. Documents lie in blocks in a table bucketed by block.  Each block sends every shingle once
   (40 bits, in sorted arrays by bucket) and gets back how many classes have it, as a level.
3. Shingles are ordered by that level, unique ones first.  By the prefix principle two sets of
   similarity t share one of their first n - ceil(t n) + 1 shingles in that order, so only those
   are indexed, and of these only what several classes have.  A set with too many shingles
   of its own is similar to none.  Lists are divided by set size.
4. Each list has a head, its smallest set, and its sets are first compared with that alone (of a
   long list, also with some sets drawn by hash).  The answers, overlaps included, are kept.
5. What answers say of highly similar sets skips work.  A list whose sets are all in one component
   is done, and no pair inside a component is compared.  For two sets of a list, their answers from the
   head bound their overlap: |a & b| <= |p & b| + |a - p|; a pair that this rules out isn't compared, and
   no pair is compared twice.
6. Long lists that are still open are cut into blocks of like size and position (how many shingles a set has
   from this one on); pairs of blocks are skipped whole where both bounds rule out every pair.
7. A candidate must pass the size filter and, as every list is tried as the first that two sets
   have in common, a filter by position: both need enough shingles from that one on.  Then a bound from the 64 smallest hashes of both sets (exact: they can't differ more
   than the whole sets may), then whole sets decide.  Sets lie in a table bucketed by class, so rounds shuffle pairs, not sets.

Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.llm.common import discard, saved, table, text_or_empty
from censorium.llm.components import components
from censorium.llm.shingles import WORDS, mix, shingle_sets

PERCENT = 80
#: Text bytes of a block and of a bucket's share.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Classes that have a shingle above which its list isn't gathered in one task.
FREQUENT = 1 << 15
#: Longest list that is one block; sets of a longer list that are compared with the rest in the first round.
BLOCK, PIVOTS = 256, 64
#: Sets of a longer list that one task compares with the rest of it.
PART = 4096
#: Smallest hashes that go ahead of a whole set.
LOW = 64

BLOCKS = "block long, ids array<long>, n array<int>, classes array<long>, texts array<string>, n_bytes long"


def _class_of(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)))))


def _stored(words: int):
    """Rows (doc_id, text) as blocks, with sizes and classes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part = 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            sizes = np.asarray(pa.compute.binary_length(batch.column(1)), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                sets = [(len(x), _class_of(x) if len(x) else None) for x in shingle_sets(texts, words)]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + seq]), one(ids), one(pa.array([x[0] for x in sets], pa.int32())), one(pa.array([x[1] for x in sets], pa.int64())), one(texts), pa.array([int(sizes[a:b].sum())])],
                    names=["block", "ids", "n", "classes", "texts", "n_bytes"],
                )
                seq += 1

    return run


def _block_sets(texts: pa.Array, at: list[int], words: int) -> list[np.ndarray]:
    """Sets of the representatives of a block."""
    return list(shingle_sets(texts.take(pa.array(at)), words))


def _keys(sets: list[np.ndarray], bits: int) -> np.ndarray:
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return flat >> np.uint64(32 - bits)


def _packed(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


ENTRIES = "bucket int, block long, keys binary, counts binary"
LEVELS = "block long, bucket int, levels binary"


def _sent(words: int, bits: int):
    """Each block's distinct keys and in how many of its classes they are, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = np.unique(_keys(_block_sets(batch.column(1)[i].values, batch.column(2)[i].as_py(), words), bits), return_counts=True)
                edges = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
                full = [j for j in range(1 << bits) if edges[j] < edges[j + 1]]
                parts = [slice(edges[j], edges[j + 1]) for j in full]
                low, few = keys.astype("<u4"), np.minimum(counts, 65535).astype("<u2")
                # sorted keys as their differences
                gaps, few = pa.array([_packed(np.diff(low[x], prepend=np.uint32(0))) for x in parts], pa.binary()), pa.array([_packed(few[x]) for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(full), pa.int64()), gaps, few], names=["bucket", "block", "keys", "counts"])

    return run


def _levels(rows: pa.Table) -> pa.Table:
    """For every block the level of each of its keys: 0 for one class, else 1 + log2 of their number."""
    keys = [np.cumsum(_unpacked(x.as_py(), "<u4"), dtype=np.uint32) for x in rows.column("keys")]
    counts = [_unpacked(x.as_py(), "<u2") for x in rows.column("counts")]
    flat, weight = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
    sums = np.add.reduceat(weight[order], np.flatnonzero(new))
    level = np.empty(len(flat), dtype=np.uint8)
    level[order] = np.where(sums == 1, 0, 1 + np.log2(sums)).astype(np.uint8)[np.cumsum(new) - 1]
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "levels": pa.array([_packed(level[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)], pa.binary())})


def _prefixes(percent: int, words: int, bits: int):
    """Index entries (list, class, n, shared, frequent) of a block's representatives.

    ``shared``: how many shingles the set has from this one on, in the common order.
    """
    often = 1 + int(math.log2(FREQUENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column(2)[i].as_py()
                sets = _block_sets(batch.column(1)[i].values, at, words)
                keys, of = np.unique(_keys(sets, bits), return_inverse=True)
                reply = sorted(batch.column(4)[i].as_py() or [], key=lambda x: x["bucket"])
                level = np.concatenate([_unpacked(x["levels"], "u1") for x in reply])[of] if len(keys) else np.zeros(0, dtype=np.uint8)
                classes = batch.column(3)[i].as_py()
                ends = np.cumsum([len(x) for x in sets])
                out = []
                for c, x, e in zip((classes[j] for j in at), sets, ends, strict=True):
                    n, lev = len(x), level[e - len(x) : e]
                    spare, own = n - (percent * n + 99) // 100, int((lev == 0).sum())
                    if own > spare:
                        continue
                    order = np.argsort(lev, kind="stable")[own : spare + 1]
                    size = int(math.log(n) / math.log(100 / percent) + 1e-9)
                    for k in (size, size - 1):
                        out.append((mix(x[order] + np.uint64((k + 2) * 0x9E3779B97F4A7C15 % 2**64)), c, n, n - own - np.arange(len(order)), lev[order] > often))
                counts = [len(x[0]) for x in out]
                join = lambda j, kind: np.concatenate([x[j] for x in out]) if out else np.zeros(0, dtype=kind)
                many = lambda j, kind: np.repeat(np.array([x[j] for x in out], dtype=kind), counts)
                yield pa.RecordBatch.from_arrays([pa.array(join(0, np.uint64).view(np.int64)), pa.array(many(1, np.int64)), pa.array(many(2, np.int32)), pa.array(join(3, np.int64).astype(np.int32)), pa.array(join(4, bool))], names=["token", "class", "n", "shared", "frequent"])

    return run


def _shared(percent: int):
    """Of a task's rare tokens the lists of several classes, each (token, class) once, with size and head of the list.

    The head is the smallest set.  A set that has too little from this shingle on for even that one leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(i)) for i in range(4)] for b in batches if b.num_rows]
        if not parts:
            return
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((rows[1], rows[2], rows[0]))
        token, cls, n, own = (x[order] for x in rows)
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
        token, cls, n, own = token[new], cls[new], n[new], own[new]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(first, len(token)))
        head = np.repeat(first, size)
        size = np.repeat(size, size).astype(np.int64)
        keep = np.flatnonzero((size > 1) & ((100 + percent) * own.astype(np.int64) >= percent * (n.astype(np.int64) + n[head])))
        for a in range(0, len(keep), 50_000):
            k = keep[a : a + 50_000]
            h = head[k]
            cols = (token[k], cls[k], n[k], own[k], size[k], cls[h], n[h], own[h])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "class", "n", "shared", "size", "head", "head_n", "head_s"])

    return run


LISTS = "token long, class long, n int, shared int, size long, head long, head_n int, head_s int"


def index_lists(entries: DataFrame, percent: int) -> DataFrame:
    """LISTS of the tokens that several classes have.

    Lists of rare tokens are gathered by token: they are at most FREQUENT long.  Entries of
    frequent tokens meet only in aggregates and joins, which Spark may split.
    """
    entries = saved(entries, "entries")
    rare = entries.where("not frequent").drop("frequent").repartition("token").mapInArrow(_shared(percent), LISTS)
    often = entries.where("frequent").drop("frequent").dropDuplicates(["token", "class"])
    heads = often.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("n", "class", "shared")).alias("_h")).where("size > 1")
    able = (100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("_h.n"))
    long = often.join(heads, "token").where(able).select("token", "class", "n", "shared", "size", F.col("_h.class").alias("head"), F.col("_h.n").alias("head_n"), F.col("_h.shared").alias("head_s"))
    lists = saved(rare.union(long), "index")
    discard(entries)
    return lists


def class_sets(blocks: DataFrame, wanted: DataFrame, words: int, name: str) -> DataFrame:
    """``(class, n, low, hashes)`` of the wanted classes, as a table bucketed by class, from the blocks of their representatives.

    The classes' ids stay on Spark: they are joined as rows, and blocks get the places of their own.
    """
    places = blocks.select("block", "classes", F.explode("at").alias("_at")).select("block", "_at", F.col("classes")[F.col("_at")].alias("class"))
    here = saved(places.join(wanted, "class", "left_semi").groupBy("block").agg(F.sort_array(F.collect_list("_at")).alias("at")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                classes, at = batch.column(3)[i].as_py(), batch.column(2)[i].as_py()
                out = [(classes[j], len(x), x[:LOW].tobytes(), x.tobytes()) for j, x in zip(at, _block_sets(batch.column(1)[i].values, at, words), strict=True)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["class", "n", "low", "hashes"])

    rows = blocks.drop("at").join(here, "block").select("block", "texts", "at", "classes")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by class here, none in the rounds that follow
    rows.mapInArrow(run, "class long, n int, low binary, hashes binary").repartition(parts, "class").write.bucketBy(parts, "class").saveAsTable(name)
    discard(here)
    return blocks.sparkSession.table(name)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The answers to ``pairs(a, b)``: ``(a, b, both, linked)``; ``both``, the shared shingles, is null if a bound sufficed to say no."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, la, lb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(la, dtype=np.uint64), np.frombuffer(lb, dtype=np.uint64)
                # up to here both lists are whole; a list with all of its set has no end
                top = min([np.uint64(2**64 - 1), *(v[-1] for v, n in ((x, na), (y, nb)) if len(v) < n)])
                x, y = x[x <= top], y[y <= top]
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                least = -(-percent * (na + nb) // (100 + percent))  # overlap that the similarity needs
                keep.append(apart <= na + nb - 2 * least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "fine"])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked = [], []
            for xa, xb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(xa, dtype=np.uint64), np.frombuffer(xb, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])

    def beside(df: DataFrame, side: str, column: str) -> DataFrame:
        return df.join(sets.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"{column}_{side}")), side)

    # written first, so that the size of the pairs is known before sets are joined to them
    asked = saved(pairs, "pairs")
    low = beside(beside(asked, "b", "low"), "a", "low").select("a", "b", "n_a", "n_b", "low_a", "low_b")
    tried = saved(low.mapInArrow(possible, "a long, b long, fine boolean"), "tried")
    whole = beside(beside(tried.where("fine").select("a", "b"), "b", "hashes"), "a", "hashes").select("a", "b", "hashes_a", "hashes_b")
    no = tried.where("not fine").select("a", "b", F.lit(None).cast("int").alias("both"), F.lit(False).alias("linked"))
    answers = saved(whole.mapInArrow(decided, "a long, b long, both int, linked boolean").union(no), "answers")
    discard(asked, tried)
    return answers


def _possible(percent: int, a: str, b: str) -> F.Column:
    """Sizes of two sets, and what both have from this shingle on, allow the similarity if they share no earlier one."""
    return (100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")) & ((100 + percent) * F.least(f"{a}s", f"{b}s") >= percent * (F.col(f"{a}n") + F.col(f"{b}n")))


def _derived(percent: int) -> F.Column:
    """Whether the answers of the list's head p leave the pair open: |a & b| <= |p & b| + |a - p|, and the other way round."""
    most = F.least(F.col("bp") + F.col("an") - F.col("ao"), F.col("ap") + F.col("bn") - F.col("bo"))
    return (100 + percent) * most >= percent * (F.col("an") + F.col("bn"))


def _side(rows: DataFrame, x: str, *more) -> DataFrame:
    return rows.select("token", *more, F.col("class").alias(x), F.col("n").alias(f"{x}n"), F.col("shared").alias(f"{x}s"), F.col("root").alias(f"{x}r"), F.col("least").alias(f"{x}o"), F.col("most").alias(f"{x}p"))


def _stars(long: DataFrame, turn: int, apart: F.Column) -> DataFrame:
    """Pairs of the sets of long lists that are drawn by hash with the rest of their list, in parts of at most about PART sets."""
    parts = F.ceil(F.col("size") * _share(turn) / PART).cast("int")
    heading = _side(long.where("pivot"), "a", F.pmod(F.xxhash64("class"), parts).cast("int").alias("part"))
    others = _side(long, "b", "pivot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    once = F.when(F.col("pivot"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    return heading.join(others, ["token", "part"]).where(once & apart).select("a", "b")


def _share(turn: int) -> F.Column:
    """Share of a long list that is compared with the rest: few at first, then a quarter."""
    return F.greatest(F.lit(PIVOTS), F.col("size") / 4 if turn else F.lit(0)) / F.col("size")


def _block_pairs(long: DataFrame, percent: int, apart: F.Column) -> DataFrame:
    """Pairs inside long lists, by blocks of like size and position; pairs of blocks whose bounds rule out every pair are skipped whole."""
    rows = long.withColumns({"bn": F.floor(F.log("n") * 20).cast("int"), "bs": F.floor(F.log("shared") * 10).cast("int")})
    blocks = rows.groupBy("token", "bn", "bs").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("shared").alias("top"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    blocks = saved(blocks, "blocks")
    x, y = ((blocks.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("bn", "bs", "lo", "hi", "top", "parts")))) for s in "xy")
    sizes = (100 * F.col("x_hi") >= percent * F.col("y_lo")) & (100 * F.col("y_hi") >= percent * F.col("x_lo"))
    position = (100 + percent) * F.least("x_top", "y_top") >= percent * (F.col("x_lo") + F.col("y_lo"))
    ordered = F.struct("x_bn", "x_bs") <= F.struct("y_bn", "y_bs")
    met = x.join(y, "token").where(sizes & position & ordered)
    met = met.withColumn("x_part", F.explode(F.sequence(F.lit(0), F.col("x_parts") - 1))).withColumn("y_part", F.explode(F.sequence(F.lit(0), F.col("y_parts") - 1)))
    met = saved(met.select("token", *(f"{s}_{c}" for s in "xy" for c in ("bn", "bs", "part"))).withColumn("meeting", F.monotonically_increasing_id()), "meetings")
    placed = rows.join(blocks.select("token", "bn", "bs", "parts"), ["token", "bn", "bs"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    beside = lambda s: met.select("token", *(F.col(f"{s}_{c}").alias(c) for c in ("bn", "bs", "part")), "meeting", (F.struct("x_bn", "x_bs") == F.struct("y_bn", "y_bs")).alias("_block"))
    here = {s: placed.join(beside(s), ["token", "bn", "bs", "part"]) for s in "xy"}
    # two parts of one block meet in both orders, so there the smaller class goes first
    once = ~F.col("_block") | (F.col("a") < F.col("b"))
    return _side(here["x"], "a", "meeting", "_block").join(_side(here["y"], "b", "meeting").drop("token"), "meeting").where(once & apart).select("a", "b")


def linked_classes(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``(class, root)`` of every class that is linked with a smaller one; None without links.

    Round 0 compares each list's sets with its head, and long lists with sets drawn by hash.  What is then still
    in several components is compared inside its list: short lists at once, long ones
    with a quarter of theirs in round 1 and by blocks in round 2.
    """
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots: DataFrame | None = None
    answers: DataFrame | None = None
    stored, lists = lists, lists.withColumns({"least": F.lit(0), "most": F.col("head_n")})
    for turn in range(3):
        rows = lists.withColumn("root", F.col("class")) if roots is None else lists.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        if roots is not None:
            several = rows.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high").select("token")
            rows = rows.join(several, "token", "left_semi")
        drawn = F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(1 << 32)) < _share(turn) * (1 << 32)
        rows = rows.withColumn("pivot", ((F.col("size") > BLOCK) & drawn) | (F.col("class") == F.col("head")) & F.lit(turn == 0))
        opened = rows if turn == 0 else saved(rows, "open")
        short, long = opened.where(F.col("size") <= BLOCK), opened.where(F.col("size") > BLOCK)
        apart = (F.col("ar") != F.col("br")) & _possible(percent, "a", "b") & _derived(percent)
        if turn == 0:
            near = (100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")) & ((100 + percent) * F.least("shared", "head_s") >= percent * (F.col("n") + F.col("head_n")))
            pairs = lists.where((F.col("class") != F.col("head")) & near).select(F.col("head").alias("a"), F.col("class").alias("b")).union(_stars(long, turn, apart))
        elif turn == 1:
            inside = _side(short, "a").join(_side(short, "b"), "token").where((F.col("a") < F.col("b")) & apart).select("a", "b")
            pairs = inside.union(_stars(long, turn, apart))
        else:
            pairs = _block_pairs(long, percent, apart)
        pairs = pairs.select(*ordered).distinct()
        if answers is not None:
            pairs = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
        found = verified(pairs, sets, percent)
        answers = found if answers is None else answers.union(found)
        links = answers.where("linked").select("a", "b")
        if not found.where("linked").isEmpty():
            old, roots = roots, saved(components(links).withColumnRenamed("node", "class"), "roots")
            discard(old)
        left = opened.where("not pivot") if turn == 0 else long.where("not pivot")
        if turn == 0:
            # what the head's answer says of each set: its overlap with the head, or a bound
            of_head = found.select("a", "b", "both", "linked")
            key = {"a": F.least("head", "class"), "b": F.greatest("head", "class")}
            need = F.ceil(percent * (F.col("n") + F.col("head_n")) / (100.0 + percent)).cast("int")
            known = left.drop("least", "most", "root", "pivot").withColumns(key).join(of_head, ["a", "b"], "left")
            # a pair with the head that wasn't asked in this list may have been met in another: nothing is known of it
            most = F.coalesce("both", F.when(F.col("linked").isNotNull(), need - 1).otherwise(F.least("n", "head_n")))
            left = known.withColumns({"least": F.coalesce("both", F.lit(0)), "most": most}).drop("a", "b", "both", "linked")
        else:
            left = left.drop("root", "pivot")
        before, stored = stored, saved(left, "lists")
        discard(before, opened)
        lists = stored
        if lists.isEmpty():
            break
    discard(stored)
    return roots


def similar_components(docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs(doc_id, text)``.

    Rows link when 100 * intersection >= percent * union of their shingle sets; a component is
    named by its smallest doc_id.  Null or wordless texts have empty sets and link with
    nothing.  Rows with equal doc_id stay separate rows; a null doc_id never names a component
    unless nothing else can.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    name, hashes = f"sets_{uuid.uuid4().hex}", f"hashes_{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    texts.mapInArrow(_stored(words), BLOCKS).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("compression", "zstd").saveAsTable(name)
    try:
        stored = spark.table(name)
        total = stored.agg(F.sum("n_bytes")).first()[0] or 0
        bits = max(4, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))
        placed = stored.select("block", F.posexplode(F.arrays_zip("ids", "n", "classes")).alias("at", "x")).select("block", "at", "x.*")
        first = placed.where("classes is not null").groupBy("classes").agg(F.min(F.struct("block", "at")).alias("x"))
        reps = saved(first.groupBy("x.block").agg(F.sort_array(F.collect_list("x.at")).alias("at")), "representatives")
        blocks = stored.select("block", "texts", "classes").join(reps, "block").select("block", "texts", "at", "classes")
        levels = saved(blocks.select("block", "texts", "at").mapInArrow(_sent(words, bits), ENTRIES).groupBy("bucket").applyInArrow(_levels, LEVELS), "levels")
        replies = levels.groupBy("block").agg(F.collect_list(F.struct("bucket", "levels")).alias("reply"))
        entries = blocks.join(replies, "block").select("block", "texts", "at", "classes", "reply").mapInArrow(_prefixes(percent, words, bits), "token long, class long, n int, shared int, frequent boolean")
        lists = index_lists(entries, percent)
        discard(levels)
        sets = class_sets(blocks, lists.select("class").distinct(), words, hashes)
        discard(reps)
        roots = linked_classes(lists, sets, percent)
        rows = saved(placed.select(F.col("ids").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("classes").alias("class")), "sets")
    finally:
        spark.sql(f"drop table if exists {name}")
        spark.sql(f"drop table if exists {hashes}")
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    if roots is None:
        named = least.select("class", F.col("least").alias("component_id"))
    else:
        of = least.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        named = of.select("class", "root").join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id")
    # classes of many rows: their rows are few longs each, and AQE splits a class that is frequent
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents."""
    return similar_components(table(spark, sf_dir, "documents"))


#: The same by counting shared shingles of all pairs that share one.
OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
), e as (select doc_id, unnest(s) as x from s
), c as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all
), l as (select a, b from c join s p on p.doc_id = a join s q on q.doc_id = b where 100 * c >= 80 * (len(p.s) + len(q.s) - c)
), u as (select a, b from l union all select b, a from l
), r(doc_id, reach) as (select doc_id, doc_id from s union select r.doc_id, u.b from r join u on u.a = r.reach)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.reach) as component_id from s join r on r.doc_id = s.doc_id group by all
"""
