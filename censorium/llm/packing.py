"""Vector bin packing of token pieces into training sequences.

A piece is a vector: tokens, one segment, loss-bearing tokens.  A sequence has a limit
on each.  The dot-product heuristic fills one sequence at a time: of the pieces that
fit, take the one whose vector has the largest dot product with what is left, each
dimension measured in shares of its limit.  Where cutting is allowed, a piece that
doesn't fit whole gives as many tokens as fit; its rest goes back to the pool.

Every Spark task packs its own rows and holds one block of pieces plus the open rest,
so there is no shuffle and memory is bounded; a sequence never spans two tasks.  What
remains at the end of a task is closed in lengths that are powers of two, which such
formats accept unpadded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.llm.common import table, text_or_empty
from censorium.llm.tokens import encode_lists, pretokens, with_end

END_ID = 1
#: Pieces packed together; the pool of a task never holds many more.
BLOCK_PIECES = 4_096
#: Task number in the upper bits of a sequence_id, count in the task below.
TASK_SHIFT = 36


@dataclass
class Piece:
    """Tokens ``start .. start + length`` of a row; ``loss`` is cumulative over the row's tokens or None (all bear loss)."""

    key: object
    ids: np.ndarray
    start: int
    length: int
    total: int
    loss: np.ndarray | None = None

    def loss_of(self, length: int) -> int:
        return length if self.loss is None else int(self.loss[self.start + length] - self.loss[self.start])

    def most(self, tokens: int, loss: int) -> int:
        """Tokens of the longest prefix within both limits."""
        n = min(self.length, tokens)
        if self.loss is None:
            return min(n, loss)
        return int(np.searchsorted(self.loss[self.start : self.start + n + 1], self.loss[self.start] + loss, side="right")) - 1

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a = Piece(self.key, self.ids, self.start, n, self.total, self.loss)
        return a, Piece(self.key, self.ids, self.start + n, self.length - n, self.total, self.loss)


class Packer:
    """Fills sequences from a pool of pieces by the dot-product heuristic."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool) -> None:
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits are at least 1")
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.max_tokens, self.max_segments, self.max_loss, self.cut = max_tokens, max_segments, max_loss, cut
        self.pool: dict[tuple[int, int], list[Piece]] = defaultdict(list)
        self.tokens = self.count = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Put a piece in the pool; what alone fills sequences comes out at once."""
        while self.cut and (n := piece.most(self.max_tokens, self.max_loss)) < piece.length or piece.length == self.max_tokens:
            n = piece.most(self.max_tokens, self.max_loss)
            if n < 1:
                raise ValueError("a token bears more loss than a sequence may hold")
            head, piece = piece.cut(n)
            yield [head]
            if not piece.length:
                return
        if not self.cut and (piece.length > self.max_tokens or piece.loss_of(piece.length) > self.max_loss):
            raise ValueError(f"{piece.key}: longer than a sequence; allow cutting")
        if piece.length:
            self._put(piece)

    def _put(self, piece: Piece) -> None:
        self.pool[piece.length, piece.loss_of(piece.length)].append(piece)
        self.tokens += piece.length
        self.count += 1

    def _take(self, vector: tuple[int, int]) -> Piece:
        pieces = self.pool[vector]
        piece = pieces.pop()
        if not pieces:
            del self.pool[vector]
        self.tokens -= piece.length
        self.count -= 1
        return piece

    def sequences(self, last: bool) -> Iterator[list[Piece]]:
        """Full sequences while the pool can fill them; with ``last``, all that is left."""
        while self.pool and (last or self.tokens >= 2 * self.max_tokens and self.count >= 2):
            yield self._fill(last)

    def _fill(self, last: bool) -> list[Piece]:
        left, out = self.limits.copy(), []
        while self.pool and left.min() >= 1:
            vectors = np.array([(t, 1, v) for t, v in self.pool], dtype=np.float64)
            fit = (vectors <= left).all(axis=1)
            if fit.any():
                scores = np.where(fit, (vectors / self.limits) @ (left / self.limits), -1)
                t, _, v = vectors[int(np.argmax(scores))]
                piece = self._take((int(t), int(v)))
            elif self.cut:
                whole = self._take(max(self.pool))
                n = whole.most(int(left[0]), int(left[2]))
                if n < 1:
                    self._put(whole)
                    break
                piece, rest = whole.cut(n)
                if rest.length:
                    self._put(rest)
            else:
                break
            out.append(piece)
            left -= (piece.length, 1, piece.loss_of(piece.length))
        if self.cut and left[0] >= 1:
            out = self._to_power_of_two(out)
        return out

    def _to_power_of_two(self, pieces: list[Piece]) -> list[Piece]:
        """Give back the tokens above the largest power of two, so that no padding is due."""
        keep, out = 1 << (sum(p.length for p in pieces).bit_length() - 1), []
        for p in pieces:
            if keep >= p.length:
                out.append(p)
            elif keep > 0:
                head, rest = p.cut(keep)
                out.append(head)
                self._put(rest)
            else:
                self._put(p)
            keep = max(0, keep - p.length)
        return out


FIELDS = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]


def _rows(packs: Iterator[list[Piece]], base: int, key: str, with_ids: bool, at: list[int]) -> Iterator[pa.RecordBatch]:
    cols: dict[str, list] = {k: [] for k in [key, *(f for f, _ in FIELDS), "ids"]}
    for pieces in packs:
        offset = 0
        for p in pieces:
            ids = p.ids[p.start : p.start + p.length]
            for k, v in zip(cols, (p.key, p.start, p.length, zlib.crc32(ids), p.total, base + at[0], offset, ids if with_ids else None), strict=True):
                cols[k].append(v)
            offset += p.length
        at[0] += 1
    if cols[key]:
        names = list(cols)[: None if with_ids else -1]
        kinds = [None, *[pa.int64()] * len(FIELDS), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([int(x) if k == key and x is not None else x for x in cols[k]], pa.int64() if k == key else t) for k, t in zip(names, kinds, strict=False)], names=names)


def _pack(pieces: Iterator[Piece | None], packer: Packer, key: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """A None among the pieces asks for what can be packed so far."""
    base, at, pending = TaskContext.get().partitionId() << TASK_SHIFT, [0], []
    for piece in pieces:
        if piece is not None:
            pending += packer.add(piece)
        if piece is None or packer.count >= BLOCK_PIECES:
            pending += packer.sequences(last=False)
        if len(pending) >= 500:
            yield from _rows(iter(pending), base, key, with_ids, at)
            pending = []
    yield from _rows(iter(pending), base, key, with_ids, at)
    yield from _rows(packer.sequences(last=True), base, key, with_ids, at)


def pack_tokens(df: DataFrame, *, id_col: str, ids_col: str = "ids", loss_col: str | None = None, max_tokens: int = 2048, max_segments: int = 1024, max_loss: int | None = None, cut: bool = True, with_ids: bool = True) -> DataFrame:
    """Pack rows of ``ids_col array<int>`` under limits on tokens, segments and loss-bearing tokens.

    ``loss_col`` is an ``array<int>`` of 0/1 beside the ids (None: every token bears loss).
    One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and ``ids``.  Rows with null or empty ids give no piece; equal ids are separate rows.
    Without ``cut`` a row over a limit is an error.  An empty table gives no rows.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens, cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece | None]:
            for batch in batches:
                lists, marks = batch.column(1), batch.column(2) if loss_col else None
                flat, sizes = np.asarray(lists.flatten()).astype("<u4"), np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
                first = np.concatenate(([0], np.cumsum(sizes)))
                for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True)):
                    if n:
                        loss = None if marks is None else np.concatenate(([0], np.cumsum(np.asarray(marks[i].as_py(), dtype=np.int64))))
                        if loss is not None and len(loss) != n + 1:
                            raise ValueError(f"{key}: {len(loss) - 1} loss marks for {n} ids")
                        yield Piece(key, flat[first[i] : first[i + 1]].copy(), 0, n, n, loss)
                yield None

        yield from _pack(pieces(), Packer(*limits), id_col, with_ids)

    kinds = ", ".join(f"{k} {t}" for k, t in FIELDS) + (", ids array<int>" if with_ids else "")
    return df.select(id_col, ids_col, *([loss_col] if loss_col else [])).mapInArrow(run, f"`{id_col}` long, {kinds}")


def pack_documents(docs: DataFrame, *, tokenizer: str, end_id: int | None = END_ID, max_tokens: int = 2048, max_segments: int = 1024, max_loss: int | None = None, with_ids: bool = False) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` and pack, all in one pass over ``docs(doc_id, text)``."""
    limits = (max_tokens, max_segments, max_loss or max_tokens, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece | None]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for at, flat, counts in encode_lists(batch.column(1), tokenizer):
                    if end_id is not None:
                        flat, counts = with_end(flat, counts, end_id)
                    flat, ends = flat.astype("<u4"), np.cumsum(counts)
                    for i, n in enumerate(counts.tolist()):
                        if n:
                            yield Piece(keys[at + i], flat[ends[i] - n : ends[i]].copy(), 0, n, n)
                yield None

        yield from _pack(pieces(), Packer(*limits), "doc_id", with_ids)

    kinds = ", ".join(f"{k} {t}" for k, t in FIELDS) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", pretokens(text_or_empty()).alias("words")).mapInArrow(run, f"doc_id long, {kinds}")


def pack_conversations(turns: DataFrame, *, tokenizer: str, end_id: int = END_ID, loss_roles: tuple[str, ...] = ("assistant",), max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1536) -> DataFrame:
    """Pack whole conversations; tokens of turns with a role in ``loss_roles`` bear loss."""
    from censorium.llm.tokens import encoded

    keyed = turns.select("conv_id", "turn", "role", "text").withColumn("row", F.struct("conv_id", "turn", "role"))
    ids = encoded(keyed.select(F.to_json("row").alias("row"), "text"), tokenizer, id_col="row", append=end_id)
    rows = ids.select(F.from_json("row", "conv_id long, turn long, role string").alias("row"), "ids").select("row.*", "ids")
    bears = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).cast("int")
    marked = rows.withColumn("loss", F.transform("ids", lambda _: bears))
    turns_in_order = F.array_sort(F.collect_list(F.struct("turn", "ids", "loss")))
    whole = marked.groupBy("conv_id").agg(turns_in_order.alias("t")).select("conv_id", F.flatten(F.col("t.ids")).alias("ids"), F.flatten(F.col("t.loss")).alias("loss"))
    return pack_tokens(whole, id_col="conv_id", loss_col="loss", max_tokens=max_tokens, max_segments=max_segments, max_loss=max_loss)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
