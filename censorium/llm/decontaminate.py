"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are normalised to words, long ones cut into overlapping pieces, and dealt to blocks of
bounded size.  For each block a task builds one suffix automaton of all its pieces, over
numbered words.  Documents are streamed through it: the state after a word is the longest
suffix of the document so far that some item has, so all words of a match as long as the
window are hit.  A state of window length knows the items that have it; items shorter than
the window are whole windows, and each state links to the nearest one that ends with them.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.llm.common import discard, saved, table, text_or_empty

#: Words of a window.
WINDOW = 10
#: Words of a block of items (about 200 bytes of automaton each, in every worker), and of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 1_000_000, 10_000
#: Bytes that are letters or digits once A-Z are lowered, everything from 0x80 on included; the rest separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: What a scan finds in a row.
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def normalised(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window.

    A state has one successor in most cases, kept in arrays; only branching states have a dictionary.
    """

    def __init__(self, window: int):
        self.window, self.words, self.items = window, {}, []
        self.link, self.length, self.one_word, self.one_next, self.many = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1]), {}
        self.sets, self.short, self.at, self.ends = {}, {}, array("i"), array("i")

    def _get(self, v: int, t: int) -> int:
        if self.one_word[v] == t:
            return self.one_next[v]
        found = self.many.get(v)
        return -1 if found is None else found.get(t, -1)

    def _set(self, v: int, t: int, n: int) -> None:
        if self.one_word[v] in (t, -1):
            self.one_word[v], self.one_next[v] = t, n
        else:
            self.many.setdefault(v, {})[t] = n

    def _state(self, length: int, like: int = -1) -> int:
        self.length.append(length)
        self.link.append(self.link[like] if like >= 0 else -1)
        self.one_word.append(self.one_word[like] if like >= 0 else -1)
        self.one_next.append(self.one_next[like] if like >= 0 else -1)
        if like in self.many:
            self.many[len(self.length) - 1] = dict(self.many[like])
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """A state for the strings of q that end p + t, if q also has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, q)
        self.link[q] = copy
        while p >= 0 and self._get(p, t) == q:
            self._set(p, t, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, t: int) -> int:
        q = self._get(last, t)
        if q >= 0:
            return self._split(last, t, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and self._get(p, t) < 0:
            self._set(p, t, new)
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, t, self._get(p, t))
        return new

    def build(self, pieces: Sequence[tuple[str, list[bytes]]]) -> Automaton:
        """From (item, words) pieces."""
        numbers, coded = {}, []
        for item, words in pieces:
            own = array("i", (self.words.setdefault(w, len(self.words)) for w in words))
            coded.append((numbers.setdefault(item, len(numbers)), own))
            last = 0
            for t in own:
                last = self._extend(last, t)
        self.items = list(numbers)
        self.at = array("i", range(len(self.length)))  # the state of the window that ends here
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in order:
            if self.length[self.link[v]] >= self.window:
                self.at[v] = self.at[self.link[v]]
        for item, own in coded:
            v = 0
            for t in own:
                v = self._get(v, t)
                if self.length[v] >= self.window:
                    self.sets.setdefault(self.at[v], set()).add(item)
            if len(own) < self.window:
                self.short.setdefault(v, (len(own), set()))[1].add(item)
        self.sets = {v: array("i", sorted(s)) for v, s in self.sets.items()}
        self.short = {v: (n, array("i", sorted(s))) for v, (n, s) in self.short.items()}
        self.ends = array("i", bytes(4 * len(self.length)))  # the nearest state, itself included, that is a short item
        for v in order:
            self.ends[v] = v if v in self.short else self.ends[self.link[v]]
        return self

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the numbers of the items that have a window there."""
        link, length, one_word, one_next, many, ends, window = self.link, self.length, self.one_word, self.one_next, self.many, self.ends, self.window
        spans, seen, v, m = [], set(), 0, 0
        for i, t in enumerate(map(self.words.get, words)):
            if t is None:
                v = m = 0
                continue
            while True:
                if one_word[v] == t:
                    v = one_next[v]
                    m += 1
                    break
                found = many.get(v)
                n = found.get(t) if found is not None else None
                if n is not None:
                    v = n
                    m += 1
                    break
                if not v:
                    m = 0
                    break
                v = link[v]
                m = length[v]
            reach = 0
            if m >= window:
                reach = m
                seen.add(self.at[v])
            u = ends[v]
            while u:
                n = self.short[u][0]
                if n <= m:
                    reach = max(reach, n)
                    seen.add(-u)
                u = ends[link[u]]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        items = set()
        for u in seen:
            items.update(self.sets[u] if u > 0 else self.short[-u][1])
        return spans, items


def item_pieces(items: DataFrame, *, window: int = WINDOW, piece_words: int = PIECE_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words, n)``: normalised words joined by a space, in pieces that overlap by window - 1 words, so that each window lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised(text)
                for a in range(0, max(len(words) - window + 1, 1) if words else 0, piece_words):
                    piece = words[a : a + piece_words + window - 1]
                    for kept, x in zip(out, (item, b" ".join(piece), len(piece)), strict=True):
                        kept.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["item", "words", "n"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text")).mapInArrow(run, "item string, words binary, n long")


def automata(items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, **names) -> list[Broadcast]:
    """One automaton a block of items, built in a task and sent to all workers; a block's size is bounded by ``block_words``, not by the items."""
    spark = items.sparkSession
    pieces = saved(item_pieces(items, window=window, **names).distinct(), "items")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = Automaton(window).build([(r.item, bytes(r.words).split()) for r in rows.itertuples()])
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "automaton": [pickle.dumps(made)]})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
    made = saved(dealt.groupBy("block").applyInPandas(build, "block int, automaton binary"), "automata")
    found = [spark.sparkContext.broadcast(pickle.loads(bytes(r["automaton"]))) for b in range(blocks) for r in made.where(F.col("block") == b).collect()]
    discard(pieces, made)
    return found or [spark.sparkContext.broadcast(Automaton(window).build([]))]


def _scanned(docs: DataFrame, block: Broadcast) -> DataFrame:
    """docs, whose first column is ``text``, with ``n_words``, ``spans`` and ``items`` in its place."""
    others = docs.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = block.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(0).to_pylist():
                words = normalised(text)
                runs, seen = made.scan(words)
                counts.append(len(words))
                spans.append(runs)
                items.append(sorted(made.items[i] for i in seen))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], names=[*(f.name for f in others), "n_words", "spans", "items"]
            )

    return docs.mapInArrow(run, T.StructType([*others, *FOUND.fields]))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id_col, n_words, spans, items)`` for each row, and its ``text`` if asked: runs of hit words as [start, end) and the sorted ids of the items found.

    A hit word lies in an occurrence of ``window`` consecutive words of an item, or of a whole shorter item.  Null text
    is empty and has no words; null, empty and wordless items have no windows; rows of one item_id are one item, a
    null item_id is the empty string.  Repeated rows stay; other columns are ignored, whatever their names.  If the items
    fill several blocks, each scans all documents, and what they find meets by id and text (SHA-256).
    """
    text = text_or_empty(text_col)
    rows = docs.select(text.alias("text"), F.col(id_col).alias("_id"), *([text.alias("_text")] if with_text else []))
    blocks = automata(items, window=window, block_words=block_words)
    if len(blocks) == 1:
        found = _scanned(rows, blocks[0])
    else:
        found = _of_blocks(rows.withColumn("_digest", F.unhex(F.sha2("text", 256))), blocks)
    return found.select(F.col("_id").alias(id_col), *([F.col("_text").alias("text")] if with_text else []), "n_words", "spans", "items")


def _of_blocks(rows: DataFrame, blocks: Sequence[Broadcast]) -> DataFrame:
    """The findings of all blocks on each row; only rows with a hit travel, equal ones once."""
    hits = [_scanned(rows, block).where("size(spans) > 0").select("_id", "_digest", "spans", "items").dropDuplicates(["_id", "_digest"]) for block in blocks]
    met = reduce(DataFrame.unionByName, hits).groupBy(F.col("_id").alias("_id2"), F.col("_digest").alias("_digest2")).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    both = _scanned(rows, blocks[0]).drop("spans", "items").join(met, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_digest") == F.col("_digest2")), "left")
    none = F.array().cast("array<array<int>>")

    def grow(spans, x):
        last = F.get(spans, F.size(spans) - 1)
        longer = F.array(F.array(last[0], F.greatest(last[1], x[1])))
        return F.when(last[1] >= x[0], F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), longer)).otherwise(F.concat(spans, F.array(x)))

    return both.withColumns({"spans": F.aggregate(F.array_sort(F.coalesce("_spans", none)), none, grow), "items": F.array_sort(F.array_distinct(F.coalesce("_items", F.array().cast("array<string>"))))})


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def decontaminate(docs: DataFrame, items: DataFrame, *, longest: int = 0, most_share: float = 0.5, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id_col, text, n_words, n_hit, removed, dropped)``: texts without their hit spans.

    A run of hit words longer than ``longest`` words is cut from the text, from the start of its first word to the end of its last.
    A document of which more than ``most_share`` of the words are hit is ``dropped``: its text is empty.
    """
    found = contamination(docs, items, window=window, id_col=id_col, text_col=text_col, with_text=True, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cut = [s for s in spans if s[1] - s[0] > longest]
                texts.append(without(text, cut) if cut else text)
                counts.append(sum(b - a for a, b in cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(4), pa.array(counts, pa.int64())], names=["_id", "text", "n_words", "n_hit", "removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    cut = found.select(F.col(id_col).alias("_id"), "text", "n_words", "spans", n_hit().alias("n_hit")).mapInArrow(run, f"_id {kind}, text string, n_words long, n_hit long, removed long")
    dropped = F.col("n_hit") > most_share * F.col("n_words")
    return cut.select(F.col("_id").alias(id_col), F.when(dropped, F.lit("")).otherwise(F.col("text")).alias("text"), "n_words", "n_hit", "removed", dropped.alias("dropped"))


def without(text: str, spans: list[list[int]]) -> str:
    """text less the given runs of words."""
    raw = text.encode()
    spaced, at, places = raw.translate(_TABLE), 0, []
    for w in spaced.split():
        at = spaced.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of all documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP13_SQL = r"""
with item as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
doc as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
place as (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0),
wins as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as win from place),
spot as (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, (select distinct k from wins) where len(w) >= k),
hits as (select r, i, s.k, item_id from (select r, i, k, array_to_string(w[i : i + k - 1], ' ') as win from spot) s join wins using (k, win)),
covered as (select r, count(distinct x) as n from (select r, unnest(range(i, i + k)) as x from (select distinct r, i, k from hits)) group by r),
named as (select r, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(covered.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(covered.n, 0) > 0 as contaminated
from doc left join covered using (r) left join named using (r)
"""
