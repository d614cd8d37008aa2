"""Byte-level BPE encoding by ranked merges, and decoding.

Main path: the JVM splits texts into pre-tokens; each Arrow batch folds the ranked merges
over the bytes of its *distinct* pre-tokens only and puts the ids in text order.  Decoding
is a Spark expression: it looks each id up in a literal array of pieces and joins these.

``fold_words`` is the same fold as Spark higher-order functions with a literal rank map, for
tables of distinct words; it is exact but about ten times slower a word (README), which is why
whole corpora take the main path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.llm.common import table, text_or_empty
from censorium.llm.tokens import GATHER_WORDS, pretokens

#: Words whose ids a Python worker remembers at most.
REMEMBERED = 200_000
#: Parts of the literal rank map.
RANK_PARTS = 4096


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one pre-token: merge the neighbours of the lowest rank, the leftmost first, until none merge."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long pre-token, in n log n: a heap of pairs over a linked list."""
    import heapq

    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def encode(df: DataFrame, *, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of whole texts; null text is empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        known: dict[str, list[int]] = {}
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
            coded = lists.flatten().dictionary_encode()
            found = []
            for w in coded.dictionary.to_pylist():
                ids = known.get(w)
                if ids is None:
                    raw = w.encode()
                    ids = fold(raw, ranks) if len(raw) < 200 else fold_long(raw, ranks)
                    if len(known) < REMEMBERED:
                        known[w] = ids
                found.append(ids)
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            pool = np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(counts.sum()))
            begins, index, ends = np.cumsum(counts) - counts, np.asarray(coded.indices), np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + GATHER_WORDS, side="right")))
                part = index[base : ends[last - 1]]
                at = np.cumsum(counts[part])
                total = int(at[-1]) if len(at) else 0
                ids = pool[np.arange(total) + np.repeat(begins[part] - (at - counts[part]), counts[part])]
                edges = np.concatenate(([0], at))[np.concatenate(([0], ends[first:last] - base))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])
                first = last

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, pretokens(text_or_empty(text_col)).alias("words")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(ids: Column, ranks_path: str) -> Column:
    """The bytes of ids: binary pieces from a literal array, concatenated; an unknown id fails."""
    ranks = read_ranks(ranks_path)
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        by_id[i] = piece.hex()
    pieces = F.split(F.lit(",".join(by_id)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))


def fold_words(words: DataFrame, *, ranks_path: str, word_col: str = "word") -> DataFrame:
    """``(word_col, ids array<int>)`` for a table of distinct words, by Spark functions alone.

    The state of the fold is the array of pieces in hexadecimal; each step looks up the rank of
    every neighbouring pair in the literal map and merges the lowest.  The map is an array of
    small maps, addressed by a hash of the piece, since Spark searches a map from its start.
    """
    spark = words.sparkSession
    pairs = spark.createDataFrame([(k.hex().upper(), v) for k, v in read_ranks(ranks_path).items()], "k string, v int")
    parts: list[list[str]] = [[] for _ in range(RANK_PARTS)]
    for k, v, b in pairs.selectExpr("k", "v", f"pmod(hash(k), {RANK_PARTS})").collect():
        parts[b].append(f"{k}:{v}")
    ranks = "array(" + ", ".join(f"str_to_map('{','.join(p)}', ',', ':')" for p in parts) + ")"
    look = lambda e: f"try_cast(try_element_at(get(_ranks, pmod(hash({e}), {RANK_PARTS})), {e}) as int)"
    none = 1 << 30
    step = f"""aggregate(sequence(1, octet_length(`{word_col}`)), regexp_extract_all(hex(`{word_col}`), '..', 0), (p, i) ->
      case when size(p) < 2 then p else transform(
        array(array_min(transform(sequence(0, size(p) - 2), j -> named_struct('r', coalesce({look("concat(p[j], p[j + 1])")}, {none}), 'j', j)))),
        m -> if(m.r = {none}, p, concat(slice(p, 1, m.j), array(concat(p[m.j], p[m.j + 1])), slice(p, m.j + 3, size(p)))))[0] end)"""
    some = words.where(F.octet_length(word_col) > 0)
    none_left = words.where(F.octet_length(word_col) == 0).select(word_col, F.array().cast("array<int>").alias("ids"))
    return some.selectExpr(f"`{word_col}`", f"{ranks} as _ranks").selectExpr(f"`{word_col}`", "_ranks", f"{step} as _pieces").selectExpr(f"`{word_col}`", f"transform(_pieces, p -> {look('p')}) as ids").union(none_left)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = encode(table(spark, sf_dir, "documents"), ranks_path=path)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"))
