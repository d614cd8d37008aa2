"""Byte-level BPE ids for whole texts, with Spark doing the splitting.

The JVM splits each text into pre-tokens by the public pattern; each Arrow batch
then hands only its *distinct* pre-tokens to the tokenizer library, and numpy puts
the ids back in text order.  A pre-token alone is encoded as it is inside its text,
because byte-level BPE never merges across pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space (fixed values): Java's \s is ASCII only.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Words whose ids are put in place at once; bounds the index arrays.
GATHER_WORDS = 400_000


def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The split pattern with its white-space classes written out for Java."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")


def pretokens(text: Column) -> Column:
    """All matches of the split pattern, in order; they cover the text."""
    return F.regexp_extract_all(text, F.lit(java_pattern()), F.lit(0))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file; special tokens' strings are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies (a fixed rule)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


_LETTERS = _byte_letters()
#: Words whose ids a Python worker remembers at most, by tokenizer.
REMEMBERED = 200_000
_KNOWN: dict[str, dict[str, list[int]]] = {}


def word_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of all words one after another, and how many each has.

    A word goes straight to the library's BPE model, in the letters of the byte-level vocabulary.
    """
    known, model = _KNOWN.setdefault(path, {}), tokenizer(path).model
    room, found = REMEMBERED - len(known), []
    for w in words:
        ids = known.get(w)
        if ids is None:
            ids = [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(_LETTERS))]
            if room > 0:
                known[w] = ids
                room -= 1
        found.append(ids)
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(counts.sum())), counts


def encode_lists(lists: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, ids of the run, and ids per text.

    A null list counts as an empty text.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    pool, counts = word_ids(coded.dictionary.to_pylist(), path)
    begins = np.cumsum(counts) - counts
    index = np.asarray(coded.indices)
    ends = np.cumsum(sizes)
    first, n = 0, len(sizes)
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + GATHER_WORDS, side="right")))
        part = index[base : ends[last - 1]]
        lengths = counts[part]
        at = np.cumsum(lengths)
        total = int(at[-1]) if len(at) else 0
        ids = pool[np.arange(total) + np.repeat(begins[part] - (at - lengths), lengths)]
        edges = np.concatenate(([0], at))[np.concatenate(([0], ends[first:last] - base))]
        yield first, ids, np.diff(edges)
        first = last


def encoded(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", append: int | None = None, out: str = "ids") -> DataFrame:
    """``(id_col, out array<int>)`` for every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, flat, counts in encode_lists(batch.column(1), path):
                if append is not None:
                    flat, counts = with_end(flat, counts, append)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(counts)), lists], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    split = df.select(id_col, pretokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    return split.mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's."""
    return np.insert(flat, np.cumsum(counts), end), counts + 1
