"""Runs of periodically repeated words, by a harmonic grid of common extensions.

A run of period p that is at least ``exponent`` periods long covers at least that many
consecutive grid points jp, whose words are all equal.  For each period p and each such j the words from jp and
(j+1)p on are compared: the forward extension by the suffix array of the words, the
backward one by that of the reversed words, each a range minimum over common prefixes.  The two extensions
are the run.  Grid points with unequal words have no forward extension, so the arrays are
made only of documents with enough equal neighbours on some grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censorium.llm.common import table, text_or_empty

#: Words and exponent that a run has at least.
LEAST, EXPONENT = 6, 4
#: Words of documents whose arrays are made together, and grid points looked at together.
CHUNK_WORDS, CHUNK_POINTS = 1 << 17, 1 << 20


class Extensions:
    """Longest common prefixes of suffixes of a sequence of numbers from 1 on: suffix array, common prefixes of neighbours, range minima."""

    def __init__(self, s: np.ndarray):
        n, levels = len(s), []
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
        step = 1
        while True:
            levels.append(rank.astype(np.int32))
            if rank.max(initial=0) == n or step >= 2 * n:
                break
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - step, 0)] = rank[step:]
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64))))[:n]
            step *= 2
        self.rank = rank.astype(np.int32) - 1
        order = np.empty(n, dtype=np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            level = levels[k]
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = level[a[inside]] == level[b[inside]]
            # a suffix shorter than 2^k has a rank of its own there, unless k is 0
            for x in (a, b):
                x[same] += 1 << k
            common[same] += 1 << k
        self.minima = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at a and at b, a unlike b."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.minima[level]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << level)])
        return out


def grid_points(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place in words, period) of grid points at which ``exponent`` consecutive ones have equal words, in bounded portions.

    ``words`` holds all documents, document d from starts[d] on.
    """
    most = sizes // exponent
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (sizes[doc] - 1) // period
    ends = np.cumsum(pairs)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_POINTS, "right")))
        n = pairs[at:to]
        which = np.repeat(np.arange(at, to), n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        here = starts[doc[which]] + j * period[which]
        same = words[here] == words[here + period[which]]
        # enough equal neighbours in a row, with this pair among them
        row = same.copy()
        for k in range(1, exponent - 1):
            shifted = np.zeros(len(same), dtype=bool)
            shifted[:-k] = same[k:] & (which[k:] == which[:-k]) if k < len(same) else False
            row &= shifted
        found = np.flatnonzero(row)
        yield doc[which[found]], here[found], period[which[found]]
        at = to


def runs_of(documents: list[np.ndarray], *, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each sequence of word numbers its runs (start, length, period) by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    if not sizes.sum():
        return found
    words, starts = np.concatenate(documents), np.cumsum(sizes) - sizes
    points = [np.concatenate(x) for x in zip(*grid_points(words, starts, sizes, exponent), strict=True)]
    if not points or not len(points[0]):
        return found
    doc, here, period = points
    # the candidates in one sequence, each between numbers that nothing else has
    kept = np.unique(doc)
    top = int(words.max()) + 2
    parts, places, at = [np.array([top])], np.zeros(len(documents), dtype=np.int64), 1
    for i, d in enumerate(kept):
        places[d] = at
        parts += [documents[d] + 1, np.array([top + 1 + i])]
        at += sizes[d] + 1
    whole = np.concatenate(parts)
    a = here - starts[doc] + places[doc]
    b = a + period
    forward = Extensions(whole).common(a, b)
    backward = Extensions(whole[::-1]).common(at - a, at - b)
    start, length = a - backward - places[doc], forward + backward + period
    enough = length >= np.maximum(least, exponent * period)
    rows = np.stack([doc, start, length, period], axis=1)[enough]
    rows = rows[np.lexsort(rows.T[::-1])]
    # a stretch is found at many points, and with several periods, of which the smallest comes first
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    for d, s, n, p in rows[first].tolist():
        found[d].append((s, n, p))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by a space: a run keeps its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    gone = np.cumsum(change) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=False) if not g)


def _chunks(texts: list[str]) -> Iterator[list[list[bytes]]]:
    some, n = [], 0
    for text in texts:
        words = text.encode().split()  # bytes split at exactly these six kinds of white space
        if some and n + len(words) > CHUNK_WORDS:
            yield some
            some, n = [], 0
        some.append(words)
        n += len(words)
    yield some


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, *, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` for each row: all runs by start and period, and the words left when each keeps its first period.

    Words lie between ASCII white space.  A run has a smallest period q (words q apart are equal), at least ``least`` words and
    ``exponent`` times q (3 or more), and no longer stretch with period q holds it; ``collapsed`` joins words by one space.  Null text is
    empty, with no runs; repeated rows and ids stay; whole texts, however long, in one task each; other columns are ignored.
    """
    if exponent < 3:
        raise ValueError("exponent is 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for chunk in _chunks(batch.column(1).to_pylist()):
                numbers: dict[bytes, int] = {}
                coded = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)) for words in chunk]
                found = runs_of(coded, least=least, exponent=exponent)
                counts += map(len, chunk)
                runs += found
                kept += map(collapsed, chunk, found)
            flat = [r for x in runs for r in x]
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            struct = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text)``, where each tenth text by a hash of its id is periodic from some word on.

    With h = crc32(id), g = floor(h / 10) and h % 10 = 0, the n words from a = g % n on repeat their first
    1 + floor((n - a) / (3 + g % 8)).  Rows without an id and empty texts are left alone.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_h", F.crc32(F.col("_id").cast("string")))
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.col("_h") % 10 == 0
    rows = rows.withColumn("_w", F.when(chosen, words)).withColumn("_n", F.size("_w"))
    g = F.floor(F.col("_h") / 10)
    a = F.when(F.col("_n") > 0, g % F.col("_n"))
    rows = rows.withColumn("_a", a).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    edited = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", place(i))))
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_n") > 0, edited).otherwise(F.col("_text")).alias("text"))


def _line(run: Column) -> Column:
    return F.concat(run["start"].cast("string"), F.lit(","), run["length"].cast("string"), F.lit(","), run["period"].cast("string"), F.lit("\n"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the greatest run and digests of all runs and of the collapsed text, of all documents with runs planted in a tenth."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", _line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
