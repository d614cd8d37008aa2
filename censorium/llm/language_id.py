"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (byte n-grams inside words, with
the word's edges, hashed into a fixed number of buckets); a linear softmax reads the
language off that mean.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample; a temperature fitted on rows kept out of
the training calibrates the score, and a threshold taken from the same rows says below
which score a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.llm.common import saved, table

BUCKETS, DIM, ORDERS = 4096, 16, (2, 3, 4)
#: Rows of each language, and of all languages together, that the fit learns from at most, in expectation.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 150_000
#: Labels whose counts are sent to all executors at most.
BROADCAST_LANGUAGES = 100_000
#: Short passages drawn from each sampled text, so that short texts are learned too.
PASSAGE_WORDS = (2, 8, 30)
EPOCHS, BATCH, RATE, SEED = 12, 64, 8.0, 7
#: Share of the sample that calibrates; share of it that the threshold may reject; highest threshold.
CALIBRATE, REJECT, HIGHEST = 0.2, 0.0005, 0.5
UNDETERMINED = "und"

#: Byte to symbol: ASCII letters lower-cased, other ASCII a space, UTF-8 bytes as they are.
_SYMBOL = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Shares of the buckets among the subwords of a whole text."""
    s = _SYMBOL[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for n in ORDERS:
        if len(s) < n:
            continue
        m = len(s) - n + 1
        h = np.full(m, n, dtype=np.uint32)
        inside = np.ones(m, dtype=bool)
        for i in range(n):
            h = (h ^ s[i : i + m]) * np.uint32(16777619)
            if 0 < i < n - 1:
                inside &= s[i : i + m] != 32
        if n == 2:
            inside = (s[:m] != 32) | (s[1:] != 32)
        h = (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)
        counts += np.bincount(h[inside], minlength=BUCKETS)
    return (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    embed: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax((x @ self.embed @ self.weights + self.bias) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score; ``und`` and 0 for null, for texts without a letter, and without languages."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for a in range(0, len(known), 256):
            part = known[a : a + 256]
            p = self.probabilities(np.stack([features(texts[i]) for i in part]))
            best = p.argmax(axis=1)
            scores[part] = p[np.arange(len(part)), best]
            for i, k in zip(part, best, strict=True):
                names[i] = self.languages[k]
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class SparseRows:
    """Feature rows as places and values; an index of rows gives them dense."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.places, self.values = places, values

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, r in enumerate(rows):
            out[i, self.places[r]] = self.values[r]
        return out


def train(x: np.ndarray | SparseRows, y: np.ndarray, whole: np.ndarray, languages: list[str]) -> LanguageModel:
    """x: features, y: language numbers, whole: which rows are whole texts (these calibrate).  A batch at a time is dense."""
    rng = np.random.default_rng(SEED)
    kept = rng.random(len(y)) < CALIBRATE
    fit = np.flatnonzero(~kept)
    if not len(fit):
        fit, kept = np.arange(len(y)), np.ones(len(y), dtype=bool)
    embed = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            xb = x[rows].astype(np.float32)
            mean = xb @ embed
            g = _softmax(mean @ weights + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = xb.T @ (g @ weights.T)
            weights -= rate * 0.2 * (mean.T @ g)
            bias -= rate * 0.02 * g.sum(axis=0)
            embed -= rate * 20 * back
    model = LanguageModel(languages, embed, weights, bias, 1.0, 0.0)
    held = np.flatnonzero(kept)
    if len(held):
        z, t = np.concatenate([x[held[a : a + 1024]].astype(np.float32) @ embed for a in range(0, len(held), 1024)]) @ weights + bias, y[held]
        loss = lambda temp: -np.log(np.maximum(_softmax(z / temp)[np.arange(len(t)), t], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        top = _softmax(z / model.temperature).max(axis=1)[whole[held]]
        model.threshold = min(HIGHEST, float(np.quantile(top, REJECT))) if len(top) else 0.0
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may learn from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def passages(text: str, key: int) -> list[str]:
    words = text.split()
    rng = np.random.default_rng([SEED, key & 0x7FFFFFFF])
    return [" ".join(words[(a := int(rng.integers(0, len(words) - n + 1))) : a + n]) for n in PASSAGE_WORDS if len(words) > n]


def fit(docs: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE, most_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)``, the caller having left out what may not be learned from.

    Rows without doc_id, lang or a text with words don't count.  Every label is learned.  A row is in the sample if
    a hash of its doc_id is below share / rows of its language, the share being the smaller of ``per_language``
    and ``most_rows`` over the number of languages; its features are made by Spark, and only they come to
    the driver, as sparse rows.
    """
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    counts = saved(rows.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    languages = counts.count()
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), np.zeros(0), 1.0, 0.0)
    share = min(float(per_language), most_rows / languages) / F.col("_n")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    kinds = "doc_id long, lang string, whole boolean, at binary, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    for i, t in enumerate([text, *passages(text, key)]):
                        if has_letter(t):
                            at = np.flatnonzero(x := features(t))
                            out.append((key, lang, i == 0, at.astype("<u2").tobytes(), x[at].astype("<f2").tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "lang", "whole", "at", "x"])

    drawn = rows.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").where(draw < share).select("doc_id", "text", "lang")
    found = drawn.mapInArrow(run, kinds).toPandas().sort_values(["doc_id", "lang", "whole", "at", "x"])
    names = sorted(found["lang"].unique())
    x = SparseRows([np.frombuffer(v, dtype="<u2") for v in found["at"]], [np.frombuffer(v, dtype="<f2") for v in found["x"]])
    y, whole = found["lang"].map(names.index).to_numpy(dtype=np.int64), found["whole"].to_numpy(dtype=bool)
    del found
    return train(x, y, whole, names)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs and ``lang_pred string, score double, rejected boolean``; one row per row.

    Rejected: no language can be told, or the score is below the model's threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            rejected = [n == UNDETERMINED or s < model.threshold for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    clash = [c for c in ("lang_pred", "score", "rejected") if c in docs.columns]
    docs = docs.drop(*clash)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and rejected) of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    rows = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return rows.drop("text")
