"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import checkpointed, code_points, powers, row_slices, string_buffer, trim, trimmed

_STEP = 0x9E3779B97F4A7C15 | 1
#: Bytes of text scored at once; counted at once, where every n-gram is held.
_SLICE, _FIT_SLICE = 1 << 20, 1 << 19


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_rows`` bounds the labelled rows that are fitted (half of it for each label)."""

    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    max_rows: int = 10_000
    max_features: int = 4096
    min_docs: int = 3
    alpha: float = 1.0
    l2: float = 1e-3
    rounds: int = 150


def _lowered(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def ngram_buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int, tile: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first place, bucket of the n-gram at each place from there on), tile by tile."""
    widest = max(sizes)
    up, down = powers(_STEP, tile + widest), powers(pow(_STEP, -1, 1 << 64), tile + widest)
    for a in range(0, len(points), tile):
        part = points[a : a + tile + widest - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_lowered(part).astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        for n in sizes:
            m = min(tile, len(part) - n + 1)
            if m > 0:
                h = (sums[n : n + m] - sums[:m]) * down[:m] * np.uint64(0xBF58476D1CE4E5B9 ^ (n << 1))
                yield n, a, (h >> np.uint64(64 - bits)).astype(np.int64)


def _present(points: np.ndarray, offsets: np.ndarray, config: ToxicityConfig, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs with ``wanted[bucket]``; no n-gram crosses a document."""
    docs, buckets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n, a, bucket in ngram_buckets(points, config.sizes, config.bits):
        at = np.flatnonzero(wanted[bucket])
        doc = np.searchsorted(offsets, at + a, side="right") - 1
        ok = at + a + n <= offsets[doc + 1]
        docs.append(doc[ok])
        buckets.append(bucket[at[ok]])
    pair = np.unique(np.concatenate(docs) << config.bits | np.concatenate(buckets))
    return pair >> config.bits, pair & ((1 << config.bits) - 1)


@dataclass(frozen=True)
class ToxicityModel:
    config: ToxicityConfig
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        data, offsets = string_buffer(texts)
        points, offsets = code_points(data, offsets)
        dense = np.zeros(1 << self.config.bits, np.float32)
        dense[self.buckets] = self.weights
        doc, bucket = _present(points, offsets, self.config, dense != 0)
        return self.intercept + np.bincount(doc, dense[bucket], minlength=len(offsets) - 1)


def _logistic(doc: np.ndarray, col: np.ndarray, labels: np.ndarray, ratio: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Weights of the features, times their log-count ratios, and the intercept: full-batch Adam on the penalised logistic loss.

    ``doc`` and ``col`` are the rows and features of all ones in the matrix.
    """
    scale, n = ratio[col], max(1, len(labels))
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
    w, b = np.full(len(ratio), 0.1), 0.0
    m, v, step = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), 0.05
    for t in range(1, config.rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[col] * scale, minlength=len(labels)), -30, 30)))
        err = (p - labels) * weight
        g = np.r_[np.bincount(col, err[doc] * scale, minlength=len(ratio)) + config.l2 * w, err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w * ratio, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """A model of ``labels`` (doc_id, label 0/1; null labels are left out, of several the largest counts).

    At most ``config.max_rows`` / 2 rows of each label, chosen by a hash of
    doc_id, are fitted; their texts are the only ones read into the fit. The
    document counts of n-gram buckets (at most 2 ** ``bits`` of them) are
    summed by Spark; the driver gets ``max_features`` counts and the bucket
    lists of those rows. Without labels, or in an empty table, every document
    gets one low score. Null texts are empty; rows that repeat an id all count.
    """
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    half = config.max_rows // 2
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    sample = checkpointed(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", F.col("label").cast("int").alias("label")))
    everything = np.ones(1 << config.bits, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << config.bits), np.int64)
        for batch in batches:
            for part in row_slices(batch, "text", _FIT_SLICE):
                data, offsets = string_buffer(part["text"])
                doc, bucket = _present(*code_points(data, offsets), config, everything)
                label = part["label"].to_numpy()[doc]
                for y in (0, 1):
                    total[y] += np.bincount(bucket[label == y], minlength=1 << config.bits)
        at = np.flatnonzero(total.sum(0))
        yield pa.record_batch([pa.array(at), pa.array(total[1][at]), pa.array(total[0][at])], names=["bucket", "pos", "neg"])

    seen = sample.groupBy("label").count().collect()
    m_pos, m_neg = (next((r["count"] for r in seen if r.label == y), 0) for y in (1, 0))
    sums = sample.mapInArrow(trimmed(count), "bucket bigint, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = lambda k, n: (F.col(k) + config.alpha) / (n + 2 * config.alpha)
    ratio = F.log(rate("pos", m_pos) / rate("neg", m_neg)).alias("ratio")
    strength = F.pow("ratio", F.lit(2)) * (F.col("pos") + F.col("neg"))
    best = sums.filter(F.col("pos") + F.col("neg") >= config.min_docs).select("bucket", "pos", "neg", ratio).orderBy(strength.desc(), "bucket").limit(config.max_features).toArrow()
    buckets, ratios = best["bucket"].to_numpy().astype(np.int64), best["ratio"].to_numpy().astype(float)
    order = np.argsort(buckets)
    buckets, ratios = buckets[order], ratios[order]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << config.bits, bool)
        wanted[buckets] = True
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                data, offsets = string_buffer(part["text"])
                doc, bucket = _present(*code_points(data, offsets), config, wanted)
                cols = pa.array(np.searchsorted(buckets, bucket).astype(np.int32))
                ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.record_batch([part["label"], pa.ListArray.from_arrays(ends, cols)], names=["label", "cols"])

    fit = sample.mapInArrow(trimmed(features), "label int, cols array<int>").toArrow()
    cols = fit["cols"].combine_chunks()
    sizes = cols.value_lengths().to_numpy(zero_copy_only=False)
    weights, intercept = _logistic(np.repeat(np.arange(len(cols)), sizes), cols.flatten().to_numpy(), fit["label"].to_numpy(), ratios, config)
    # fitted with both labels weighing the same; the true share of label 1 moves the intercept
    share = (n_pos + 0.5) / (n_pos + n_neg + 1.5)
    return ToxicityModel(config, buckets, weights.astype(np.float32), intercept + float(np.log(share / (1 - share))))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to every row.

    Whole texts of any length are scored, by the set of their n-grams; null
    and empty texts get the score of no n-grams; repeated rows get one score
    each, equal ones; an empty table stays empty. Other columns pass through; columns of these
    two names are replaced. The model is of fixed size (``max_features``).
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out, batch = [np.empty(0)], pa.record_batch([texts], names=["t"])
        for part in row_slices(batch, "t", _SLICE):
            out.append(1 / (1 + np.exp(-np.clip(sent.value.logits(part["t"]), -700, 700))))
        trim()
        return pa.array(np.concatenate(out))

    scored = docs.withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
