"""Importance resampling of documents towards a target corpus, by hashed n-grams and an exponential race."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import LOWER, byte_words, checkpointed, fresh_names, row_slices, string_buffer, trimmed
from marlstone.llm.decontaminate import WORD_BYTES
from marlstone.llm.radix_sort import radix_ranks

#: Bytes of text at once.
_SLICE = 1 << 20
_POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected (fixed value)


@dataclass(frozen=True)
class ImportanceConfig:
    """Features are runs of ``shortest`` to ``longest`` words; of the documents with ``min_words`` words, ``percent`` in a hundred are drawn."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    percent: int = 10


def _crc_table() -> np.ndarray:
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1)
    return one


_CRC = _crc_table()
#: Words up to this many bytes are taken side by side, longer ones one by one.
_SHORT = 32


def _appended(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of a word each."""
    crc, size = crc.copy(), ends - starts
    short = np.where(size > _SHORT, 0, size)
    order = np.argsort(-short, kind="stable")
    live = len(short) - np.cumsum(np.bincount(short, minlength=_SHORT + 1))
    for k, n in enumerate(live[:_SHORT].tolist()):
        at = order[:n]
        crc[at] = _CRC[(crc[at] ^ data[starts[at] + k]) & 255] ^ (crc[at] >> 8)
    for i in np.flatnonzero(size > _SHORT).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~crc[i])) ^ 0xFFFFFFFF
    return crc


def feature_buckets(data: np.ndarray, offsets: np.ndarray, config: ImportanceConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the words of every text."""
    data = LOWER[data]
    starts, ends = byte_words(data, offsets, WORD_BYTES)
    text = np.searchsorted(offsets, starts, side="right") - 1
    texts, buckets = [], []
    crc, first = np.full(len(starts), 0xFFFFFFFF, np.uint32), np.arange(len(starts))
    for n in range(1, config.longest + 1):
        last = first + n - 1
        if n > 1:
            crc = _CRC[(crc ^ np.uint32(0x20)) & 255] ^ (crc >> 8)
        crc = _appended(crc, data, starts[last], ends[last])
        if n >= config.shortest:
            texts.append(text[first])
            buckets.append(((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(config.buckets)).astype(np.int64))
        whole = np.flatnonzero((last + 1 < len(starts)) & (text[np.minimum(last + 1, len(starts) - 1)] == text[first])) if len(first) else np.empty(0, np.int64)
        crc, first = crc[whole], first[whole]
    joined = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (texts, buckets))
    return *joined, np.bincount(text, minlength=len(offsets) - 1)


def bucket_counts(docs: DataFrame, config: ImportanceConfig) -> np.ndarray:
    """Features of all rows of a table by bucket; a task sends ``config.buckets`` numbers at most, and so many come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                total += np.bincount(feature_buckets(*string_buffer(part["text"]), config)[1], minlength=config.buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(config.buckets, np.int64)
    for row in docs.select("text").mapInArrow(trimmed(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def fit_gains(docs: DataFrame, target: DataFrame, config: ImportanceConfig = ImportanceConfig()) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: 1000 times the log ratio of smoothed frequencies, rounded down."""
    s, t = (bucket_counts(x, config).astype(np.float64) for x in (docs, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + config.buckets) / ((s + 1) * (t.sum() + config.buckets)))).astype(np.int64)


def importance_scores(docs: DataFrame, gains: np.ndarray, config: ImportanceConfig = ImportanceConfig()) -> DataFrame:
    """Adds n_words, n_features, weight and score to every document.

    ``score`` is the weight and a Gumbel number that depends on the seed and
    doc_id alone (a null doc_id counts as an empty string), so the highest
    scores are a draw without replacement by the weights, the same in every
    run. Null and empty texts have no words and weight 0; repeated rows score alike; texts of
    any length are taken whole; an empty table gives no rows. Columns of these
    four names are replaced, others pass through; nothing is shuffled.
    """
    docs = docs.drop("n_words", "n_features", "weight", "score")
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = fresh_names(docs, "draw")["draw"]
    dealt = docs.withColumn(drawn, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                text, bucket, words = feature_buckets(*string_buffer(part["text"]), config)
                weight = np.bincount(text, gains[bucket], minlength=part.num_rows).astype(np.int64)  # whole numbers below 2**53: exact
                u = (part[drawn].to_numpy(zero_copy_only=False).astype(np.float64) + 0.5) / 4294967296
                score = weight + np.floor(-1000 * np.log(-np.log(u))).astype(np.int64)
                columns = [words.astype(np.int64), np.bincount(text, minlength=part.num_rows).astype(np.int64), weight, score]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, columns)], names=[*part.schema.names[:-1], "n_words", "n_features", "weight", "score"])

    added = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
    return dealt.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *added]))


def importance_ranks(scored: DataFrame, config: ImportanceConfig = ImportanceConfig(), digit_bits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Adds rank: 1, 2, 3, ... by falling score, then rising doc_id, for the documents that are drawn; null for the others.

    Of N documents with ``min_words`` words, floor(percent * N / 100) are drawn.
    Null doc_ids stand behind all others of their score; rows equal in score and
    doc_id have ranks in no stated order. ``scored`` has a whole-number doc_id and the columns
    of ``importance_scores``; give it without texts, since all its columns go through the sort.
    """
    sizes = {k: v for k, v in (("digit_bits", digit_bits), ("block_rows", block_rows)) if v}
    scored = checkpointed(scored.drop("rank"))
    names = fresh_names(scored, "falling", "absent", "id")
    enough = F.col("n_words") >= config.min_words
    keyed = scored.filter(enough).select("*", (-F.col("score")).alias(names["falling"]), F.col("doc_id").isNull().cast("long").alias(names["absent"]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(names["id"]))
    ranked = radix_ranks(keyed, [names["falling"], names["absent"], names["id"]], **sizes).drop(*names.values())
    limit = config.percent * ranked.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank")))
    rest = scored.filter(~enough | enough.isNull()).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def importance_sample(docs: DataFrame, target: DataFrame, config: ImportanceConfig = ImportanceConfig()) -> DataFrame:
    """The documents that are drawn, whole, with their weight and score.

    The lowest drawn (score, doc_id) is looked up after the sort, and a second
    scoring pass keeps what lies at or above it, so no text is sorted or
    joined; rows that repeat that last score and id are all kept.
    """
    gains = fit_gains(docs, target, config)
    scored = importance_scores(docs, gains, config)
    ranked = importance_ranks(importance_scores(docs.select("doc_id", "text"), gains, config).drop("text"), config)
    last = ranked.filter("rank is not null").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("x")).first().x
    if last is None:
        return scored.filter("false")
    same_or_before = F.lit(True) if last.doc_id is None else F.col("doc_id") <= last.doc_id
    return scored.filter((F.col("n_words") >= config.min_words) & ((F.col("score") > last.score) | ((F.col("score") == last.score) & same_or_before)))
