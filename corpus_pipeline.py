"""The corpus pipeline: documents through five of the training-data operators, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from marlstone.llm.bpe_sql import encode_and_decode
from marlstone.llm.common import ascii_lower, checkpointed, shared_folder, table
from marlstone.llm.decontaminate import contamination, without_spans
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.jaccard_join import Similarity, similar_documents, split_likely
from marlstone.llm.queries import training_labels
from marlstone.llm.toxicity import ToxicityConfig, fit_toxicity, toxicity_scores


_LOWEST = -(1 << 63)


def _rank(doc_id: Column) -> Column:
    """doc_id as a number; null counts as the smallest."""
    return F.coalesce(doc_id.cast("long"), F.lit(_LOWEST))


def _settled(docs: DataFrame, decisions: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """``docs`` after ``decisions`` (rank, key, stays; one row for each): rows that none names stay; of those that one names, one stays or none.

    Only rows whose rank a decision may name (by a filter of bounded size) are
    shuffled; all other texts stay where they are. Rows count by rank and
    ``key`` of their text, so other rows with one doc_id are judged apart.
    """
    decisions = checkpointed(decisions.select("rank", "key", "stays"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _rank(F.col("doc_id")).alias("rank"))
    likely, others = split_likely(rows, decisions.select("rank"), "rank")
    met = likely.withColumn("key", key(F.col("row.text"))).join(decisions, ["rank", "key"], "left")
    parts = [met.filter("stays IS NULL")]
    if not decisions.filter("stays").isEmpty():
        plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
        order = F.struct(*[F.col(f"row.`{c}`") for c in plain], F.to_json(F.struct(F.col("row"))))
        parts.append(met.filter("stays").groupBy("rank", "key").agg(F.min_by("row", order).alias("row")))
    if others is not None:
        parts.append(others)
    return reduce(DataFrame.unionByName, [p.select("row.*") for p in parts])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier takes for toxic; it is fitted on the labelled ones of ``docs``.

    Null and empty texts get the score of no n-grams; rows that repeat an id
    are judged alone; without labels nothing is rejected.
    """
    model = fit_toxicity(docs, training_labels(spark, sf_dir), ToxicityConfig())
    return toxicity_scores(docs, model).filter("predicted = 0").select(*docs.columns)


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; of rows that repeat an id and text, one.

    Null texts equal empty ones; a null doc_id counts as the smallest; an
    empty table stays empty.
    """
    found = exact_dedup(docs).groupBy(_rank(F.col("doc_id")).alias("rank"), F.col("text_sha256").alias("key"))
    counted = found.agg(F.max("keep_id").alias("keep"), F.count("*").alias("n")).withColumn("stays", F.col("rank") == _rank(F.col("keep")))
    return _settled(docs, counted.filter("NOT stays OR n > 1"), lambda text: _sha(ascii_lower(text)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar sets of five-word shingles (0.8 or more), the one with the smallest doc_id stays.

    Of several rows with that id in one group, the one with the smallest
    SHA-256 of its text stays. Texts without words are in no group and stay,
    null and empty ones too; a null doc_id counts as the smallest.
    """
    rows = docs.select("doc_id", "text", _sha(F.col("text")).alias("key"))
    found = similar_documents(rows, Similarity(words=5, num=80, den=100), also=("key",)).filter("n_shingles > 0")
    found = checkpointed(found.select(_rank(F.col("doc_id")).alias("rank"), _rank(F.col("component_id")).alias("least"), "component", "key"))
    losers = found.filter("rank <> least").select("rank", "key", F.lit(False).alias("stays"))
    ties = found.filter("rank = least").groupBy("component").agg(F.min("key").alias("best"), F.count("*").alias("n")).filter("n > 1")
    tied = found.filter("rank = least").join(ties, "component").select("rank", "key", (F.col("key") == F.col("best")).alias("stays"))
    return _settled(docs, losers.unionByName(tied).distinct(), _sha)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all words out of texts that lie in an occurrence of a benchmark item's window; n_chars follows the text.

    No row goes. Null and empty texts stay as they are, an empty benchmark
    cuts nothing; repeated rows are cut alike.
    """
    found = without_spans(contamination(docs, table(spark, sf_dir, "benchmark"), window=10))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and their digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Every row is encoded, repeated ones too; null and empty texts have no ids.
    """
    coded = encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", cut_benchmark_passages),
    ("bpe", encode),
]

#: The first, third and last stages have no SQL; tests hold the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
