"""Exact duplicates by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ascii_lower, checkpointed

BLOCK_CHARS = 4096


def _blocks(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` code points (the last may be shorter); an empty text is one empty piece."""
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _named(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Distinct values of ``key`` with an integer ``name`` each.

    Partial aggregation drops repeats before the shuffle, so a block that a
    third of the corpus holds arrives once a task. Sorting makes the names the
    ranks inside each hash partition, offset by the partition: equal values
    get one name, different values never share one.
    """
    return blocks.select(*key).distinct().sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id())


def _level_zero(rows: DataFrame, size: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """One row per block: the document's columns, ``i`` and the block's name.

    Names are given to whole blocks, compared in full. A block is then looked
    up by its 64-bit fingerprint, which is exact where all blocks with that
    fingerprint are one; fingerprints that two different blocks share are
    looked up by the whole block.
    """
    cut = rows.select("doc_id", "row_key", F.posexplode(_blocks(F.col("norm"), size)).alias("i", "block"))
    keyed = cut.withColumn("h", fingerprint(F.col("block")))
    names = _named(keyed, ["h", "block"])
    slim = checkpointed(names.select("h", "name"))
    shared = checkpointed(slim.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name")))
    where = keyed.drop("block").join(shared, "h")
    out = where.filter("n = 1").select("doc_id", "row_key", "i", "name")
    if shared.filter("n > 1").isEmpty():
        return out
    clash = shared.filter("n > 1").select("h")
    full = checkpointed(_named(keyed.join(clash, "h", "left_semi"), ["h", "block"]).withColumn("name", -1 - F.col("name")))
    return out.unionByName(keyed.join(full, ["h", "block"]).select("doc_id", "row_key", "i", "name"))


def block_identities(
    docs: DataFrame,
    block_chars: int = BLOCK_CHARS,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(doc_id, text_sha256, level, name, copies): equal texts, and only those, share (level, name).

    Texts are lower-cased in A-Z only; null counts as empty. Every level
    halves the names of each document: adjacent pairs are sorted into new
    integers until one is left. ``copies`` counts rows that repeat both
    doc_id and text. Long documents alone reach the higher levels, with 1 /
    ``block_chars`` of their characters as rows.
    """
    rows = docs.select("doc_id", F.coalesce(ascii_lower(F.col("text")), F.lit("")).alias("norm"))
    rows = rows.withColumn("row_key", F.sha2("norm", 256))
    level, done = 0, None
    state = _level_zero(rows, block_chars, fingerprint).groupBy("doc_id", "row_key", "i").agg(F.max("name").alias("name"), F.count("*").alias("copies"))
    state = checkpointed(state)
    while True:
        last = state.groupBy("doc_id", "row_key").agg(F.max("i").alias("top"), F.max("name").alias("name"), F.max("copies").alias("copies"))
        ended = last.filter("top = 0").select("doc_id", F.col("row_key").alias("text_sha256"), F.lit(level).alias("level"), "name", "copies")
        done = ended if done is None else done.unionByName(ended)
        longer = last.filter("top > 0").select(F.struct(F.isnull("doc_id"), F.coalesce("doc_id", F.lit(0)), "row_key").alias("of"))
        more = state.withColumn("of", F.struct(F.isnull("doc_id"), F.coalesce("doc_id", F.lit(0)), "row_key")).join(longer, "of", "left_semi").drop("of")
        pairs = checkpointed(
            more.groupBy("doc_id", "row_key", F.shiftright("i", 1).alias("j")).agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                # an absent right half is no name at all, so no name can equal it
                F.struct(F.count(F.when(F.col("i") % 2 == 1, 1)).alias("there"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("v")).alias("b"),
                F.max("copies").alias("copies"),
            )
        )
        if pairs.isEmpty():
            return done
        names = _named(pairs, ["a", "b"])
        state = checkpointed(pairs.join(names, ["a", "b"]).select("doc_id", "row_key", F.col("j").alias("i"), "name", "copies"))
        level += 1


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty. Of a
    group the largest doc_id stays. Rows that repeat one doc_id and text are
    all returned, each counted in ``group_size`` and all ``kept`` if that id
    is the largest. A null doc_id counts as smaller than any other; an empty
    table gives no rows; other columns are ignored.
    """
    ids = checkpointed(block_identities(docs.select("doc_id", "text"), block_chars, fingerprint))
    # written, so that both sides of the join below are shuffled and a hot group's partition can be split
    groups = checkpointed(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    out = ids.join(groups, ["level", "name"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
