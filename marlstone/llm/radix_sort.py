"""A distributed radix sort: stable counting sorts by one digit after the other, least first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import checkpointed, discard, fresh_names, trimmed, trimmed_group

#: Rows in a block, most bits of a digit.
BLOCK_ROWS, DIGIT_BITS = 1 << 18, 14


def _digit(keys: list[np.ndarray], bits: list[int], low: int, width: int) -> np.ndarray:
    """``width`` bits from bit ``low`` on of the number that the keys make, end to end, the last one least."""
    out, at = np.zeros(len(keys[0]), np.int64), 0
    for key, size in zip(reversed(keys), reversed(bits)):
        a, b = max(low, at), min(low + width, at + size)
        if a < b:
            part = (key >> np.uint64(a - at)) & np.uint64((1 << (b - a)) - 1)
            out |= part.astype(np.int64) << (a - low)
        at += size
    return out


def radix_ranks(rows: DataFrame, ascending: list[str], digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds rank (1, 2, 3, ...) in ascending order of some long columns, the first of them counting most.

    The columns, each less its least value, make one composite number, whose
    digits of at most ``digit_bits`` bits are taken from the least on. A pass
    counts every digit in every block of ``block_rows`` places, sums the counts
    before each (digit, block) over all blocks, and so knows every row's
    destination; rows go to the block that holds it. Blocks are places, not
    keys, so equal keys don't crowd a task, whatever share of the rows they
    have. Between passes rows are written to the shared folder, from which a lost executor's
    tasks start again; a pass's table is deleted once the next one is written.

    ``rows`` is written once, so it may be costly; rows with a null in a key
    column are an error; rows equal in all of them get different ranks in no stated order. An
    empty table gives no rows. A column ``rank`` is replaced.
    """
    rows = rows.drop("rank")
    names = fresh_names(rows, "block", "place", "digit", "before")
    block, place, before = names["block"], names["place"], names["before"]
    held = checkpointed(rows)
    bounds = held.agg(*(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(ascending) for f in (F.min, F.max))).first()
    least = [bounds[f"min{i}"] for i in range(len(ascending))]
    if None in least:
        return held.filter("false").withColumn("rank", F.lit(0).cast("long"))
    bits = [(bounds[f"max{i}"] - low).bit_length() for i, low in enumerate(least)]
    passes = max(1, -(-sum(bits) // digit_bits))
    width = max(1, -(-sum(bits) // passes))
    digits = list(fresh_names(rows, *(f"digit{j}" for j in range(passes))).values())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their digits; each batch's rows are dealt to blocks of their own."""
        from pyspark import TaskContext

        first, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                part = batch.slice(a, block_rows)
                if any(part[c].null_count for c in ascending):
                    raise ValueError(f"null in a key column of {ascending}")
                keys = [part[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64)) for c, low in zip(ascending, least)]
                at = seen + np.arange(part.num_rows)
                seen += part.num_rows
                added = [pa.array(first + at // block_rows), pa.array(at % block_rows), *(pa.array(_digit(keys, bits, j * width, width).astype(np.int32)) for j in range(passes))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, block, place, *digits])

    long, int_ = T.LongType(), T.IntegerType()
    own = rows.schema.fields
    state = held.mapInArrow(trimmed(dealt), T.StructType([*own, T.StructField(block, long), T.StructField(place, long), *(T.StructField(d, int_) for d in digits)]))
    state, held = checkpointed(state), discard(held)
    for j, digit in enumerate(digits):
        later = digits[j + 1 :]
        counts = state.groupBy(block, digit).agg(F.count("*").alias(before))
        counts = checkpointed(counts)
        # at most 2 ** width sums come to the driver, a number of its own choice
        total = np.zeros(1 << width, np.int64)
        for row in counts.groupBy(digit).agg(F.sum(before).alias("n")).collect():
            total[row[digit]] = row.n
        base = np.cumsum(total) - total
        starts = counts.withColumn(before, F.sum(before).over(Window.partitionBy(digit).orderBy(block)) - F.col(before))
        schema = T.StructType([*own, T.StructField(block, long), T.StructField(place, long), *(T.StructField(d, int_) for d in later)])
        kept = [f.name for f in own]

        def moved(left: pa.Table, right: pa.Table, digit: str = digit, later: list[str] = later, base: np.ndarray = base) -> pa.Table:
            """Destinations of a block's rows: the first place of their digit, and one more for each row with that digit before."""
            left = left.take(pa.array(np.argsort(left[place].to_numpy(), kind="stable")))
            of = left[digit].to_numpy()
            first = np.zeros(1 << width, np.int64)
            first[right[digit].to_numpy()] = base[right[digit].to_numpy()] + right[before].to_numpy()
            size = np.bincount(of, minlength=1 << width)
            order = np.argsort(of.astype(np.uint16 if width <= 16 else np.uint32), kind="stable")
            to = np.empty(len(of), np.int64)
            to[order] = first[of[order]] + np.arange(len(of)) - (np.cumsum(size) - size)[of[order]]
            columns = [left[c] for c in kept] + [pa.array(to // block_rows), pa.array(to % block_rows)] + [left[d] for d in later]
            return pa.table(columns, names=[*kept, block, place, *later])

        after = checkpointed(state.groupBy(block).cogroup(starts.groupBy(block)).applyInArrow(trimmed_pair(moved), schema))
        discard(state)
        discard(counts)
        state = after
    return state.select(*[F.col(f"`{f.name}`") for f in own], (F.col(block) * block_rows + F.col(place) + 1).alias("rank"))


def trimmed_pair(run):
    """``trimmed_group`` for a function of two tables."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return trimmed_group(lambda table: run(table, right))(left)

    return both
