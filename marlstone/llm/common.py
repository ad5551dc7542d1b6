"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A temporary one is set where the session has none and runs in one process
    (tests); on a cluster, where such a folder would lose results, it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must be a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which cuts its lineage.

    Files outlive lost executors, and a plan that reads them has nothing of
    the old one. (``DataFrame.checkpoint`` keeps the old plan's constraints,
    which loops of joins multiply until the planner stands still.)
    """
    path = f"{shared_folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the step tables that ``df`` reads; for tables of ``checkpointed`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = path.rsplit("/", 2)
        if folder[1] == "steps":
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for columns that are added for a while: each with as many underscores in front as no column of ``df`` has."""
    taken, found = {c.lower() for c in df.columns}, {}
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        found[name] = own
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of UTF-8 in a text column; one pass that moves one number a task."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces_for(n_bytes: int, each: int, least: int) -> int:
    """Number of groups so that each holds about ``each`` bytes."""
    return max(least, math.ceil(n_bytes / each))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null stays null.

    ``lower`` agrees with that on pure ASCII and is much faster than
    ``translate``, so only texts with other characters take the latter.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, end to end, and n + 1 offsets; null counts as empty.

    No Python string is made: both arrays are views of Arrow's own buffers
    where the column has no nulls.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = column.type, np.int64
    else:
        kind, width = column.type, np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Odd multipliers of the splitmix64 finaliser (fixed values).
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; behind the end stand zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Bytes of a span that are taken eight at a time (longer spans are rare and taken one by one), and spans at once.
_SHORT, _AT_ONCE = 64, 1 << 15


def _eights(size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, spans that have it, masks of their next eight bytes) for spans up to ``_SHORT`` bytes."""
    for at in range(0, _SHORT, 8):
        live = np.flatnonzero((size > at) & (size <= _SHORT))
        if not len(live):
            return
        gone = np.maximum(8 - (size[live] - at), 0).astype(np.uint64) * np.uint64(8)
        yield at, live, np.uint64(0xFFFFFFFFFFFFFFFF) >> gone


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``, independent for different seeds.

    Each eight bytes are mixed into what came before, so no polynomial
    identity makes structured strings collide; whoever needs identity
    compares bytes (``equal_spans``) or two seeds.
    """
    first, key = np.uint64((seed * int(_MIX_2) + 1) % (1 << 64)), seed.to_bytes(8, "little")
    words, found = _words(data), np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), _AT_ONCE):
        start, end = starts[lo : lo + _AT_ONCE], ends[lo : lo + _AT_ONCE]
        size = end - start
        out = mixed(size.astype(np.uint64) * _MIX_1 + first)
        for at, live, mask in _eights(size):
            out[live] = mixed(out[live] ^ (words[start[live] + at] & mask))
        for i in np.flatnonzero(size > _SHORT).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        found[lo : lo + _AT_ONCE] = out
    return found


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``a`` and ``b`` hold the same ``size[i]`` bytes from ``a_starts[i]`` and ``b_starts[i]`` on."""
    found, left, right = np.empty(len(size), bool), _words(a), _words(b)
    for lo in range(0, len(size), _AT_ONCE):
        x, y, n = a_starts[lo : lo + _AT_ONCE], b_starts[lo : lo + _AT_ONCE], size[lo : lo + _AT_ONCE]
        out = np.ones(len(n), bool)
        for at, live, mask in _eights(n):
            out[live] &= (left[x[live] + at] ^ right[y[live] + at]) & mask == 0
        for i in np.flatnonzero(n > _SHORT).tolist():
            out[i] = np.array_equal(a[x[i] : x[i] + n[i]], b[y[i] : y[i] + n[i]])
        found[lo : lo + _AT_ONCE] = out
    return found


#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with ``is_word``; none crosses a document."""
    inside = is_word[data]
    joins = np.zeros(len(data) + 1, bool)
    joins[1:-1] = inside[1:] & inside[:-1]
    joins[offsets] = False
    return np.flatnonzero(inside & ~joins[:-1]), np.flatnonzero(inside & ~joins[1:]) + 1


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets as code points and offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return points, starts[offsets]


def row_slices(batch: pa.RecordBatch, text: str, each: int):
    """Consecutive rows of a batch with about ``each`` bytes of text; at least one row."""
    _, offsets = string_buffer(batch[text])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + each)))
        yield batch.slice(a, b - a)
        a = b


def trim() -> None:
    """Gives freed memory back to the system, so that a reused task process doesn't keep an earlier task's peak."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that trims behind its last one."""

    def and_trim(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return and_trim


def trimmed_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that trims behind it; for groups of some megabytes."""

    def and_trim(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return and_trim


_CODEC = "zstd"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([x.nbytes for x in arrays], np.int64)
    raw = b"".join(x.tobytes() for x in (np.array([len(arrays)], np.int64), head, *arrays))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_MESSAGE = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("body", pa.binary())])
MESSAGE_DDL = "to bigint, sender bigint, body binary"


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """(to, sender, body) rows between blocks and groups."""
    return pa.table(list(zip(*rows)) or [[], [], []], schema=_MESSAGE)
