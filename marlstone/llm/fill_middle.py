"""Fill-in-the-middle examples, cut by a sparse index of multibyte characters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import fresh_names, row_slices, string_buffer, trimmed

#: Bytes of text at once.
_SLICE = 1 << 20

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FimConfig:
    """Texts are cut between lines (``unit="line"``) or code points (``"char"``).

    ``rate`` percent of documents are transformed, ``spm`` percent of those in
    suffix-prefix-middle order. ``markers`` stand before prefix, suffix and
    middle; none may hold or overlap another, so that outputs split one way only.
    """

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        if self.unit not in ("line", "char"):
            raise ValueError(f"unit is {self.unit!r}; it must be 'line' or 'char'")
        for i, a in enumerate(self.markers):
            for j, b in enumerate(self.markers):
                if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"markers {a!r} and {b!r} overlap")


class MultibyteIndex:
    """Code points and bytes of UTF-8 data, by its exceptions alone.

    Only characters of several bytes are recorded: the byte and the code point
    at which each starts, and the bytes in excess of one so far. A cut in one
    unit is found in the other by a binary search among them and a sum; data
    of pure ASCII has an empty index, and both numbers are the same.
    """

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        self.excess = np.r_[0, np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))]
        self.at_point = self.at_byte - self.excess[:-1]

    def to_points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte (a character's first, or the end)."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]

    def to_bytes(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.excess[np.searchsorted(self.at_point, point)]


def _line_cuts(data: np.ndarray, offsets: np.ndarray, index: MultibyteIndex) -> tuple[np.ndarray, object]:
    """Lines of each text, and a function from (texts, units) to the code point at which that many lines have ended."""
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets)
    full = offsets[1:] > offsets[:-1]
    open_end = full & (data[np.maximum(offsets[1:] - 1, 0)] != 10) if len(data) else full
    n = np.diff(first) + open_end
    padded = np.r_[breaks, 0]

    def cut(units: np.ndarray) -> np.ndarray:
        inside = padded[np.minimum(first[:-1] + np.maximum(units, 1) - 1, len(breaks))] + 1
        at = np.where(units == 0, offsets[:-1], np.where(units == n, offsets[1:], inside))
        return index.to_points(at)

    return n, cut


def _char_cuts(data: np.ndarray, offsets: np.ndarray, index: MultibyteIndex) -> tuple[np.ndarray, object]:
    starts = index.to_points(offsets)
    return np.diff(starts), lambda units: starts[:-1] + units


def _examples(part: pa.RecordBatch, config: FimConfig, names: dict[str, str]) -> list[pa.Array]:
    """n, prefix_chars, middle_chars and output of the rows of a slice."""
    data, offsets = string_buffer(part["text"])
    index = MultibyteIndex(data)
    n, cut = (_line_cuts if config.unit == "line" else _char_cuts)(data, offsets, index)
    form = np.array(part[names["form"]].to_pylist(), object)
    a, b = (part[names[h]].to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for h in ("h1", "h2"))
    points = np.stack([index.to_points(offsets[:-1]), cut(np.minimum(a, b)), cut(np.maximum(a, b))])
    cuts = index.to_bytes(points)
    raw, (pre, suf, mid) = memoryview(data.tobytes()), (m.encode() for m in config.markers)
    pieces, sizes = [], np.empty(len(form), np.int64)
    for i, (kind, p, m, s, end) in enumerate(zip(form, *cuts.tolist(), offsets[1:].tolist())):
        if kind == PLAIN:
            parts = [raw[p:end]]
        elif kind == PSM:
            parts = [pre, raw[p:m], suf, raw[s:end], mid, raw[m:s]]
        else:
            parts = [suf, raw[s:end], pre, raw[p:m], mid, raw[m:s]]
        pieces += parts
        sizes[i] = sum(map(len, parts))
    ends = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64))
    output = pa.Array.from_buffers(pa.large_string(), len(form), [None, ends, pa.py_buffer(b"".join(pieces))]).cast(pa.string())
    plain = form == PLAIN
    return [pa.array(n), pa.array(points[1] - points[0], mask=plain), pa.array(points[2] - points[1], mask=plain), output]


def fill_in_middle(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """Adds n (units of the text), form, prefix_chars, middle_chars and output to every document.

    Cuts, order and whether a text is transformed depend on the seed and
    doc_id alone (a null doc_id counts as an empty string), so rows that
    repeat an id are cut by the same numbers and reruns give the same rows.
    Null and empty texts, and texts that hold a marker, stay plain: output is
    the text (empty for null), prefix_chars and middle_chars are null. Texts of any
    length are taken whole, one slice of rows at a time; an empty table gives
    no rows. Columns of these five names are replaced, others pass through;
    nothing is shuffled.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    key = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    names = fresh_names(docs, "form", "h1", "h2")

    def group(i: int) -> Column:
        return F.conv(F.substring(key, 8 * i - 7, 8), 16, 10).cast("long")

    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for marker in config.markers:
        marked = marked | F.contains(text, F.lit(marker))
    form = F.when((text == "") | marked | (group(3) % 100 >= config.rate), PLAIN).when(group(4) % 100 < config.spm, SPM).otherwise(PSM)
    dealt = docs.select("*", form.alias(names["form"]), group(1).alias(names["h1"]), group(2).alias(names["h2"]))
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                n, prefix, middle, output = _examples(part, config, names)
                columns = [*part.columns[:width], n, part[names["form"]], prefix, middle, output]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:width], "n", "form", "prefix_chars", "middle_chars", "output"])

    added = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    return dealt.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in added)]))


def restored(output: Column | str, form: Column | str, config: FimConfig = FimConfig()) -> Column:
    """The text that an output of that form was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in config.markers), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
