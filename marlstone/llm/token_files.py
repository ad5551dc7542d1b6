"""Token ids in framed binary records, with an offset index for shuffled reads."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import checkpointed, pieces_for, row_slices, shuffle_partitions, string_buffer, text_bytes, trimmed
from marlstone.llm.crc32c import crc32c_of
from marlstone.llm.pieces import PieceCache

#: Bytes of text behind a file, and at once.
FILE_BYTES, _SLICE = 16 << 20, 2 << 20
#: What a checksum is rotated by and added to, so that checksums of data that hold checksums stay strong (fixed values).
_ROTATE, _MASK = 15, 0xA282EAD8


def masked_crcs(strings: list[bytes]) -> np.ndarray:
    crc = crc32c_of(strings)
    return (((crc >> np.uint32(_ROTATE)) | (crc << np.uint32(32 - _ROTATE))) + np.uint32(_MASK)).astype("<u4")


def framed(payloads: list[bytes]) -> list[bytes]:
    """Each as a record: length (8 bytes), its masked CRC-32C (4), payload, its masked CRC-32C (4); all little-endian."""
    sizes = [len(p).to_bytes(8, "little") for p in payloads]
    return [b"".join((size, a.tobytes(), p, b.tobytes())) for size, a, p, b in zip(sizes, masked_crcs(sizes), payloads, masked_crcs(payloads))]


def unframed(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the records at ``offsets``; raises where a checksum differs."""
    sizes = [bytes(data[at : at + 8]) for at in offsets]
    kept = np.array([int.from_bytes(data[at + 8 : at + 12], "little") for at in offsets], np.uint32)
    if (bad := np.flatnonzero(masked_crcs(sizes) != kept)).size:
        raise ValueError(f"record at byte {offsets[bad[0]]}: its length is damaged")
    ends = [at + 12 + int.from_bytes(size, "little") for at, size in zip(offsets, sizes)]
    payloads = [bytes(data[at + 12 : end]) for at, end in zip(offsets, ends)]
    kept = np.array([int.from_bytes(data[end : end + 4], "little") for end in ends], np.uint32)
    if (bad := np.flatnonzero(masked_crcs(payloads) != kept)).size:
        raise ValueError(f"record at byte {offsets[bad[0]]}: its data are damaged")
    return payloads


class LibraryBpe:
    """Texts to the ids that the ``tokenizers`` library gives for them as wholes, many pieces in each call.

    Added tokens are found in the text first, as the library does; the rest
    is cut into pieces, of which each different one is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on what stands around them aren't supported")
        self.added = {t.content.encode(): i for i, t in added.items() if t.content}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile(b"|".join(map(re.escape, longest_first)) or rb"(?!)")
        self.tokenizer.encode_special_tokens = True  # what is left of a text has none of their strings
        self.newline = self._ids("\n")
        self.cache = PieceCache(self.encode)

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and n + 1 offsets of the texts in them."""
        raw = data.tobytes()
        if not self.find_added.search(raw):
            return self.cache.ids_of(data, offsets)
        found = [(a + m.start(), a + m.end(), self.added[m[0]]) for a, b in zip(offsets.tolist(), offsets[1:].tolist()) for m in self.find_added.finditer(raw[a:b])]
        if not found:
            return self.cache.ids_of(data, offsets)
        starts, ends, added = (np.array(x, np.int64) for x in zip(*found))
        cuts = np.sort(np.concatenate([offsets, starts, ends]))
        ids, at = self.cache.ids_of(data, cuts)
        first, last = at[np.searchsorted(cuts, starts)], at[np.searchsorted(cuts, ends)]
        ids = ids.copy()
        ids[first] = added
        gone = np.zeros(len(ids) + 1, np.int64)
        np.add.at(gone, first + 1, 1)
        np.add.at(gone, last, -1)
        kept = np.cumsum(gone[:-1]) == 0
        return ids[kept], np.r_[0, np.cumsum(kept)][at[np.searchsorted(cuts, offsets)]]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without white space (but for a space in front) are encoded as lines of one text, others alone: a line break is always a piece of its own there."""
        texts = [p.decode() for p in pieces]
        lines = [i for i, t in enumerate(texts) if not t.isspace() and len(self.newline) == 1]
        found: list[list[int] | np.ndarray] = [[]] * len(texts)
        for a in range(0, len(lines), 4096):
            some = lines[a : a + 4096]
            ids = np.array(self._ids("\n".join([texts[i] for i in some])), np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.newline[0]))
            if len(parts) != len(some):
                raise ValueError("the tokenizer doesn't keep lines apart")
            for i, part in zip(some, [parts[0], *(p[1:] for p in parts[1:])]):
                found[i] = part
        done = set(lines)
        for i, text in enumerate(texts):
            if i not in done:
                found[i] = self._ids(text)
        counts = np.array([len(x) for x in found])
        return np.concatenate([np.asarray(x, np.uint32) for x in found]), counts


@cache
def _bpe(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def _payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A byte with the width of ids (plus 128 without a doc_id), doc_id, ids."""
    return bytes([ids.itemsize + 128 * (doc_id is None)]) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids.tobytes()


_MANIFEST = "shard int, records bigint, tokens bigint, path string"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every document's ids, in ascending doc_id order (nulls first), and returns the manifest.

    Whole texts of any length are encoded as the library does by default, so
    an added token's string is that token (null text: empty), and ``end_id``
    is appended. Rows that repeat a doc_id are records of their own, ordered
    by text; an empty table gives no records. Files hold ranges of doc_id; the record's ids are as narrow as the vocabulary
    allows. Beside each file, ``.index`` holds every record's offset as eight
    little-endian bytes. A task attempt writes files of its own name and the
    manifest lists those of the attempts that succeeded, so a lost executor
    leaves nothing but unlisted files. Manifest: shard (in id order), records,
    tokens, path. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = pieces_for(text_bytes(docs), file_bytes, shuffle_partitions(spark))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard = _bpe(tokenizer_path), TaskContext.get().partitionId()
        kind = "<u2" if max(bpe.tokenizer.get_vocab_size(), end_id or 0) <= 1 << 16 else "<u4"
        name, offsets_of, at, tokens = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.rec", [], 0, 0
        fs, path = pafs.FileSystem.from_uri(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for batch in batches:
                for part in row_slices(batch, "text", _SLICE):
                    ids, ends = bpe.ids_of(*string_buffer(part["text"]))
                    tail = [] if end_id is None else [np.uint32(end_id)]
                    sequences = [np.append(ids[a:b], tail).astype(kind) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                    tokens += sum(map(len, sequences))
                    for record in framed([_payload(d, x) for d, x in zip(part["doc_id"].to_pylist(), sequences)]):
                        out.write(record)
                        offsets_of.append(at)
                        at += len(record)
        with fs.open_output_stream(f"{path}.index") as out:
            out.write(np.array(offsets_of, "<i8").tobytes())
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(offsets_of)]), pa.array([tokens]), pa.array([name])], names=["shard", "records", "tokens", "path"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return checkpointed(dealt.mapInArrow(trimmed(write), _MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every record of the files: doc_id, start (ids in all records before it), ids (little-endian unsigned 32-bit integers, packed).

    Records are found by the offset index, so that any order could be read;
    checksums are verified. Each file's start is the sum over the files before
    it, a window over the manifest: one row of some 100 bytes for every 16 MB
    of text, so one task's share stays small. An empty manifest gives no rows.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    files = manifest.select("shard", "path", before)
    spread = files.repartition(shuffle_partitions(manifest.sparkSession), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(f"{path}.index") as f:
                    offsets = np.frombuffer(f.read(), "<i8").tolist()
                with fs.open_input_file(path) as f:
                    size, a = f.size(), 0
                    while a < len(offsets):
                        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _SLICE)))
                        data = f.read_at((offsets[b] if b < len(offsets) else size) - offsets[a], offsets[a])
                        doc_ids, starts, ids = [], [], []
                        for payload in unframed(data, [at - offsets[a] for at in offsets[a:b]]):
                            own = np.frombuffer(payload, f"<u{payload[0] & 127}", -1, 9)
                            doc_ids.append(None if payload[0] & 128 else int.from_bytes(payload[1:9], "little", signed=True))
                            starts.append(start)
                            ids.append(own.astype("<u4").tobytes())
                            start += len(own)
                        yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
                        a = b

    return spread.mapInArrow(trimmed(read), "doc_id bigint, start bigint, ids binary")
