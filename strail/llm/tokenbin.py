"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record file holds, for each document in ascending id order: the payload's length (unsigned 64 bits), the masked CRC-32
of these 8 bytes, the payload, and its masked CRC-32; all little-endian. A payload is the document's row number in the
file (unsigned 64 bits) and its ids, of 16 bits if the vocabulary allows, else of 32. The index file beside it starts
with a magic word and the width of ids, and gives for each record its offset and number of ids. A mask rotates a
checksum by 15 bits and adds a constant, so that checksums of data that hold checksums stay good.

Each range partition writes one pair of files under temporary names and renames them when whole: an attempt that is
lost or repeated leaves the same files.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strail.llm.common import fresh_path, materialize, text_of

MAGIC = b"SRECIDX1"
WORDS = 600_000  # white-space separated words that a worker remembers, but for those of one more text
SLICE = 4 << 20  # bytes of ids that are flushed at once
ROWS_PER_FILE, BYTES_PER_FILE = 20_000, 64_000_000  # of texts, about


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmasked(m: int) -> int:
    c = (m - 0xA282EAD8) & 0xFFFFFFFF
    return (c >> 17 | c << 15) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def read_record(f, offset: int | None = None) -> bytes:
    """The payload of the record at this offset (default: the next); raises ValueError if it is damaged."""
    if offset is not None:
        f.seek(offset)
    head = f.read(12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("damaged record")
    return body[:n]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_letters = byte_letters()
_tail = re.compile(rb"(.*[A-Za-z0-9])([.,;:!?]+)", re.DOTALL).fullmatch


class WordTokenizer(dict):
    """Ids of ASCII white-space separated words, by the tokenizers library, packed; a bounded number is remembered.

    The tokenizer's normalizer turns white space into single spaces, its pattern drops them, and no rule of it looks
    across them; so a text's ids are those of its words, one after the other. Likewise stops behind a letter or digit
    are matches of their own. A word of Latin letters alone is one match of the pattern, which its normalizer just puts
    in lower case; it goes to the library's model at once. All other words take the library's whole way.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")  # little-endian machines

    def __missing__(self, word: bytes) -> bytes:
        if tail := _tail(word):
            packed = self[tail[1]] + self[tail[2]]
        else:
            text = word.decode()
            if text.isalpha() and max(text) < "\u0180" and "\u0130" not in text:
                low = text.lower()
                if low != text:
                    packed = self[low.encode()]
                else:
                    letters = low if low.isascii() else "".join(map(_letters.__getitem__, word))
                    packed = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                packed = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) < 256:
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(self) > WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of each whole text (null: empty) and end_id, in ascending order of id (nulls first; rows of one id by a hash
    of the text, so that an id with a large share of all rows is many files).

    Returns the manifest (part, file, n_docs, n_ids), a row for each file. Beside a file's index lie its document ids,
    in the order of its records, as an Arrow file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        part, words = TaskContext.get().partitionId(), tokenizer(vocabulary)
        end = np.array([end_id], words.kind).tobytes()
        temporary, final = f"{root}/.writing-{uuid.uuid4().hex}", f"{root}/part-{part:06d}"
        store.create_dir(root, recursive=True)
        out, at, index, n_ids, ids, pending, size = None, 0, [], 0, [], [], 0
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{temporary}.rec")
                packed = words.encode(text.as_py()) + end
                record, n = frame(struct.pack("<Q", len(index)) + packed), len(packed) // int(words.kind[2])
                index.append((at, n))
                ids.append(key.as_py())
                at, n_ids, size = at + len(record), n_ids + n, size + len(record)
                pending.append(record)
                if size > SLICE:
                    out.write(b"".join(pending))
                    pending, size = [], 0
        if out is None:
            return
        out.write(b"".join(pending))
        out.close()
        with store.open_output_stream(f"{temporary}.idx") as f:
            f.write(MAGIC + struct.pack("<Q", int(words.kind[2])) + np.array(index, "<u8").tobytes())
        with store.open_output_stream(f"{temporary}.ids") as f, pa.ipc.new_file(f, pa.schema([("id", b.schema.field(0).type)])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type)], names=["id"]))
        for suffix in ("rec", "idx", "ids"):
            store.move(f"{temporary}.{suffix}", f"{final}.{suffix}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [final], "n_docs": [len(index)], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    spark = docs.sparkSession
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_FILE), -(-size // BYTES_PER_FILE))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    manifest = materialize(ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "manifest")
    store, root = fs.FileSystem.from_uri(path)
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(".writing-"):  # of attempts that were lost
            store.delete_file(f.path)
    return manifest


class RecordFile:
    """Random access to one record file by its index."""

    def __init__(self, path: str, file: str):
        self.store, _ = fs.FileSystem.from_uri(path)
        with self.store.open_input_stream(f"{file}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{file}.idx is no index")
        self.kind = f"<u{struct.unpack('<Q', raw[8:16])[0]}"
        self.index = np.frombuffer(raw[16:], "<u8").reshape(-1, 2)
        self.file = self.store.open_input_file(f"{file}.rec")
        with self.store.open_input_file(f"{file}.ids") as f:
            self.keys = pa.ipc.open_file(f).read_all().column(0)

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> np.ndarray:
        payload = read_record(self.file, int(self.index[i, 0]))
        if struct.unpack("<Q", payload[:8])[0] != i:
            raise ValueError("the index points at another record")
        ids = np.frombuffer(payload[8:], self.kind)
        if len(ids) != int(self.index[i, 1]):
            raise ValueError("record and index disagree")
        return ids


def read_records(spark: SparkSession, path: str, manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each record, read back from the files; start counts the ids of all before it."""
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row for each file
        files.append((r["part"], r["file"], start))
        start += r["n_ids"]
    if not files:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                records = RecordFile(path, file)
                n = records.index[:, 1].astype(np.int64)
                crc = [zlib.crc32(records[i].astype("<u4").tobytes()) for i in range(len(records))]
                keys = records.keys.combine_chunks()
                keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
                yield pa.RecordBatch.from_arrays([keys, pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "part int, file string, start long").repartition(len(files), "part")
    return table.mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write docs as record files in `path` (default: the shared folder) and read them back; see read_records().

    Null and empty texts give the end id alone; repeated rows and ids a record each; an empty table no file and no row.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    manifest = write_records(docs, path, vocabulary, end_id, id_col, text_col)
    return read_records(spark, path, manifest, docs.schema[id_col].dataType.simpleString(), id_col)
