"""Token ids in bit-packed files: fixed width, block offsets, vectorised unpacking and random access."""

from __future__ import annotations

import functools
import io
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir

MAGIC = b"WLTOKEN1"
BLOCK = 4096


def width_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids, lowest bit first, width bits each; the last byte is filled up with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """One file: magic, header length, header (JSON), packed blocks, block offsets, then document ids and starts. Blocks go out as they fill up. Documents
    without an id come first; the tail has their number, and 0 stands in their place."""

    def __init__(self, out, vocabulary: int):
        self.out, self.width, self.rest, self.n = out, width_for(vocabulary), np.zeros(0, np.uint32), 0
        self.ids, self.starts, self.offsets, self.at, self.nulls = [], [], [], 0, 0
        head = json.dumps({"vocabulary": vocabulary, "width": self.width, "block": BLOCK}).encode()
        self._put(MAGIC + len(head).to_bytes(4, "little") + head)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> None:
        self.nulls += nulls
        self.ids.append(doc_ids.astype("<i8"))
        self.starts.append(self.n + np.cumsum(lengths, dtype=np.uint64) - lengths)
        self.n += len(ids)
        rest = np.concatenate([self.rest, ids])
        full = len(rest) // BLOCK * BLOCK
        for a in range(0, full, BLOCK):
            self._block(rest[a : a + BLOCK])
        self.rest = rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._put(pack(ids, self.width))

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        doc_ids = np.concatenate(self.ids or [np.zeros(0, "<i8")])
        starts = np.concatenate([*self.starts, np.array([self.n], np.uint64)]).astype("<u8")
        tail = self.at
        self._put(np.array(self.offsets, "<u8").tobytes() + doc_ids.astype("<i8").tobytes() + starts.tobytes())
        self._put(np.array([len(self.offsets), len(doc_ids), self.nulls, tail], "<u8").tobytes())
        return len(doc_ids), self.n


class Reader:
    """A file's documents, in order; any span of ids without reading other blocks. Takes bytes or a seekable file."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, bytes | bytearray | memoryview) else source
        self.file.seek(0)
        if self.file.read(8) != MAGIC:
            raise ValueError("not a token file")
        head = json.loads(self.file.read(int.from_bytes(self.file.read(4), "little")))
        self.width, self.block = head["width"], head["block"]
        end = self.file.seek(0, 2)
        self.file.seek(end - 32)
        blocks, docs, self.nulls, tail = np.frombuffer(self.file.read(32), "<u8").astype(np.int64)
        self.file.seek(int(tail))
        self.offsets = np.frombuffer(self.file.read(8 * int(blocks)), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(self.file.read(8 * int(docs)), "<i8")
        self.starts = np.frombuffer(self.file.read(8 * (int(docs) + 1)), "<u8").astype(np.int64)

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the file."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        out = []
        for k in range(first, last + 1):
            count = min(self.block, int(self.starts[-1]) - k * self.block)
            self.file.seek(int(self.offsets[k]))
            out.append(unpack(self.file.read(-(-count * self.width // 8)), count, self.width))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))


class Encoder:
    """Encodes with the tokenizers library and remembers pieces of text it has seen.

    A byte-level BPE splits a text into pretokens before it merges. Between a character that isn't white space and a single space before another such
    character there is always such a cut, so a text is looked up piece by piece; unknown pieces are cut by the tokenizer's own pattern, and unknown
    pretokens go through the library's model. Texts with other white space around spaces, or with a special token's string, go through the library whole.
    Both memories are bounded; they only save time.
    """

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, pieces: int = 500_000, pretokens: int = 1_400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kind = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        self.odd = re.compile(r" \s|\s $") if plain else re.compile("")
        self.cut = regex.compile(self.PATTERN).findall
        self.model, self.alphabet = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.most_pieces, self.most_pretokens = pieces, pretokens

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pretoken(self, text: str) -> bytes:
        out = self.pretokens.get(text)
        if out is None:
            mapped = self.alphabet.pre_tokenize_str(text)[0][0]
            out = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.pretokens) < self.most_pretokens:
                self.pretokens[text] = out
        return out

    def _piece(self, text: str) -> bytes:
        """A piece after a space, and that space."""
        out = b"".join(map(self._pretoken, self.cut(" " + text)))
        if len(self.pieces) < self.most_pieces:
            self.pieces[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.odd.search(text) or self.special.search(text):
            return self._whole(text)
        pieces = text.split(" ")
        out = list(map(self.pieces.get, pieces))
        out[0] = b"".join(map(self._pretoken, self.cut(pieces[0])))
        if None in out:
            out = [self._piece(p) if x is None else x for x, p in zip(out, pieces, strict=True)]
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as the cluster's settings complete it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, files: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text (null: empty) and write ids to bit-packed files in folder, in ascending doc_id over files and inside each. Rows of the result:
    file number, documents, ids. Each document's ids end with end_id. Null doc_ids come first; equal doc_ids go by a hash of the text, then by text, and may
    be spread over files. A folder without a file system's name is one of the cluster's default file system."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20))
    folder = qualified(spark, folder)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "hash"]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def write(batches):
        enc, part, writer, out = encoder(tokenizer), TaskContext.get().partitionId(), None, None
        end = np.array([end_id], "<u4").tobytes()
        store, base = file_system(folder)
        name, temp = f"{base}/part-{part:07d}.tok", f"{base}/.part-{part:07d}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                raw = [enc.encode(t) + end for t in piece["text"].to_pylist()]
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(temp)
                    writer = Writer(out, max(enc.vocabulary, end_id + 1))
                writer.add(piece["doc_id"].fill_null(0).to_numpy(), np.array([len(x) // 4 for x in raw], np.uint64), np.frombuffer(b"".join(raw), "<u4"), piece["doc_id"].null_count)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            store.move(temp, name)  # a task that runs twice leaves one whole file
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return dealt.mapInArrow(write, "file int, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, folder: str, counts: dict[int, int]) -> DataFrame:
    """Per document of the files in folder: doc_id, start (ids before it), n_tokens, ids_crc32. counts: ids of each file, one number a file."""
    before, starts = 0, {}
    for k in sorted(counts):
        starts[k] = before
        before += counts[k]

    def read(batches):
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                file, base = Reader(raw.as_buffer().to_pybytes()), starts[int(path.rsplit("-", 1)[1].split(".")[0])]
                for a in range(0, len(file.doc_ids), 1024):
                    b = min(a + 1024, len(file.doc_ids))
                    at = file.starts[a : b + 1]
                    ids = file.span(int(at[0]), int(at[-1])).astype("<u4")
                    at0 = at - at[0]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.doc_ids[a:b], pa.int64(), mask=np.arange(a, b) < file.nulls), "start": pa.array(base + at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[x:y]) for x, y in zip(at0, at0[1:], strict=False)], pa.int64()),
                    })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32. Null texts are empty; an empty table gives no rows."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    counts = {r["file"]: r["n_ids"] for r in write_tokens(docs, tokenizer, folder, end_id).collect()}  # one row a file
    if not counts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, counts)
