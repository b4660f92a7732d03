"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a pair of files. ``<name>.rec`` is a series of frames::

    length   8 bytes  little-endian, bytes of the payload
    check    4 bytes  masked CRC-32 of the length field
    payload           one document
    check    4 bytes  masked CRC-32 of the payload

and a payload is ``flag (1) | doc_id (8) | id width (1) | ids``, the ids as little-endian unsigned integers of 2 bytes if
the vocabulary has at most 65,536 entries and of 4 bytes otherwise. ``<name>.idx`` holds, frame by frame, the 8-byte offset of the
frame and the 8-byte number of ids before the document in this shard.
A checksum is masked by turning it right by 15 bits and adding a constant, so that data that hold
checksums of their own do not check trivially.

Documents stand in ascending order of id (null first), then of text; rows repeated in the input are repeated here. Null texts
count as empty and hold the end id alone. No documents, no shards. Every task writes files under a
name of its own attempt and reports them in one manifest row; only the rows of attempts that Spark
committed are read, so that a lost executor or a repeated task leaves nothing behind that counts.

Words: the byte-level pre-tokenizer cuts a text before every lone blank that stands between two other characters,
so such texts are encoded word by word and words met before come from a bounded cache. Texts with runs of
blanks, blanks at an end, other white space or added tokens are encoded whole by the library.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wastelens.llm import common
from wastelens.session import shared_dir

END_ID = 0
CACHE_WORDS = 600_000
MASK = 0xA282EAD8
PATH = "byte_bpe_50k.json"
MARKS = ".,!?;:*&%$#)]}\""
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
OTHER_ASCII = [c for c in OTHER_SPACES if c.isascii()]
LETTERS_END = "\u0250"
_state: dict = {}  # of this Python worker


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(stream) -> bytes | None:
    """The next payload of a stream, None at its end. Raises where a checksum does not hold."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("damaged length of a record")
    (length,) = struct.unpack("<Q", head[:8])
    body = stream.read(length + 4)
    if len(body) < length + 4 or struct.unpack("<I", body[length:])[0] != masked_crc(body[:length]):
        raise ValueError("damaged payload of a record")
    return body[:length]


def pack(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return struct.pack("<BqB", doc_id is None, doc_id or 0, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    missing, doc_id, width = struct.unpack("<BqB", payload[:10])
    return (None if missing else doc_id), np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=10).astype("<u4")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: itself, or from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to bytes of little-endian ids, equal to the library's encode on the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = kind == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.normalizer is None
        self.letters = byte_letters()
        self.blank = self.letters[32]
        self.code = "H" if self.width == 2 else "I"
        self.after: dict[str, bytes] = {}  # words after a blank
        self.first: dict[str, bytes] = {}  # words at the start of a line
        self.line = self.encode("\n")
        self.marks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a blank or nothing and letters below U+0250: one piece of the pre-tokenizer, so the model alone decides."""
        if word.isascii():
            shown = self.blank + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, word: str, lead: str) -> bytes:
        """A word of letters with marks behind it is two pieces of the pre-tokenizer; the library cuts all others."""
        core = word.rstrip(MARKS)
        if core.isalpha() and max(core) < LETTERS_END:
            mark = word[len(core):]
            known = self.marks.get(mark)
            if known is None:
                if len(self.marks) >= CACHE_WORDS:
                    self.marks.clear()
                known = self.marks[mark] = self.encode(mark)
            return self._letters(lead + core) + known
        return self.encode(lead + word)

    def _fill(self, ids: list, words: list[str]) -> None:
        """Encode and remember the words of a line that no cache holds."""
        for i, known in enumerate(ids):
            if known is None:
                cache, lead = (self.after, " ") if i else (self.first, "")
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                ids[i] = cache[words[i]] = self._piece(words[i], lead)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or not is_plain(text) or any(t in text for t in self.added):
            return self.encode(text)
        out, find = [], self.after.get
        for line in text.split("\n"):
            words = line.split(" ")
            ids = list(map(find, words))
            ids[0] = self.first.get(words[0])
            if None in ids:
                self._fill(ids, words)
            out.append(b"".join(ids))
        return self.line.join(out)


def is_plain(text: str) -> bool:
    """Every white space is one blank or one line end between two other characters."""
    return not (
        text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACES)))


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def _open(uri: str, mode: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if mode == "w" else system.open_input_file(path)


def _writer(root: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(path), TaskContext.get()
        end = np.array([end_id], encode.kind).tobytes()
        name = f"{root}/{context.partitionId():06d}-{uuid.uuid4().hex}"
        records = index = None
        offset = ids_before = n_docs = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if records is None:
                    records, index = _open(f"{name}.rec", "w"), _open(f"{name}.idx", "w")
                data = encode(text.as_py()) + end
                record = frame(pack(doc_id, encode.width, data))
                records.write(record)
                index.write(struct.pack("<QQ", offset, ids_before))
                offset += len(record)
                ids_before += len(data) // encode.width
                n_docs += 1
        if records is not None:
            records.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": context.partitionId(), "name": name, "n_docs": n_docs, "n_ids": ids_before, "n_bytes": offset}])

    return write


def write_records(docs: DataFrame, root: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards below ``root``, a folder all executors reach; returns the manifest, one row a shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    _make(root)
    return common.cut_lineage(rows.mapInArrow(
        _writer(root, path, end_id), "shard long, name string, n_docs long, n_ids long, n_bytes long"), "manifest")


def _make(root: str) -> None:
    system, path = pafs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)


def read_shard(name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    with _open(f"{name}.rec", "r") as stream:
        while (payload := unframe(stream)) is not None:
            yield unpack(payload)


def read_index(name: str) -> np.ndarray:
    """One row per record: offset of its frame, ids before it."""
    with _open(f"{name}.idx", "r") as stream:
        return np.frombuffer(stream.read(), "<u8").reshape(-1, 2)


def read_at(name: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset, for reads in shuffled order."""
    with _open(f"{name}.rec", "r") as stream:
        stream.seek(int(offset))
        return unpack(unframe(stream))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    kinds = [pa.int64()] * 4

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for shard in batch.to_pylist():
            rows = []
            places = iter(read_index(shard["name"])[:, 1].tolist())
            for (doc_id, ids), before in zip(read_shard(shard["name"]), places, strict=True):
                rows.append((doc_id, shard["start"] + before, len(ids), zlib.crc32(ids.tobytes())))
                if len(rows) == 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The window numbers the shards, one row each.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    shards = manifest.select("shard", "name", before.alias("start"))
    spread = max(2, manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return shards.repartition(spread).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = PATH) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_records(docs: DataFrame, path: str | None = None) -> DataFrame:
    root = shared_dir(docs.sparkSession, "records")
    return read_back(write_records(docs, root, path or tokenizer_path()))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_binary": op9_token_binary}
ORACLES: dict[str, str] = {}
