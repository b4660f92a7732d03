"""Alignment of two tokenizers over the same texts: byte-exact groups, links and corpus-wide link counts.

A byte-level BPE of the tokenizers library (A) reads space + text; a sentencepiece model (B) reads the text and adds the space itself.

* Coarse cuts: the character offsets of A and the spans of B's proto. A character offset is a byte offset where the character
  ends with the token. Tokens that end inside a character share its offset, and all but the last byte-fallback token of a character
  have an empty span; their ends are refined with the lengths of their decoded bytes.
* A text whose decoded tokens of either side do not spell space + text (B knows no U+2581 beside the blank) has no tokens; neither
  has a null or empty one: zeros, and '' in place of the digest. Rows are taken one by one, so repeated rows and
  repeated or null ids need no care. An empty table gives an empty result. Texts of any length are aligned whole.
* Texts are cut before a lone blank or line end between two characters that are no white space. Neither tokenizer has a token
  across such a cut (A's pre-tokenizer cuts there; that no piece of B holds a blank or line end behind another character is
  looked up, and if one does, texts stay whole), so the parts align on their own, and parts met before come from a bounded cache.
  New parts are encoded in runs of ``RUN`` with such cuts between them; a run that its tokens do not spell is taken apart.
* Link counts: a task packs its rows into chunks, each with the list of its parts, the parts of its documents and the sum of every pair of ids.
  The sums of all chunks are added, every chunk gets back the counts of its own pairs, and the documents are summed inside their
  chunk. So a pair is one row a chunk, however many links hold it, and no vocabulary table is broadcast. The best count of a B id is taken over
  at most as many pairs as A has ids. Chunks are written before they are read again, so a lost executor repeats only its own.
* A chunk takes megabytes, its pairs a fraction of that. So a task writes its chunks one behind the other to a file of its own attempt in the
  shared folder, and Spark's rows hold the pairs, the sums and the place in that file: a chunk is never shuffled, sorted or read beside
  others, and is opened once, alone, where the counts of its pairs arrive. Only files that a committed row names count.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wastelens.llm import common, token_binary
from wastelens.session import shared_dir

PATH_A, PATH_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE_PARTS = 250_000  # parts a worker remembers, some 400 bytes each
CACHE_CHARS = 5_000_000  # and their characters
CHUNK_PARTS = 500_000  # parts of a chunk's documents, 4 bytes each, unless one document alone has more
CHUNK_DOCS = 50_000
SLICE = 32  # documents whose new parts are learnt together
UNSURE = "\u180e\u200b\ufeff"  # white space to some libraries; no cut beside them
CUT = re.compile(rf"(?<=[^\s{UNSURE}])(?=[ \n][^\s{UNSURE}])")
SOLID = re.compile(rf"[ \n][^\s{UNSURE}](?:.*[^\s{UNSURE}])?", re.DOTALL)  # a part with a cut before it and behind it
RUN = 32  # new parts that are encoded as one text, where there are cuts between them
BLANK = "▁"
MARKS = ["", ",", ";", "|"]  # before a token of a spelled group
SPAN = attrgetter("id", "begin", "end")
_state: dict = {}  # of this Python worker


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping (A, B) positions of two cuts of the same bytes, one pair for every end of either, and whether both end there."""
    ends = np.union1d(a_ends, b_ends)
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return i, j, (a_ends[i] == ends) & (b_ends[j] == ends)


def links(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Overlapping (A, B) positions as a list, and the positions behind each common end."""
    i, j, shared = overlaps(np.array(a_ends, "i8"), np.array(b_ends, "i8"))
    return list(zip(i.tolist(), j.tolist(), strict=True)), list(zip((i[shared] + 1).tolist(), (j[shared] + 1).tolist(), strict=True))


def refined(coarse: np.ndarray, exact: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse cut where it is exact, else the last exact one plus the sizes of the decoded tokens since."""
    lengths = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(exact, np.arange(len(exact)), -1))
    return lengths + np.where(last >= 0, (coarse - lengths)[last], 0)


def flat(nested, width: int) -> np.ndarray:
    """Rows of ``width`` numbers from tuples of numbers in lists."""
    return np.fromiter(chain.from_iterable(chain.from_iterable(nested)), "i8").reshape(-1, width)


class Aligner:
    """Parts of texts to rows of a table that this worker keeps: groups as text, sizes, linked ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in token_binary.byte_letters().items()}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                        for t, i in self.a.get_vocab().items()}
        self.a_bytes |= {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, "i8")
        self.a_sizes[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_sizes = np.fromiter(map(len, self.b_bytes), "i8", len(pieces))
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.vocabulary = max(max(self.a_bytes) + 1, len(pieces))
        self.names = [mark + str(i) for mark in MARKS for i in range(self.vocabulary)]
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.sizes = array("i")  # n_a, n_b, n_groups, n_links of every row
        self.pairs: list[bytes] = []  # linked ids, 8 bytes each
        self.bad: set[int] = set()
        self.uses = np.zeros(0, "i8")  # of every row, as far as packed

    def count(self, rows: np.ndarray, times: np.ndarray) -> None:
        uses = np.zeros(len(self.groups), "i8")
        uses[:len(self.uses)] = self.uses
        uses[rows] += times
        self.uses = uses

    def shrink(self) -> None:
        """Forget the parts that were met once, or all if that leaves the table half full. Rows change their numbers."""
        rows, groups, sizes, pairs, bad, uses = self.rows, self.groups, self.sizes, self.pairs, self.bad, self.uses
        kept = [(name, i) for name, i in rows.items() if i < len(uses) and uses[i] > 1]
        self.clear()
        if len(kept) <= CACHE_PARTS // 2 and (chars := sum(len(name) for name, _ in kept)) <= CACHE_CHARS // 2:
            self.chars = chars
            for name, i in kept:
                if i in bad:
                    self.bad.add(len(self.groups))
                self.rows[name] = len(self.groups)
                self.groups.append(groups[i])
                self.sizes.extend(sizes[4 * i:4 * i + 4])
                self.pairs.append(pairs[i])

    def full(self) -> bool:
        return len(self.rows) >= CACHE_PARTS or self.chars >= CACHE_CHARS

    def parts(self, text: str) -> list[str]:
        """The parts in order. One behind a blank is named without it, unless it starts with a blank or line end itself; the first part
        stands behind the blank that both tokenizers see before the text."""
        if self.cuts and token_binary.is_plain(text) and (text.isascii() or not any(c in text for c in UNSURE)):
            return text.replace("\n", " \n").split(" ")  # every blank and line end is a cut
        out = CUT.split(text) if self.cuts else [text]
        first = " " + out[0] if out[0][0] in " \n" else out[0]
        return [first, *[p[1:] if p[0] == " " else p for p in out[1:]]]

    def learn(self, new: list[str]) -> None:
        """Align parts that the cache does not hold. The table holds no cycles, so the collector rests while it grows."""
        gc.disable()
        try:
            self._learn(new)
        finally:
            gc.enable()

    def _learn(self, new: list[str], run: int = RUN) -> None:
        solid, other = [], []
        for name in new:
            part = name, name if name[0] in " \n" else " " + name
            (solid if SOLID.fullmatch(part[1]) else other).append(part)
        runs = [solid[k:k + run] for k in range(0, len(solid), run)] + [[part] for part in other]
        texts = ["".join([t for _, t in r]) for r in runs]
        raws = [t.encode() for t in texts]
        encoded = self.a.encode_batch(texts, add_special_tokens=False)
        protos = self.b.encode([t[1:] if t[0] == " " else t for t in texts], return_type="proto", num_threads=1)
        a = [e.ids for e in encoded]
        # a text that starts with a line end loses the blank that sentencepiece adds
        pieces = [p.pieces if t[0] == " " else p.pieces[1:] if p.pieces[0].piece == BLANK else [] for t, p in zip(texts, protos, strict=True)]
        b = [list(map(SPAN, p)) for p in pieces]
        spell_a, spell_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [b"".join(map(spell_a, x)) == raw == b"".join([spell_b(i) for i, _, _ in y]) for x, y, raw in zip(a, b, raws, strict=True)]
        if any(good):
            kept, a, encoded, b = ([v for v, ok in zip(values, good, strict=True) if ok] for values in (runs, a, encoded, b))
            groups, sizes, pairs = self.aligned([[t.encode() for _, t in r] for r in kept], a, [e.offsets for e in encoded], b)
            names = [name for r in kept for name, _ in r]
            self.rows.update(zip(names, range(len(self.groups), len(self.groups) + len(names)), strict=True))
            self.chars += sum(map(len, names))
            self.groups.extend(groups)
            self.sizes.frombytes(sizes.astype("i4").tobytes())
            self.pairs.extend(pairs)
        for r in (r for r, ok in zip(runs, good, strict=True) if not ok):
            if len(r) > 1:
                self._learn([name for name, _ in r], 1)  # finds the part that the tokens do not spell
                continue
            self.rows[r[0][0]] = len(self.groups)
            self.chars += len(r[0][0])
            self.bad.add(len(self.groups))
            self.groups.append("")
            self.sizes.extend((0, 0, 0, 0))
            self.pairs.append(b"")

    def aligned(self, runs: list[list[bytes]], a: list[list[int]], offsets: list[list[tuple[int, int]]],
                b: list[list[tuple[int, int, int]]]) -> tuple[list[str], np.ndarray, list[bytes]]:
        """Groups as text, sizes and linked ids of the parts of runs whose tokens spell them, from the ids and character offsets of A and
        the ids and byte spans of B. All are aligned at once, as one text in which every part is a common end of both sides."""
        raws = list(chain.from_iterable(runs))
        n, starts = len(raws), _running(np.fromiter(map(len, raws), "i8", len(raws)))
        text = np.frombuffer(b"".join(raws), "u1")
        chars = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))  # byte offsets of characters
        run_starts = starts[_running(np.fromiter(map(len, runs), "i8", len(runs)))[:-1]]
        run_a, run_b = (np.repeat(run_starts, np.fromiter(map(len, x), "i8", len(runs))) for x in (a, b))
        a_ids, (b_ids, b_from, b_to) = np.fromiter(chain.from_iterable(a), "i8"), flat(b, 3).T
        a_from, a_to = (flat(offsets, 2) + np.searchsorted(chars, run_a)[:, None]).T
        following = np.append(a_from[1:], len(chars) - 1)  # a next token that starts before this one's end shares its last character
        a_ends = refined(chars[a_to], following >= a_to, self.a_sizes[a_ids])
        b_ends = refined(b_to + run_b + (text[run_b] == 32), b_to > b_from, self.b_sizes[b_ids])
        part_a, part_b = (np.searchsorted(starts[1:], x) for x in (a_ends, b_ends))
        n_a, n_b = (np.bincount(x, minlength=n) for x in (part_a, part_b))
        i, j, shared = overlaps(a_ends, b_ends)
        common_ends, link_part = a_ends[i[shared]], part_a[i]
        n_links, n_groups = np.bincount(link_part, minlength=n), np.bincount(link_part[shared], minlength=n)
        # a group's tokens of A, then those of B, each behind its mark
        group_a, group_b = np.searchsorted(common_ends, a_ends), np.searchsorted(common_ends, b_ends)
        new_a, new_b, new_part = (np.diff(x, prepend=-1) != 0 for x in (group_a, group_b, part_a))
        marked = np.empty(len(a_ids) + len(b_ids), "i8")
        marked[np.arange(len(a_ids)) + np.searchsorted(group_b, group_a)] = a_ids + self.vocabulary * np.where(new_part, 0, np.where(new_a, 2, 1))
        marked[np.arange(len(b_ids)) + np.searchsorted(group_a, group_b, "right")] = b_ids + self.vocabulary * np.where(new_b, 3, 1)
        words = list(map(self.names.__getitem__, marked.tolist()))
        groups = ["".join(words[s:e]) for s, e in pairwise(_running(n_a + n_b).tolist())]
        linked = (a_ids[i] << 32 | b_ids[j]).tobytes()
        pairs = [linked[s:e] for s, e in pairwise((8 * _running(n_links)).tolist())]
        return groups, np.stack([n_a, n_b, n_groups, n_links], axis=1), pairs

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        """Table rows of each text's parts in order; none if it has no tokens. Parts new to the table are learnt together."""
        parts = [self.parts(t) if t else [] for t in texts]
        at = [list(map(self.rows.get, p)) for p in parts]
        late = [i for i, rows in enumerate(at) if None in rows]
        if late:
            self.learn(list(dict.fromkeys([p for i in late for p, row in zip(parts[i], at[i], strict=True) if row is None])))
            for i in late:
                at[i] = list(map(self.rows.get, parts[i]))
        return [[] if self.bad and not self.bad.isdisjoint(rows) else rows for rows in at]

    def text_of(self, at: list[int]) -> str:
        return ";".join(map(self.groups.__getitem__, at))


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _state:
        _state[path_a, path_b] = Aligner(path_a, path_b)
    return _state[path_a, path_b]


SIZES = ["n_a", "n_b", "n_groups", "n_links"]
CHUNK_KINDS = pa.schema([
    ("doc_id", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string())), ("n_parts", pa.list_(pa.int32())),
    *[(c, pa.list_(pa.int64())) for c in SIZES], ("parts", pa.binary()), ("part_counts", pa.binary()), ("part_pairs", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])
STORED = [c for c in CHUNK_KINDS.names if c not in ("pairs", "totals")]  # in a file; the others are columns of Spark's rows
TASK_CHUNKS = 1 << 32  # numbers of a task's chunks
PLACE = "chunk long, name string, start long, size long, pairs array<long>, totals array<long>"
PLACE_KINDS = pa.schema([("chunk", pa.int64()), ("name", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
                         ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype="i8")])


def _by_document(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring ends."""
    sums = _running(values)
    return sums[ends[1:]] - sums[ends[:-1]]


def _packed(table: Aligner, ids: list, digests: list, n_parts: list, parts: array) -> pa.RecordBatch:
    """One chunk: sizes of its documents, its parts numbered anew by falling use, their linked ids, and how often every pair of ids is linked.

    The numbers of the parts are laid out byte by byte, first all lowest bytes, so that the many small ones compress."""
    used, local, uses = np.unique(np.frombuffer(parts, "i4"), return_inverse=True, return_counts=True)
    table.count(used, uses)
    sizes, ends = np.frombuffer(table.sizes, "i4").reshape(-1, 4)[np.frombuffer(parts, "i4")], _running(np.array(n_parts, "i8"))
    order = np.argsort(-uses, kind="stable")
    place = np.empty(len(used), "<u4")
    place[order] = np.arange(len(used))
    used, uses = used[order], uses[order]
    raw = [table.pairs[i] for i in used.tolist()]
    counts = np.array([len(r) // 8 for r in raw], "i4")
    pairs = np.frombuffer(b"".join(raw), "<i8")
    distinct, at = np.unique(pairs, return_inverse=True)
    totals = np.bincount(at, weights=np.repeat(uses, counts), minlength=len(distinct)).astype("i8")  # below 2**53 in one chunk
    planes = np.ascontiguousarray(place[local].view("u1").reshape(-1, 4).T)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([
        ids, digests, n_parts, *[_by_document(c, ends) for c in sizes.T], planes.tobytes(),
        counts.tobytes(), pairs.tobytes(), distinct, totals], CHUNK_KINDS, strict=True)], schema=CHUNK_KINDS)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _chunker(path_a: str, path_b: str):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(path_a, path_b)
        ids, digests, n_parts, parts = [], [], [], array("i")
        for some in slices(batches):
            for at in table(some.column(1).to_pylist()):
                digests.append(hashlib.sha256(table.text_of(at).encode()).hexdigest() if at else "")
                n_parts.append(len(at))
                parts.extend(at)
            ids.extend(some.column(0).to_pylist())
            if len(parts) >= CHUNK_PARTS or len(ids) >= CHUNK_DOCS or table.full():
                yield _packed(table, ids, digests, n_parts, parts)
                ids, digests, n_parts, parts = [], [], [], array("i")
                if table.full():
                    table.shrink()
        if ids:
            yield _packed(table, ids, digests, n_parts, parts)

    return chunks


def _bytes(chunk: pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(chunk)
    return sink.getvalue()


def _stored(name: str, start: int, size: int) -> pa.RecordBatch:
    system, path = pafs.FileSystem.from_uri(name)
    with system.open_input_file(path) as file, pa.ipc.open_stream(file.read_at(size, start)) as stream:
        return stream.read_next_batch()


def _writer(root: str, path_a: str, path_b: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, start = None, f"{root}/{uuid.uuid4().hex}", 0
        first = TaskContext.get().partitionId() * TASK_CHUNKS  # one attempt of a partition is committed
        for number, chunk in enumerate(_chunker(path_a, path_b)(batches), first):
            if file is None:
                system, path = pafs.FileSystem.from_uri(name)
                file = system.open_output_stream(path)
            data = _bytes(chunk.select(STORED))
            file.write(data)
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([name]), pa.array([start]), pa.array([data.size]), chunk.column("pairs"), chunk.column("totals")],
                schema=PLACE_KINDS)
            start += data.size
        if file is not None:
            file.close()

    return write


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every document of a chunk, by running sums over its parts."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = _stored(*(batch.column(c)[row].as_py() for c in ("name", "start", "size")))
            get = lambda name: chunk.column(name)[0]  # noqa: B023, E731
            planes = np.frombuffer(get("parts").as_py(), "u1").reshape(4, -1)
            local = np.ascontiguousarray(planes.T).view("<u4").ravel()
            pairs = np.frombuffer(get("part_pairs").as_py(), "<i8")
            part_ends = _running(np.frombuffer(get("part_counts").as_py(), "<i4"))
            known = batch.column("known")[row].values
            if known is None:
                known = pa.array([], pa.struct([("pair", pa.int64()), ("n", pa.int64()), ("best", pa.bool_())]))
            pair, n = (known.field(f).to_numpy() for f in ("pair", "n"))
            best = known.field("best").to_numpy(zero_copy_only=False)
            order = np.argsort(pair)
            at = order[np.searchsorted(pair, pairs, sorter=order)] if len(pairs) else np.zeros(0, "i8")
            ends = _running(get("n_parts").values.to_numpy())
            columns = [_by_document(_by_document(v, part_ends)[local], ends) for v in (best[at].astype("i8"), n[at])]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(
                [get("doc_id").values, *[get(c).values for c in SIZES], *columns, get("groups_sha256").values], kinds, strict=True)], names=names)


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Where every chunk is stored, its pairs and their sums."""
    root = shared_dir(docs.sparkSession, "alignment")
    system, path = pafs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.cut_lineage(rows.mapInArrow(_writer(root, path_a, path_b), PLACE), "alignment")


def link_counts(packed: DataFrame) -> DataFrame:
    """One row per linked pair of ids: pair (A id * 2**32 + B id), n (links that hold it), best (no pair of its B id has more)."""
    sums = packed.select(F.explode(F.arrays_zip("pairs", "totals")).alias("_p")).groupBy(F.col("_p.pairs").alias("pair")).agg(
        F.sum("_p.totals").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    packed = chunks(docs, path_a or token_binary.tokenizer_path(PATH_A), path_b or token_binary.tokenizer_path(PATH_B))
    wanted = packed.select("chunk", F.explode("pairs").alias("pair"))
    known = wanted.join(link_counts(packed), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "n", "best")).alias("known"))
    return packed.drop("pairs", "totals").join(known, "chunk", "left").mapInArrow(_sums, OUT)


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The alignment itself: doc_id and ``groups``, ``a1,a2|b1;a3|b2,b3`` (null without tokens)."""
    path_a, path_b = path_a or token_binary.tokenizer_path(PATH_A), path_b or token_binary.tokenizer_path(PATH_B)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(path_a, path_b)
        for some in slices(batches):
            out = [table.text_of(at) if at else None for at in table(some.column(1).to_pylist())]
            if table.full():
                table.clear()
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.string())], names=["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(spell, "doc_id long, groups string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(common.table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
