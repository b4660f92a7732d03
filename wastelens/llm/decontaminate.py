"""Benchmark decontamination with a generalised suffix automaton of the test items.

* Words are runs of digits, letters a-z (A-Z lowered) and characters outside ASCII. A window is ``window``
  consecutive words of one item; an item with fewer words, but not none, is one window as a whole.
* A document's words run through the automaton, which keeps the longest suffix that occurs in an item.
  Where that is at least one window long, all words of the match are hit.
* Null texts have no words. Items without words match nothing; the same item twice counts twice, under
  each id. No items: nothing is hit. No documents: an empty result.
* The items are a stated query set. They are dealt into blocks of at most ``BLOCK_WORDS`` words, one automaton
  each, so what is sent to the executors at once is bounded however many items there are; every
  document runs through every block. Documents stay where they are read: there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.llm import common

WINDOW = 10
BLOCK_WORDS = 200_000
MAX_COVERAGE = 0.5
NOT_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes(32 if c in NOT_WORD else c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLACES = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """All substrings of the items' word sequences. State 0 is the empty match."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        coded = []
        for item, words in items:
            if words:
                coded.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, ids in coded:
            last = 0
            for i in ids:
                last = self._extend(last, i)
        self.items: dict[int, set[str]] = {}  # states that end a window of full length
        self.short: dict[int, list[tuple[int, str]]] = {}  # states that end a whole short item
        for item, ids in coded:
            if len(ids) < window:
                self.short.setdefault(self._walk(ids), []).append((len(ids), item))
                self.shortest = min(self.shortest, len(ids))
            else:
                for _, state in self.windows(ids):
                    self.items.setdefault(state, set()).add(item)

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if symbol in nxt[last]:  # this prefix is known from an earlier item
            known = nxt[last][symbol]
            return known if length[known] == length[last] + 1 else self._split(last, symbol, known)
        state = self._new(length[last] + 1, {}, 0)
        while last >= 0 and symbol not in nxt[last]:
            nxt[last][symbol] = state
            last = link[last]
        if last >= 0:
            known = nxt[last][symbol]
            link[state] = known if length[known] == length[last] + 1 else self._split(last, symbol, known)
        return state

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, last: int, symbol: int, known: int) -> int:
        copy = self._new(self.length[last] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = copy
        while last >= 0 and self.next[last].get(symbol) == known:
            self.next[last][symbol] = copy
            last = self.link[last]
        return copy

    def _walk(self, ids: list[int]) -> int:
        state = 0
        for i in ids:
            state = self.next[state][i]
        return state

    def windows(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(end, state) of every place where the longest match is a window or more, the state being that of the window."""
        for end, state, matched in self.matches(ids):
            if matched >= self.window:
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                yield end, state

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest matching length) for every word."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for place, symbol in enumerate(ids):
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                matched += 1
            yield place, state, matched

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [from, to) that lie in windows, and the items those windows belong to."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        for k in np.flatnonzero(np.diff(edges) > self.shortest):  # a match never holds an unknown word
            low, high = int(edges[k]) + 1, int(edges[k + 1])
            for place, state, matched in self.matches(ids[low:high].tolist()):
                if matched < self.shortest:
                    continue
                end = low + place + 1
                if matched >= self.window:
                    spans.append((end - matched, end))
                s = state
                while s > 0:
                    if s in self.items and matched >= self.window:
                        found |= self.items[s]
                    for size, item in self.short.get(s, ()):
                        if size <= matched:
                            spans.append((end - size, end))
                            found.add(item)
                    s = self.link[s]
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


class Detector:
    """The automata of all blocks; an executor builds them from the items' words when it first needs them."""

    def __init__(self, spark: SparkSession, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
        blocks: list[list[tuple[str, list[bytes]]]] = [[]]
        size = 0
        rows = items.select(F.col("item_id").cast("string"), "text").orderBy("item_id")
        self.blocks = []
        for item, text in rows.toLocalIterator():
            words = words_of(text)
            if size and size + len(words) > block_words:
                self.blocks.append(spark.sparkContext.broadcast((window, blocks.pop())))
                blocks.append([])
                size = 0
            blocks[0].append(("" if item is None else item, words))
            size += len(words)
        self.blocks.append(spark.sparkContext.broadcast((window, blocks[0])))

    def __getstate__(self):
        return {"blocks": self.blocks}

    def hits_of(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: number of words, hit word ranges, items. Block after block, so that one automaton is held at a time."""
        words = [words_of(t) for t in texts]
        found = [([], set()) for _ in texts]
        for block in self.blocks:
            automaton = _automaton(block, keep=len(self.blocks) == 1)
            for i, w in enumerate(words):
                spans, items = automaton.hits(w)
                found[i][0].extend(spans)
                found[i][1].update(items)
        return [(len(w), merged(spans), items) for w, (spans, items) in zip(words, found, strict=True)]


_built: dict = {}


def _automaton(block, keep: bool) -> Automaton:
    key = block._path if hasattr(block, "_path") else id(block)
    if key not in _built:
        _built.clear()
        window, items = block.value
        _built[key] = Automaton(items, window)
    return _built[key]


def _digests(detector: Detector):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = detector.hits_of(batch.column(1).to_pylist())
            n_hit = [sum(b - a for a, b in spans) for _, spans, _ in hits]
            listed = [",".join(sorted(items)) for _, _, items in hits]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h[0] for h in hits], pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([len(h[2]) for h in hits], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]), pa.array([n > 0 for n in n_hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    detector = Detector(docs.sparkSession, items, window, block_words)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digests(detector), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    places = [m.span() for m in _PLACES.finditer(text)]
    out, at = [], 0
    for low, high in spans:
        out.append(text[at:places[low][0]])
        at = places[high - 1][1]
    return "".join([*out, text[at:]])


def _cleaner(detector: Detector, text_at: int, chars_at: int | None, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            keep = []
            changed = {}
            for i, (n_words, spans, _) in enumerate(detector.hits_of(texts)):
                n_hit = sum(b - a for a, b in spans)
                keep.append(not n_hit or n_hit <= max_coverage * n_words)
                if n_hit:
                    changed[i] = without(texts[i], spans)
            if changed:
                columns = list(batch.columns)
                columns[text_at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(text_at).type)
                if chars_at is not None:
                    counts = batch.column(chars_at).to_pylist()
                    columns[chars_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(counts)], batch.schema.field(chars_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without test items, its columns unchanged.

    Spans of at least one window are cut out of the text (``n_chars``, where there is such a column, follows);
    a document of which more than ``max_coverage`` of the words is hit goes as a whole. All other rows stay as they are.
    """
    detector = Detector(docs.sparkSession, items, window, block_words)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_cleaner(detector, text_at, chars_at, max_coverage), T.StructType(docs.schema.fields))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS body
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
seen AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS body
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT s.doc_id, s.k, s.p, win.item_id FROM seen s JOIN win ON s.k = win.k AND s.body = win.body),
places AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(found.s, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""}
