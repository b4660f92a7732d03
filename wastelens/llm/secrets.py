"""Secret scans: fixed patterns, and two character Markov models compared by their log-likelihood ratio.

* Base kinds are fixed by the contract: ``assign`` (a named value), ``access`` (key ids) and ``hex`` (long hexadecimal runs), leftmost and non-overlapping
  per kind, failing matches dropped without another try. Offsets count code points, the end is exclusive.
* Labelled samples: the values that base patterns find are random strings, joined by ``SEEDED`` strings drawn from a seeded
  generator over the alphabets keys are written in; tokens without a base match are ordinary identifiers, but for those that could
  be a secret themselves, which have no label. Transition counts of both cover the
  whole corpus; they are sums over pairs of character classes, so a task sends one fixed-size row however much it read.
* A token of ``TOKEN`` characters that no base span touches is a secret (kind ``random``) if the ratio is at least ``PER_STEP`` per
  transition, and it mixes digits with letters. So words and names stay alone.
* A null text counts as empty and has no spans; repeated rows get equal rows; no rows give no rows, and with no
  ordinary tokens in the corpus the seeded strings alone decide.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common

# Fixed values of the contract: patterns and least lengths.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex"]
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

WORDS = ("passw", "secret", "token", "api")  # one of them stands in every assignment
TOKEN = 16
TOKENS = re.compile(rf"[A-Za-z0-9+/_=-]{{{TOKEN},}}")
IDENTIFIERS = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
PER_STEP = 3.0
PRIOR = 10.0  # transitions' worth of the single-character shares
SEEDED = 400
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SIZE = len(ALPHABET) + 2  # all other characters, and the edge of a token
EDGE = SIZE - 1
_CLASS = np.full(256, SIZE - 2, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CLASS[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if TOKENS.search(text):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(tokens: list[str]) -> np.ndarray:
    """Counts of (class, next class) over the tokens, both edges included."""
    codes = np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("ascii", "replace"), np.uint8)
    classes = _CLASS[codes]
    classes[codes == 10] = EDGE
    return np.bincount(classes[:-1] * SIZE + classes[1:], minlength=SIZE * SIZE)


def seeded(n: int = SEEDED) -> list[str]:
    draw = random.Random(20_107)
    alphabets = [string.hexdigits[:16], string.hexdigits[:10] + "ABCDEF", string.ascii_letters + string.digits,
                 string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits]
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 48))) for i in range(n)]


def is_mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        random_, ordinary = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            at = 0
            for start, _, end, value in spans:
                random_.append(text[value:end])
                if start > at:
                    ordinary += IDENTIFIERS.findall(text, at, start)
                at = max(at, end)
            ordinary += IDENTIFIERS.findall(text, at)
        counts[0] += transitions(random_) if random_ else 0
        ordinary = [t for t in ordinary if len(t) < TOKEN or not is_mixed(t)]  # candidates carry no label
        counts[1] += transitions(ordinary) if ordinary else 0
    model, step = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([
        pa.array(model, pa.int64()), pa.array(step, pa.int64()), pa.array(counts[model, step], pa.int64())], names=["model", "step", "n"])


class Ratio:
    """log P(next | class) under random strings minus the same under ordinary identifiers.

    Classes with few transitions lean on how often each character occurs at all.
    """

    def __init__(self, counts: np.ndarray):
        both = counts.reshape(2, SIZE, SIZE)
        alone = both.sum(axis=1) + 0.5
        alone = alone / alone.sum(axis=1, keepdims=True)
        logs = np.log((both + PRIOR * alone[:, None, :]) / (both.sum(axis=2, keepdims=True) + PRIOR))
        self.steps = (logs[0] - logs[1]).ravel()

    def per_step(self, token: str) -> float:
        classes = np.concatenate(([EDGE], _CLASS[np.frombuffer(token.encode("ascii", "replace"), np.uint8)], [EDGE]))
        return float(self.steps[classes[:-1] * SIZE + classes[1:]].mean())

    def is_secret(self, token: str) -> bool:
        return is_mixed(token) and self.per_step(token) >= PER_STEP


def fit(docs: DataFrame) -> Ratio:
    """Both models from all texts. The driver receives at most 2 * SIZE * SIZE sums."""
    rows = docs.select(common.text_or_empty().alias("text")).mapInArrow(_gather, "model long, step long, n long")
    counts = np.zeros((2, SIZE * SIZE))
    for r in rows.groupBy("model", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["model"], r["step"]] = r["n"]
    counts[0] += transitions(seeded())
    return Ratio(counts)


def secrets(text: str, ratio: Ratio) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans as (start, kind, end)."""
    base = base_spans(text)
    found = [(start, kind, end) for start, kind, end, _ in base]
    taken = iter([*base, (len(text) + 1, 0, 0, 0)])
    start, _, end, _ = next(taken)
    reached = 0  # the end of all base spans that start before the token's end
    for m in TOKENS.finditer(text):
        while start < m.end():
            reached = max(reached, end)
            start, _, end, _ = next(taken)
        if reached <= m.start() and ratio.is_secret(m.group()):
            found.append((m.start(), len(KINDS), m.end()))
    return base, [(start, [*KINDS, "random"][kind], end) for start, kind, end in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = secrets(text, shared.value)
                counts = [sum(b[1] == k for b in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(joined((s, KINDS[k], e) for s, k, e, _ in base).encode()).hexdigest()
                out.append((*counts, digest, joined(spans)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
