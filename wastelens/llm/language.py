"""Language identification by words first, then by ever shorter character n-grams.

* A word is a run of letters in lower case. The score of a known word is, per language, the negative logarithm of its relative
  frequency there; a language that has not seen it gives ``PENALTY``. A word that no language knows is scored by its n-grams of
  length ``MAX_GRAM`` (blanks stand for its two ends), as the mean over those that are known; where none is, by those
  one shorter, and so on. The score of a text is the mean over all its words, the smallest wins, ties go to the
  smaller language name.
* ``score`` is the winner's share of exp(-mean * words), with the number of words held at ``CERTAIN_WORDS``.
* A text that is null or has no letter is ``und`` with score 0. Rows are independent: repeated rows get the same answer,
  no rows give no rows. Without labelled rows every text is ``und``.
* The model is fitted on a sample of about ``SAMPLE_DOCS`` *distinct* whole texts a language, drawn by a hash of the text; a text
  counts once however many copies it has. That bound, not the corpus, sets the size of what is broadcast. Counting is a Spark
  aggregation with partial sums. ``LANGUAGES`` bounds the names the model learns: the most frequent ones, ties to the smaller name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.llm import common

SAMPLE_DOCS = 400
LANGUAGES = 1000
MAX_GRAM = 5
PENALTY = 16.0
CERTAIN_WORDS = 20
CACHE_WORDS = 200_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")  # with some numbers, such as fractions and Roman numerals


def words_of(text: str | None) -> list[str]:
    """Runs of characters that are letters (``str.isalpha``)."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count) of a part of the sample; n is 0 for whole words."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        for lang, known in words.items():
            counts: Counter = Counter()
            for word, times in known.items():
                counts[0, word] += times
                for n in range(1, MAX_GRAM + 1):
                    for g in grams(word, n):
                        counts[n, g] += times
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(keys)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys]),
                pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "n", "gram", "times"])


def sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> DataFrame:
    """About that many distinct rows (lang, text) a language, the same in each run.

    A text is known by a 64-bit hash while distinct texts are counted; copies meet map-side, so a text that fills
    a third of the table is one row a task. Only drawn texts are compared whole.
    """
    draw = F.xxhash64(F.lit("language"), "text")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", draw.alias("draw"))
    counted = rows.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("copies")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"))
    sizes = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("rows"), "lang").limit(languages).collect()}
    if not sizes:
        return rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, docs_per_language / n)])
    part = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    return rows.filter(part < F.element_at(share, F.col("lang"))).select("lang", "text").distinct()


class Model:
    """Costs per language of words and n-grams, a row of a matrix each."""

    def __init__(self, counts: pa.Table, penalty: float = PENALTY):
        """``counts``: lang, n, gram, times, one row per language and gram."""
        self.penalty = penalty
        self.languages = sorted(counts.column("lang").unique().to_pylist())
        at = {lang: i for i, lang in enumerate(self.languages)}
        langs = np.array([at[x] for x in counts.column("lang").to_pylist()], np.int64)
        n, times = counts.column("n").to_numpy(), counts.column("times").to_numpy()
        totals = np.zeros((len(at), MAX_GRAM + 1))
        np.add.at(totals, (langs, n), times)
        self.known: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        rows = np.empty(len(n), np.int64)
        size = 0
        for i, (kind, gram) in enumerate(zip(n.tolist(), counts.column("gram").to_pylist(), strict=True)):
            rows[i] = self.known[kind].setdefault(gram, size)
            size = max(size, int(rows[i]) + 1)
        self.costs = np.full((size, len(at)), penalty)
        if size:
            self.costs[rows, langs] = np.minimum(penalty, -np.log(times / totals[langs, n]))

    def unseen(self, word: str) -> np.ndarray:
        for n in range(MAX_GRAM, 0, -1):
            known = self.known[n]
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return self.costs[found].mean(axis=0)
        return np.full(len(self.languages), self.penalty)

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        known, rows, times, other = self.known[0], [], [], np.zeros(len(self.languages))
        for word, n in Counter(words).items():
            row = known.get(word)
            if row is not None:
                rows.append(row)
                times.append(n)
            else:
                cost = cache.get(word)
                if cost is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cost = cache[word] = self.unseen(word)
                other += n * cost
        mean = (np.array(times, np.float64) @ self.costs[rows] + other) / len(words) if rows else other / len(words)
        best = int(mean.argmin())
        odds = np.exp((mean[best] - mean) * min(len(words), CERTAIN_WORDS))
        return self.languages[best], float(1 / odds.sum())


def fit(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> Model:
    counts = sample(labelled, docs_per_language).mapInArrow(_count, "lang string, n long, gram string, times long")
    counts = counts.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    return Model(counts.select("lang", "n", "gram", "times").toArrow())


def identified(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two further columns, from its column text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            found = [own.predict(t, cache) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identified(texts, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
