"""Quality rules: marks of single texts, and lines that recur across the documents of a host.

Marks of one text: words, code points in words, symbols, repeated lines, words in 5-word windows that
occur twice or more. Windows are found by hash and then compared word by word, so no mark depends on a hash.

Across documents: every line with a word is normalised (blanks to one space, A-Z to lower case, digits to 0) and
hashed. The lines of a host are counted over its *distinct texts*, so that exact copies of one page, which are
the business of deduplication, do not make its lines boilerplate. A line in more than
``max(min_texts, max_share * distinct texts of the host)`` texts is removed wherever it stands. A document that keeps fewer than
``MIN_WORDS`` words, or less than ``min_left`` of its words, is depleted and rejected.

* The host of ``documents`` is the column ``source``; rows without one share a host of their own.
* Null texts count as empty: no words, base rule failed. Rows without a word have no lines.
* Results depend on (host, text) alone, so repeated rows and equal texts of a host get equal results; null or
  repeated ids need no care. An empty table gives an empty result. Very long texts are one row's arrays.
* Lines, hosts and rows meet in joins on hashes. At most 1,000 keys can hold a thousandth of the rows each; those
  are broadcast, and what is left has no hot key (``common.skew_join``). Copies collapse in map-side aggregation.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common

BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"  # fixed by the contract
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
MIN_TEXTS = 5
MAX_SHARE = 0.05
MIN_LEFT = 0.5
MARKS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _words(line: Column) -> Column:
    """Words of a line: other blanks become spaces, then a plain split."""
    return F.filter(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), lambda w: w != "")


def normalised(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), string.ascii_uppercase + "123456789", string.ascii_lowercase + "0" * 9)


def _neighbours_equal(rows: Column, field: str) -> Column:
    """The entries of a sorted array of structs whose ``field`` equals that of an entry beside them."""
    return F.filter(rows, lambda r, k: (
        F.coalesce(F.get(rows, k - 1)[field] == r[field], F.lit(False)) | F.coalesce(F.get(rows, k + 1)[field] == r[field], F.lit(False))))


def _window_hash(hashes: Column) -> Column:
    n = F.size(hashes)
    at = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)])
    return F.when(n >= WINDOW, F.transform(F.slice(hashes, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), at)).otherwise(
        F.array().cast("array<bigint>"))


def _covered(places: Column) -> Column:
    """How many words the windows that start at the sorted ``places`` cover."""
    return F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])


def marks(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, _host, _text (128-bit key), the marks, and its lines as (hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("_host"),
        F.unhex(F.md5(text)).alias("_text"), text.alias("_t"),
        F.filter(F.split(text, "\n"), lambda x: _without(x, BLANK_CHARS) != "").alias("_with_words"))
    rows = rows.select(
        "doc_id", "_host", "_text",
        F.length(_without(F.col("_t"), BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_with_words") - F.size(F.array_distinct("_with_words"))).cast("long").alias("n_dup_lines"),
        F.transform("_with_words", _words).alias("_by_line"))
    rows = rows.select(
        "*", F.flatten("_by_line").alias("_words"),
        F.transform("_by_line", lambda w: F.struct(F.xxhash64(normalised(w)).alias("line"), F.size(w).alias("words"))).alias("_lines"))
    rows = rows.drop("_by_line").select(
        "*", F.size("_words").cast("long").alias("n_words"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    rows = rows.select("*", _window_hash(F.col("_hashes")).alias("_windows")).drop("_hashes")
    # only texts in which a window hash occurs twice are looked at closely: sort by hash, then compare the words themselves
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    hashed = F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", hashed.alias("_sorted")).drop("_windows")
    rows = rows.select("*", _neighbours_equal(F.col("_sorted"), "h").alias("_found")).drop("_sorted")
    spelled = F.sort_array(F.transform("_found", lambda r: F.struct(
        F.array_join(F.slice("_words", r["i"] + 1, WINDOW), " ").alias("w"), r["i"].alias("i"))))
    rows = rows.select("*", spelled.alias("_spelled")).drop("_found", "_words")
    places = F.sort_array(F.transform(_neighbours_equal(F.col("_spelled"), "w"), lambda r: r["i"]))
    return rows.select(
        "doc_id", "_host", "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(_covered(places), F.lit(0)).cast("long").alias("n_repeat_words"), "_lines")


def frequent_lines(stats: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE) -> DataFrame:
    """Lines above the limit of their host, and lines that many rows hold: _host, line, n_rows, frequent."""
    lines = stats.select("_host", "_text", F.explode("_lines").alias("_l")).select("_host", "_text", "_l.line")
    by_text = lines.groupBy("_host", "line", "_text").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = by_text.groupBy("_host", "line").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
    counts = common.cut_lineage(counts.filter(F.col("n_rows") > min_texts), "lines")
    texts = stats.groupBy("_host", "_text").agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    sizes = counts.groupBy("_host").agg(F.count(F.lit(1)).alias("_weight")).join(texts, "_host")
    limit = F.greatest(F.lit(float(min_texts)), F.lit(max_share) * F.col("_texts"))
    found = common.skew_join(counts, common.cut_lineage(sizes, "hosts"), ["_host"], "_weight")
    return found.select("_host", "line", "n_rows", (F.col("n_texts") > limit).alias("frequent"))


def removals(stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """One row per line of a document that goes: doc_id, _host, _text, line, words."""
    lines = stats.select("doc_id", "_host", "_text", F.explode("_lines").alias("_l")).select(
        "doc_id", "_host", "_text", "_l.line", "_l.words")
    total = lines.count()
    found = common.skew_join(lines, frequent, ["_host", "line"], "n_rows", total, F.col("frequent"))
    return found.filter("frequent").drop("n_rows", "frequent")


def judge(docs: DataFrame, host_col: str = "source", min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE,
          min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: doc_id, the marks, base_failed, kept, words_left (after the removal of frequent lines)."""
    stats = common.cut_lineage(marks(docs, host_col), "marks")
    gone = removals(stats, common.cut_lineage(frequent_lines(stats, min_texts, max_share), "frequent"))
    keys = ["doc_id", "_host", "_text"]
    one = stats.select(*keys, *MARKS, F.lit(0).cast("long").alias("_gone"), F.lit(1).alias("_rows"))
    other = gone.select(*keys, *[F.lit(None).cast("long").alias(m) for m in MARKS], F.col("words").cast("long").alias("_gone"), F.lit(0).alias("_rows"))
    rows = one.unionByName(other).groupBy(*keys).agg(
        *[F.max(m).alias(m) for m in MARKS], F.sum("_gone").alias("_gone"), F.sum("_rows").cast("int").alias("_rows"))
    left = F.col("n_words") - F.expr("_gone div _rows")  # rows that are equal throughout stand here once
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select("doc_id", *MARKS, "_rows", left.alias("words_left"), failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (F.col("words_left") >= MIN_WORDS) & (F.col("words_left") >= min_left * F.col("n_words"))
    return rows.select("*", kept.alias("kept"), F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_again")).select(
        "doc_id", *MARKS, "base_failed", "kept", "words_left")


def cleaned(docs: DataFrame, host_col: str = "source", min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with all rows and columns, frequent lines taken out of ``text``; null texts stay null."""
    stats = common.cut_lineage(marks(docs, host_col), "marks")
    gone = removals(stats, common.cut_lineage(frequent_lines(stats, min_texts, max_share), "frequent"))
    sets = gone.groupBy("doc_id", "_host", "_text").agg(F.collect_set("line").alias("_set")).select(
        F.col("doc_id").alias("_id"), F.col("_host").alias("_h"), F.col("_text").alias("_t"), "_set")
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = docs.select(common.whole_row(docs).alias("_row"))
    host = F.coalesce(F.concat(F.lit("="), F.col("_row").getField(host_col).cast("string")), F.lit(""))
    rows = rows.join(sets, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (host == F.col("_h")) & (F.unhex(F.md5(text)) == F.col("_t")), "left")
    stays = lambda x: (_without(x, BLANK_CHARS) == "") | ~F.array_contains(F.col("_set"), F.xxhash64(normalised(_words(x))))
    cut = F.when(F.col("_set").isNull(), F.col("_row.text")).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    return rows.select(F.col("_row").withField("text", cut).alias("_row")).select("_row.*")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLES = {"op13_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, t, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
k AS (SELECT *, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
      FROM n WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
c AS (SELECT source, norm, count(DISTINCT t) AS texts FROM k GROUP BY source, norm),
h AS (SELECT source, count(DISTINCT t) AS all_texts FROM d GROUP BY source),
f AS (SELECT c.source, c.norm FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE texts > greatest(5.0, 0.05 * all_texts)),
g AS (SELECT doc_id, sum(len(ws))::BIGINT AS gone FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.norm = f.norm GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i+4]) AS times FROM x),
z AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 4)) AS p FROM y WHERE times > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM z GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(w.ws) - coalesce(gone, 0) AS words_left
      FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left >= 10 AND words_left >= 0.5 * n_words AS kept, words_left FROM b"""}
