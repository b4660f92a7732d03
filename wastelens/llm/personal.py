r"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

* Base spans follow the fixed patterns of the contract and always stay. Further candidates come from looser patterns: written-out mail
  addresses, national telephone numbers, long addresses of the newer internet protocol, card numbers whose check digit fails.
* Votes (yes, no, none) on each candidate: ``regex`` (the strict pattern), ``gazetteer`` (domain endings, number ranges of issuers, area codes,
  public address ranges), ``context`` (cue words before the span), ``shape`` (check digits, groups of digits, characters around the span).
* EM runs per kind on the table of vote patterns, at most 3^4 rows a kind however large the corpus. Its posteriors are the soft labels of a
  naive Bayes classifier over span features; their sums are again a table of fixed size. A candidate is added where the
  classifier gives at least ``ADD`` and no base span overlaps it.
* DataFrame functions only. Offsets are found without leaving SQL: a match starts after the pieces that a split by the same
  pattern leaves before it. Offsets count code points. Patterns are possessive, so that long runs neither backtrack nor
  overflow the matcher's stack.
* A null text is empty. Repeated rows are told apart by a row number that is written once, and get equal results. No rows, no rows;
  without candidates the models are empty and nothing is added.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wastelens.llm import common

KINDS = ["email", "ip", "card", "phone"]
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# (kind, strict, a character that every match holds, pattern); the strict ones are the contract's
PATTERNS = [
    ("email", True, "@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++"),
    ("ip", True, ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, "", rf"(?<!{LOCAL}){LOCAL}++\x20?+(?:\(at\)|\[at\]|\{{at\}})\x20?+{DOMAIN}++(?:\x20?+(?:\.|\(dot\)|\[dot\]|\{{dot\}})\x20?+{DOMAIN}++)++"),
    ("phone", False, "", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    ("ip", False, ":", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
]
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|eu|de|fr|es|uk|it|nl|ch|at|us|ca|jp"
CUES = {
    "email": ("e-?mail|mail|contact|write to|reach|correo|courriel", "package|user-agent"),
    "ip": ("ip|address|host|server|client|gateway|from", "version|release|section|build|chapter"),
    "card": ("card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte", "isbn|order|invoice|tracking|serial"),
    "phone": ("tel|phone|call|fax|mobile|cell|t[ée]l[ée]phone|tel[ée]fono|anruf", "isbn|order|invoice|version|serial"),
}
LABELERS = ["regex", "gazetteer", "context", "shape"]
ROUNDS = 60
ADD = 0.9
CONTEXT = 32  # characters of context before a span


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _candidates(text: Column, name: str, needs: str, pattern: str, rows: DataFrame) -> DataFrame:
    """Add ``name``: array of (body, gap, before, after); gap is the number of characters since the match before."""
    there = text.contains(needs) if needs else text.rlike(pattern)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_m", F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    made = F.transform(F.col("_m"), lambda body, i: F.struct(
        body.alias("body"), F.length(F.get(F.col("_p"), i)).alias("gap"),
        F.right(F.get(F.col("_p"), i), F.lit(CONTEXT)).alias("before"), F.left(F.get(F.col("_p"), i + 1), F.lit(1)).alias("after")))
    return rows.withColumn(name, made).drop("_m", "_p")


def _numbered(name: str, pattern: int) -> Column:
    return F.transform(F.col(name), lambda c, k: F.struct(F.lit(pattern).alias("pattern"), k.alias("k"), c.alias("c")))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows (row, doc_id, arrays), and one row per match: row, kind, strict, start, end, body, before, after."""
    rows = docs.select("doc_id", common.text_or_empty().alias("_text"))
    names = [f"_c{i}" for i in range(len(PATTERNS))]
    for name, (_, _, needs, pattern) in zip(names, PATTERNS, strict=True):
        rows = _candidates(F.col("_text"), name, needs, pattern, rows)
    rows = common.cut_lineage(rows.drop("_text").withColumn("row", F.monotonically_increasing_id()), "candidates")
    every = F.concat(*[_numbered(n, i) for i, n in enumerate(names)])
    found = rows.filter(reduce(lambda a, b: a | b, [F.size(n) > 0 for n in names])).select("row", F.explode(every).alias("x")).select(
        "row", "x.pattern", "x.k", "x.c.*")
    so_far = Window.partitionBy("row", "pattern").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("body")).over(so_far)
    kind, strict = (F.array(*[F.lit(p[i]) for p in PATTERNS]) for i in (0, 1))
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))
    return rows.select("row", "doc_id"), found.select(
        "row", F.get(kind, F.col("pattern")).alias("kind"), F.get(strict, F.col("pattern")).alias("strict"),
        "start", "end", "body", "before", "after")


def holds(kind: str) -> Column:
    """Whether a strict match of a kind passes the contract's check."""
    body, digits = F.col("body"), _digits(F.col("body"))
    small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.lit(True), "ip": body.rlike(rf"^{small}\.{small}\.{small}\.{small}$"),
        "card": F.length(digits).between(12, 19) & F.call_function("luhn_check", digits), "phone": F.length(digits).between(9, 15)}[kind]


def _by_kind(cases: dict[str, Column]) -> Column:
    return reduce(lambda out, case: out.when(F.col("kind") == case[0], case[1]), list(cases.items())[1:],
                  F.when(F.col("kind") == next(iter(cases)), next(iter(cases.values()))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(found: DataFrame) -> DataFrame:
    """Candidates worth a vote, with ``base`` and one column per labeler. Digit runs that are no card by length are dropped."""
    digits, body = _digits(F.col("body")), F.col("body")
    found = found.withColumn("base", F.col("strict") & _by_kind({k: holds(k) for k in KINDS}))
    found = found.filter(F.col("base") | (F.col("kind") != "card") | F.length(digits).between(13, 19))
    never = F.lit(False)
    listed = body.rlike(rf"(?i)\.\x20?(?:{ENDINGS})$") | body.rlike(rf"(?i)dot.\x20?(?:{ENDINGS})$")
    issuer = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)")
    first = F.left(F.regexp_extract(body, "^0*([0-9]*)", 1), F.lit(3)).try_cast("int")
    area = digits.rlike("^1?[2-9][0-9]{2}[2-9]")
    gazetteer = _by_kind({
        "email": _vote(listed, never), "ip": _vote(first.between(1, 223), first.isNull() | (first == 0) | (first > 223)),
        "card": _vote(issuer, ~issuer), "phone": _vote(area, never)})
    context = _by_kind({k: _vote(F.col("before").rlike(rf"(?i)\b(?:{yes})\b[^\n]*$"), F.col("before").rlike(rf"(?i)\b(?:{no})\b[^\n]*$"))
                        for k, (yes, no) in CUES.items()})
    groups = body.rlike(r"^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$|^[0-9]+$")
    alone = F.coalesce(~F.right("before", F.lit(1)).rlike("[0-9A-Za-z._-]"), F.lit(True)) & F.coalesce(~F.col("after").rlike("[0-9A-Za-z_]"), F.lit(True))
    shape = _by_kind({
        "email": _vote(alone, ~alone), "ip": _vote(alone & ~body.rlike(r"(?:^|\.)0[0-9]"), ~alone | body.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(alone & groups & F.call_function("luhn_check", digits), ~alone | ~groups | ~F.call_function("luhn_check", digits)),
        "phone": _vote(alone & F.length(digits).between(9, 15), ~alone)})
    return found.withColumns({"regex": F.when(F.col("base"), 1).when(F.col("strict"), -1).otherwise(0),
                              "gazetteer": gazetteer, "context": context, "shape": shape})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """EM over vote patterns with counts: the probability that a span with these votes is personal data.

    Each labeler has, per class, a probability of each vote; they start from labelers that are right more often than not.
    """
    n = len(patterns[0][0]) if patterns else 0
    prior = 0.5
    rates = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}} for _ in range(n)]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _ in patterns:
            yes = math.log(prior) + sum(math.log(rates[i][1][v]) for i, v in enumerate(votes))
            no = math.log(1 - prior) + sum(math.log(rates[i][0][v]) for i, v in enumerate(votes))
            post[votes] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(c for _, c in patterns)
        prior = (sum(c * post[v] for v, c in patterns) + 1) / (total + 2)
        for i in range(n):
            for cls in (0, 1):
                start = {1: 0.6, 0: 0.3, -1: 0.1} if cls else {1: 0.1, 0: 0.3, -1: 0.6}
                weight = {v: 4 * start[v] for v in (-1, 0, 1)}  # four spans' worth of the start, so no rate becomes 0
                for votes, c in patterns:
                    weight[votes[i]] += c * (post[votes] if cls else 1 - post[votes])
                rates[i][cls] = {v: w / sum(weight.values()) for v, w in weight.items()}
    return post


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), key), F.lit(default))


def _features() -> dict[str, Column]:
    """Traits of a span with few values each."""
    digits = _digits(F.col("body"))
    return {
        "digits": F.least(F.length(digits), F.lit(20)).cast("string"), "size": F.least(F.floor(F.length("body") / 4), F.lit(10)).cast("string"),
        "marks": F.left(F.regexp_replace("body", "[0-9A-Za-z]+", ""), F.lit(4)),
        "luhn": F.coalesce(F.call_function("luhn_check", digits), F.lit(False)).cast("string"),
        "around": F.concat(F.coalesce(F.right("before", F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False)).cast("string"), F.coalesce(F.col("after").rlike("[A-Za-z0-9]"), F.lit(False)).cast("string")),
        "votes": F.concat_ws("/", *[F.col(v) for v in LABELERS])}


def classified(spans: DataFrame) -> DataFrame:
    """Add ``p``: the classifier's probability. Two passes over ``spans``; the driver sees vote patterns and feature sums."""
    counts = spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    post: dict[str, float] = {}
    for kind in KINDS:
        patterns = sorted((tuple(r[v] for v in LABELERS), r["n"]) for r in counts if r["kind"] == kind)
        post.update({"/".join([kind, *map(str, votes)]): p for votes, p in estimate(patterns).items()})
    spans = spans.withColumn("_soft", _lookup(post, F.concat_ws("/", "kind", *[F.col(v) for v in LABELERS]), 0.0))
    traits = _features()
    named = F.array(*[F.concat_ws("/", F.col("kind"), F.lit(name), value) for name, value in traits.items()])
    sums = spans.withColumn("_f", named).select("kind", "_soft", F.explode(F.concat("_f", F.array(F.col("kind")))).alias("f")).groupBy("kind", "f").agg(
        F.sum("_soft").alias("yes"), F.sum(1 - F.col("_soft")).alias("no")).collect()
    whole = {r["kind"]: (r["yes"] + 1, r["no"] + 1) for r in sums if r["f"] == r["kind"]}
    prior = {k: math.log(yes / no) for k, (yes, no) in whole.items()}
    odds = {}
    for r in sums:  # a trait's class shares, drawn towards those of the kind by one span's weight, so that rare traits say little
        yes, no = whole[r["kind"]]
        if r["f"] != r["kind"]:
            odds[r["f"]] = math.log((r["yes"] + yes / (yes + no)) / (r["no"] + no / (yes + no))) - prior[r["kind"]]
    score = _lookup(prior, F.col("kind"), 0.0)
    for name, value in traits.items():
        score = score + _lookup({f: w for f, w in odds.items() if f.split("/")[1] == name}, F.concat_ws("/", F.col("kind"), F.lit(name), value), 0.0)
    return spans.withColumn("p", 1 / (1 + F.exp(-score)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, add: float = ADD) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows, found = candidates(docs)
    spans = common.cut_lineage(voted(found), "votes")
    spans = classified(spans)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    place = F.struct(F.col("start"), number.alias("kind"), F.col("end"))
    per_row = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), place))).alias("base"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(~F.col("base") & (F.col("p") >= add), place)))).alias("more"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = rows.join(per_row, "row", "left").withColumns({"base": F.coalesce("base", empty), "more": F.coalesce("more", empty)})
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    out = out.withColumn("spans", joined(F.array_sort(F.concat("base", apart))))
    counts = [_count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), "spans")


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_personal": op5_personal}
ORACLES: dict[str, str] = {}
