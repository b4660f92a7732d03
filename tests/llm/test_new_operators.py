"""Merkle manifest, tokenizer alignment and quality rules against brute force on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wastelens.llm import alignment, common, merkle, quality_rules, token_binary

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, n long, digest string, chunk string, "
          "pair long, pairs string, _host string, _text string, line string, kept string, n_rows long, path string")
WORDS = "the of and river stone green walking under seventh mountain lake house".split()


def sentence(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


AWKWARD = [
    (1, "one two  three", "en", "a"), (2, "one two\tthree", "en", None), (2, "one two\tthree", "en", None), (3, None, None, "b"), (4, "", "en", "b"),
    (5, "  \n ", "en", "b"), (None, "no id here", "en", "a"), (None, "no id here", "en", "a"), (None, None, None, None), (6, sentence(20000, 1), "en", "a"),
    (7, "9" * 30000, "en", "c"), (8, "x" * 100_000, None, ""), (9, "ONE two three", "fr", "é"), (10, "Ünïcode ßtraße 東京 😀 a@b.co #$", "de", "\U0001f600"),
    (11, sentence(40, 5), "en", "c"), (12, sentence(40, 5) + " end", "en", "c"), (13, "▁odd", "en", "c"), (14, "a b c d e a b c d e\nA B\nA B\n", "", "c")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *"t", 1, 2, *"dc", 3, *"phtlk", 4, "p") for r in AWKWARD], SCHEMA)


def plain(rows):
    return sorted(rows, key=repr)


# Merkle manifest

def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(leaves):
    """Root and, per leaf, its (left, right) siblings bottom up."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = i // 8 * 8
            path.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
        level, at = [H(level[i:i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        docs = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, paths = tree_of([leaf_of(r) for r in docs])
        subroots.append(subroot)
        found += [(lang, r, p) for r, p in zip(docs, paths)]
    root, upper = tree_of(subroots)
    for lang, r, path in found:
        path = path + upper[langs.index(lang)]
        text, low = r[4], lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None
        acc = leaf_of([*r[:4], low(text) if tampered else text])
        for a, b in path:
            acc = H([a, acc, b])
        yield (r[0], leaf_of(r), subroots[langs.index(lang)], root, H(a + b for a, b in path), acc, acc == root)


def manifest_rows(df):
    return plain(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.manifest(df).collect())


def test_manifest_of_awkward_rows(awkward):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in awkward.collect()]
    got = manifest_rows(awkward)
    assert got == plain(brute_manifest(rows)) and {r[-1] for r in got} == {True, False}
    assert manifest_rows(awkward.repartition(5)) == got
    assert merkle.manifest(awkward.limit(0)).collect() == []


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (513, 1), (1300, 70)])
def test_manifest_over_several_blocks(spark, n, langs):
    rows = [(i * 3, f"s{i % 4}", f"l{i % langs:02d}" if i % langs else None, i, f"Text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(df) == plain(brute_manifest(rows))


def test_a_language_of_three_passes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", "en" if i % 5 else "de", i, f"T{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(df) == plain(brute_manifest(rows))


# alignment

def pieces(table, text):
    """Ids and byte ends of both sides over the whole text, from decoded bytes alone; None without tokens."""
    if not text:
        return None
    raw, out = (" " + text).encode(), []
    for ids, spelled in ((table.a.encode(" " + text, add_special_tokens=False).ids, table.a_bytes), (table.b.encode(text), table.b_bytes)):
        ends, end = [], 0
        for i in ids:
            end += len(spelled[i])
            ends.append(end)
        if b"".join(spelled[i] for i in ids) != raw:
            return None
        out.append((ids, ends))
    return out


def brute_alignment(table, text):
    """(n_a, n_b, groups, linked ids)"""
    found = pieces(table, text)
    if found is None:
        return 0, 0, [], []
    (a, ae), (b, be) = found
    groups, start = [], 0
    for end in sorted(set(ae) & set(be)):
        pick = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if start < e <= end)  # noqa: B023, E731
        groups.append(f"{pick(a, ae)}|{pick(b, be)}")
        start = end
    linked, j = [], 0
    for i, (x, end) in enumerate(zip(a, ae)):
        begin = ae[i - 1] if i else 0
        while be[j] <= begin:
            j += 1
        k = j
        while k < len(b) and (be[k - 1] if k else 0) < end:
            linked.append((x, b[k]))
            k += 1
    return len(a), len(b), groups, linked


ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "東京", "😀", "①", "▁", "<s>", "<|endoftext|>", "don't", "x" * 20, "123", "\r", "　", "​",
       ".", " the", "\x00", "᠎", "﻿", "ﬁ", "\x85", "\x1c", " ", "𝔘", "'s", "!!", "ß", "<0x0A>"]


@pytest.fixture(scope="module")
def table():
    return alignment.Aligner(token_binary.tokenizer_path(alignment.PATH_A), token_binary.tokenizer_path(alignment.PATH_B))


def test_parts_equal_whole_texts(table):
    draw = random.Random(2)
    plainer = [t for t in ODD if t.strip() and t not in "▁᠎​﻿"] + [" "] * 12 + ["\n"] * 3
    texts = ["".join(draw.choices(ODD if k % 2 else plainer, k=draw.randint(0, 14))) for k in range(4000)]
    for text, at in zip(texts, table(texts)):
        assert table.text_of(at) == ";".join(brute_alignment(table, text)[2]), text
    assert table.cuts and sum(map(bool, table(texts))) > 2000


def expected_rows(table, rows):
    found = [(i, brute_alignment(table, t)) for i, t in rows]
    counts = Counter(p for _, (*_, linked) in found for p in linked)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return plain((i, a, b, len(groups), len(linked), sum(counts[p] == best[p[1]] for p in linked), sum(counts[p] for p in linked),
                  H([";".join(groups)]) if groups else "") for i, (a, b, groups, linked) in found)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_awkward_rows(awkward, table):
    got = plain(tuple(r[c] for c in COLUMNS) for r in alignment.aligned(awkward).collect())
    assert got == expected_rows(table, [r[:2] for r in AWKWARD])
    assert alignment.aligned(awkward.limit(0)).collect() == []
    spelled = {r["doc_id"]: r["groups"] for r in alignment.groups(awkward.filter("doc_id > 8")).collect()}
    assert spelled[13] is None and spelled[9] == ";".join(brute_alignment(table, "ONE two three")[2])


def test_counts_over_many_chunks(spark, table):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices([*WORDS, "東京", "naïve", "don't"], k=draw.randint(0, 30)))) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert plain(tuple(r[c] for c in COLUMNS) for r in alignment.aligned(df).collect()) == expected_rows(table, rows)


def test_chunks_stay_bounded(table, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(alignment, "CHUNK_PARTS", 50)
    monkeypatch.setattr(alignment, "CACHE_PARTS", 30)
    rows = [f"word{i} and ▁odd{i % 3} word{i + 1} of the" if i % 9 == 4 else f"word{i} and word{i + 1} of the" for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": rows})
    run = alignment._chunker(token_binary.tokenizer_path(alignment.PATH_A), token_binary.tokenizer_path(alignment.PATH_B))
    out = list(run(iter([batch])))
    assert len(out) > 5 and sum(sum(len(x) for x in b.column("doc_id").to_pylist()) for b in out) == 400
    digests = [d for b in out for d in b.column("groups_sha256").to_pylist()[0]]
    assert [bool(d) for d in digests] == [i % 9 != 4 for i in range(400)]  # bad parts stay bad when the table shrinks
    want = [";".join(brute_alignment(table, t)[2]) for t in rows]
    assert [d for d in digests if d] == [H([w]) for w in want if w]
    assert len(alignment.aligner(token_binary.tokenizer_path(alignment.PATH_A), token_binary.tokenizer_path(alignment.PATH_B)).rows) < 200


def test_rows_do_not_hold_the_chunks(spark):
    docs = spark.createDataFrame([(i, "one two three " * 40 + str(i % 7)) for i in range(300)], "doc_id long, text string").repartition(2)
    placed = alignment.chunks(docs, token_binary.tokenizer_path(alignment.PATH_A), token_binary.tokenizer_path(alignment.PATH_B))
    assert placed.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 5000  # the digests of 150 documents alone are more
    rows = placed.collect()
    found = [i for r in rows for i in alignment._stored(r["name"], r["start"], r["size"]).column("doc_id")[0].as_py()]
    assert sorted(found) == list(range(300)) and len({r["chunk"] for r in rows}) == len(rows) > 1


def test_parts_learnt_in_runs_equal_parts_learnt_alone(table):
    texts = ["one two\nthree ñandú 漢字 \U0001f600x", "bad ▁part here", " lead  double  ", "tab\there e\u0301 \u200b z", "a", "\n", "x\ny"] + [
        f"w{i} é{i}\n漢{i}" for i in range(90)]
    names = list(dict.fromkeys(p for t in texts for p in table.parts(t)))
    found = []
    for run in (1, 5, alignment.RUN):
        table.clear()
        table._learn(names, run)
        rows = [table.rows[n] for n in names]
        found.append([(table.groups[r], table.sizes[4 * r:4 * r + 4].tolist(), table.pairs[r], r in table.bad) for r in rows])
    table.clear()
    assert found[0] == found[1] == found[2] and sum(bad for *_, bad in found[0]) == 1


def test_links_overlap():
    assert alignment.links([2, 5, 6], [1, 5, 6]) == ([(0, 0), (0, 1), (1, 1), (2, 2)], [(2, 2), (3, 3)])


# quality rules

BLANK = "[\\x20\\x09-\\x0d]"


def brute_marks(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0d]+", text)
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def normal(line):
    line = " ".join(re.findall("[^\\x20\\x09-\\x0d]+", line))
    return re.sub("[A-Z1-9]", lambda m: "0" if m[0].isdigit() else m[0].lower(), line)


def brute_judge(rows, least=quality_rules.MIN_TEXTS, share=quality_rules.MAX_SHARE, left=quality_rules.MIN_LEFT):
    """rows: (doc_id, text, host)"""
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        texts[h].add(t or "")
        for x in (t or "").split("\n"):
            if normal(x):
                holders[h, normal(x)].add(t)
    for i, t, h in rows:
        n = brute_marks(t)
        gone = sum(len(normal(x).split(" ")) for x in (t or "").split("\n") if normal(x) and len(holders[h, normal(x)]) > max(least, share * len(texts[h])))
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        yield (i, *n, failed, not failed and n[0] - gone >= 10 and n[0] - gone >= left * n[0], n[0] - gone)


def judged(df, **args):
    return plain(tuple(r) for r in quality_rules.judge(df, **args).collect())


def test_rules_on_awkward_rows(awkward):
    assert judged(awkward) == plain(brute_judge([(r[0], r[1], r[3]) for r in AWKWARD]))
    assert judged(awkward.repartition(7)) == judged(awkward)
    assert quality_rules.judge(awkward.limit(0)).collect() == []
    assert quality_rules.cleaned(awkward).columns == awkward.columns and quality_rules.cleaned(awkward).count() == len(AWKWARD)


def planted(seed=7):
    """Two hosts with site lines of three lengths, one of them on a third of all rows; pages that hold little else; copies."""
    draw, rows = random.Random(seed), []
    site = {"a": ["Read more on page 12 of our site", "ALL rights   reserved"], "b": ["Sign up for the letter"], None: ["Home | Shop | Cart"]}
    for i in range(400):
        host = draw.choice(["a", "a", "a", "b", None])
        body = [" ".join(draw.choices(WORDS, k=12)) + f" n{i}x{k}" for k in range(draw.randint(0, 4))]
        lines = body + [re.sub("12", str(draw.randint(10, 99)), s) for s in site[host] for _ in range(draw.randint(0, 2))] * draw.choice([1, 1, 4])
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines), host))
    copy = next(r for r in rows if r[1].count("\n") > 2)
    return rows + [(1000 + i, copy[1], copy[2]) for i in range(200)]


def test_site_lines_go_and_depleted_pages_are_rejected(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = judged(df)
    assert got == plain(brute_judge(rows))
    by_id = {r[0]: r for r in got}
    assert any(r[0] in by_id and not by_id[r[0]][7] and not by_id[r[0]][6] for r in rows)  # rejected by the lines alone
    clean = {r["doc_id"]: r["text"] for r in quality_rules.cleaned(df).collect()}
    frequent = re.compile("read more on page|all rights reserved|sign up for|home . shop")
    for i, t, h in rows:
        assert clean[i] == "\n".join(x for x in t.split("\n") if not frequent.search(normal(x))), (i, t)
    assert all(by_id[i][7] == by_id[1000][7] for i in range(1000, 1200))


def test_limits_are_arguments(spark):
    rows = planted(8)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert judged(df, min_texts=30, max_share=0.3, min_left=0.9) == plain(brute_judge(rows, 30, 0.3, 0.9))


def test_window_hashes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: (F.length(c[0].cast("string")) % 2).cast("long"))
    rows = [(i, " ".join(random.Random(i).choices("ab", k=30)), "s") for i in range(20)] + [(99, sentence(30, 3), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.marks(df).collect()}
    assert got == {i: brute_marks(t)[4] for i, t, _ in rows}


def test_skew_join_is_an_inner_join(spark):
    draw = random.Random(1)
    keys = [0] * 3000 + [draw.randrange(1, 4000) for _ in range(6000)]
    many = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    few = spark.createDataFrame([(k, n, k % 2 == 0) for k, n in Counter(keys).items() if k % 3 == 0], "k long, w long, even boolean")
    got = common.skew_join(many, few, ["k"], "w", len(keys), F.col("even")).filter("even").select("k", "i").collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for i, k in enumerate(keys) if k % 6 == 0)
