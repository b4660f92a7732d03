"""Each operator against brute force on small rows, and the same awkward rows through all of them."""

import hashlib
import itertools
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import compare, duck
from wastelens.llm import (catalog, decontaminate, exact_dedup, graph, html_text, language, mixture, personal, secrets, sharding,
                           simhash, token_binary)

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, size long, keep_id string, _row int, `key` string, "
          "label int, row string, page_id long, url string, html string")
WORDS = "the of and river stone green walking under seventh mountain lake house".split()


def sentence(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


AWKWARD = [
    (1, "one two  three", "en", "a"), (2, "one two\tthree", "en", None), (2, "one two\tthree", "en", None), (3, None, None, "b"), (4, "", "en", "b"),
    (5, "  \n ", "en", "b"), (None, "no id here", "en", "a"), (None, "no id here", "en", "a"), (6, sentence(20000, 1), "en", "a"), (7, "9" * 30000, "en", "c"),
    (8, "x" * 100_000, None, ""), (9, "ONE two three", "fr", "é"), (10, "Ünïcode ßtraße 東京 😀 a@b.co", "de", "\U0001f600"), (11, sentence(40, 5), "en", "c"),
    (12, sentence(40, 5) + " end", "en", "c")]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, len(r[1] or ""), 1, 2, "k", 3, "x", 4, "y", r[0], f"http://h{(r[0] or 0) % 2}.example.com/{r[0]}", r[1]) for r in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA)


def operators(spark, docs, items, root):
    """Every operator over the rows, with the number of rows that it must return."""
    n = docs.count()
    model = language.fit(docs)
    return {
        "copies": (exact_dedup.copies(docs), n), "mix": (mixture.mix(docs), n), "shard": (sharding.shard(docs), n),
        "near": (simhash.near_duplicates(docs), n), "report": (decontaminate.report(docs, items), n),
        "cleaned": (decontaminate.cleaned(docs, items), n), "tokens": (token_binary.token_records(docs), n),
        "scan": (secrets.scan(docs, secrets.fit(docs)), n), "personal": (personal.personal_data(docs), n),
        "pages": (html_text.extracted(docs), n), "lang": (language.identified(docs, model, "l", "s"), n)}


def test_awkward_rows_pass_every_operator(spark, awkward, tmp_path):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta"), (3, "x y z")], "item_id long, text string")
    for name, (out, n) in operators(spark, awkward, items, tmp_path).items():
        assert len(out.collect()) == n, name


def test_empty_tables_pass_every_operator(spark, awkward, tmp_path):
    empty = awkward.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for name, (out, n) in operators(spark, empty, items, tmp_path).items():
        assert n == 0 and out.collect() == [], name
    assert mixture.repeated(empty).collect() == [] and simhash.one_of_each(empty).columns == empty.columns
    assert exact_dedup.drop_copies(empty).columns == empty.columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    verdict = compare(df.columns, df.collect(), duck(SMALL).sql(catalog.ORACLES[name]))
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# exact duplicates

def test_copies_and_collisions(spark, awkward):
    for content_hash in (exact_dedup.hash128, lambda t: F.length(t) % 2):  # the second collides nearly always
        groups = defaultdict(list)
        for i, text, *_ in AWKWARD:
            groups[re.sub("[\\x20\\x09-\\x0d]+", " ", text or "")].append(i)
        got = exact_dedup.copies(awkward, content_hash=content_hash).collect()
        for r in got:
            text = next(re.sub("[\\x20\\x09-\\x0d]+", " ", t or "") for i, t, *_ in AWKWARD if i == r["doc_id"])
            ids = groups[text]
            keep = min((i for i in ids if i is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# mixing

def filled(sizes, weights, epochs=3):
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > epochs * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(epochs * sizes[s]) for s in over}


def test_water_filling_equals_the_loop(spark):
    draw = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i:02d}": draw.choice([0, 1, 5, 50, 500, 5000]) for i in range(12)} | {"big": 20000}
        weights = {s: draw.choice([0.5, 1.0, 3.0, 10.0]) for s in sizes}
        rows = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in mixture.water_fill(rows).collect()}
        want = filled(sizes, weights)
        assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_meets_targets_and_reruns_agree(spark, awkward):
    rows = mixture.mix(awkward).collect()
    sums, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(sums[s] - t) <= 0.5 for s, t in target.items())
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, mixture.mix(awkward.repartition(5)).collect()))
    taken = Counter(r["source"] for r in mixture.repeated(awkward).collect() for _ in r["text"].split())
    assert {s: n for s, n in sums.items() if n} == taken and mixture.repeated(awkward).columns == awkward.columns


# sharding

def tree_of(key, shards):
    node = ""
    levels = [lambda s: s.region, lambda s: s.rack, lambda s: f"{s.rack}/s{s.shard}"]
    left = [s for s in shards if s.weight > 0]
    import math
    for level in levels:
        weights = Counter()
        for s in left:
            weights[level(s)] += s.weight

        def draw(name):
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=xxhash.xxh64_intdigest(name.encode(), seed=42)) >> 11
            return -math.log((h + 0.5) / 2**53) / weights[name], name

        node = min(map(draw, weights))[1]
        left = [s for s in left if level(s) == node]
    return left[0].shard


def test_tree_placement_growth_and_slots(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("tëxt").alias("text"))
    rows = sharding.shard(docs).collect()
    for r in rows[:200]:
        assert (r["shard"], r["grown_shard"]) == (tree_of(r["doc_id"], sharding.tree(40)), tree_of(r["doc_id"], sharding.tree(41)))
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {40}
    assert all((r["size"], r["text_crc32"], r["law"]) == (21, zlib.crc32("tëxt".encode()), "key") for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 2.2 * 3000 / 40


def test_weights_move_rows_within_their_subtree_only(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    moved = sharding.place(sharding.place(docs, "doc_id", sharding.tree(16), "a"), "doc_id", sharding.tree(16, {0: 3.0}), "b").collect()
    assert sum(r["b"] == 0 for r in moved) > 1.8 * sum(r["a"] == 0 for r in moved)
    assert all(r["b"] // 8 == 0 for r in moved if r["a"] != r["b"])  # the first region alone gained weight


# SimHash

def brute_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {p: root(p) for p in prints}


def slow_fingerprint(text):
    words = re.findall("[^\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark, awkward):
    got = simhash.near_duplicates(awkward).collect()
    for r in got:
        text = next(t for i, t, *_ in AWKWARD if i == r["doc_id"])
        assert r["fingerprint"] == f"{slow_fingerprint(text):016x}"
    of = brute_components(sorted({int(r["fingerprint"], 16) for r in got}))
    ids = defaultdict(list)
    for r in got:
        ids[of[int(r["fingerprint"], 16)]].append(r["doc_id"])
    for r in got:
        assert r["component_id"] == min((i for i in ids[of[int(r["fingerprint"], 16)]] if i is not None), default=None)
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(ids)


def test_tiles_find_every_link(spark):
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for p in list(prints)[:60]:
        for _ in range(draw.randint(1, 6)):  # chains of near prints
            p ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4)))
            prints.add(p)
    signed = {p - 2**64 if p >= 2**63 else p for p in prints}
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = brute_components(sorted(signed))
    for tile in (16, 32_768):
        got = {r["node"]: r["label"] for r in simhash.linked(rows, tile=tile).collect()}
        assert {p: got.get(p, p) for p in signed} == want


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}


# decontamination

def brute_hits(text, items, window=10):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontaminate.words_of(body)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            for q in range(len(words) - k + 1):
                if words[q:q + k] == w[p:p + k]:
                    hit |= set(range(q, q + k))
                    found.add(item)
    return len(words), len(hit), found


def test_automaton_equals_brute_force(spark):
    draw = random.Random(7)
    few = ["a", "b", "c"]
    items = [(i, " ".join(draw.choices(few, k=draw.choice([1, 4, 9, 10, 11, 25])))) for i in range(3, 12)] + [(50, "a b c a b c a b c a b c a"), (51, None), (52, "?!")]
    items += [(60, items[0][1])]
    docs = [(i, " ".join(draw.choices(few + ["d"], k=60))) for i in range(40)] + [(90, "A, b; C a-b c A b c a b"), (91, None), (92, "élan 東京 x")]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (30, 200_000):
        got = by_id(decontaminate.report(d, it, block_words=block))
        for i, text in docs:
            n, hit, found = brute_hits(text, items)
            listed = ",".join(sorted(map(str, found)))
            assert got[i] == {"doc_id": i, "n_words": n, "n_hit": hit, "n_items": len(found), "contaminated": hit > 0,
                              "items_sha256": hashlib.sha256(listed.encode()).hexdigest()}


def test_long_windows_only_and_removal(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"{sentence(30, 1)}. {item}! {sentence(20, 2)}", 1), (2, item, 2), (3, sentence(50, 3), 3), (4, None, 4)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = by_id(decontaminate.cleaned(d, spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert set(got) == {1, 3, 4} and got[3]["text"] == docs[2][1] and got[3]["n_chars"] == 3
    assert got[1]["text"] == f"{sentence(30, 1)}. ! {sentence(20, 2)}" and got[1]["n_chars"] == len(got[1]["text"])


# token records

def test_records_hold_what_the_library_encodes(spark, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_binary.tokenizer_path())
    rows = sorted(((i, t or "") for i, t, *_ in AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, token_binary.token_records(awkward).collect()), key=str) == sorted(want, key=str)


def test_encoder_equals_the_library():
    encode = token_binary.Encoder(token_binary.tokenizer_path())
    draw = random.Random(11)
    parts = ["a", "the", "Über", "isn't", " ", "  ", "\n", "\n\n", "\t", "x1", "1,5", "...", "é.", "\xa0", "ß!!", "<|endoftext|>", "ǆ", "東京", "\x85", "a'", "!?a", "'s"]
    for _ in range(400):
        text = "".join(draw.choices(parts, k=draw.randint(0, 12)))
        assert encode(text) == encode.encode(text), repr(text)
        text = " ".join(draw.choices(parts, k=6))
        assert encode(text) == encode.encode(text), repr(text)


def test_index_reads_in_any_order_and_damage_is_seen(spark, tmp_path):
    docs = spark.createDataFrame([(i, sentence(i, i)) for i in range(50)], "doc_id long, text string")
    manifest = token_binary.write_records(docs, str(tmp_path / "rec"), token_binary.tokenizer_path()).collect()
    assert sum(m["n_docs"] for m in manifest) == 50
    for m in manifest:
        whole = list(token_binary.read_shard(m["name"]))
        for (doc_id, ids), (offset, _) in reversed(list(zip(whole, token_binary.read_index(m["name"]), strict=True))):
            again = token_binary.read_at(m["name"], offset)
            assert again[0] == doc_id and (again[1] == ids).all()
    path = manifest[0]["name"] + ".rec"
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(token_binary.read_shard(manifest[0]["name"]))


# language

@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_language_sample_is_bounded_by_distinct_texts(spark):
    rows = [("a", f"rara {i}") for i in range(2000)] + [("a", f"copia {i % 3}") for i in range(6000)] + [("b", f"otra {i % 5}") for i in range(900)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    drawn = language.sample(docs, 300).collect()
    assert len(drawn) == len(set(drawn))
    sizes = {lang: sum(r["lang"] == lang for r in drawn) for lang in "ab"}
    assert 200 < sizes["a"] < 400 and sizes["b"] == 5
    assert {r["lang"] for r in language.sample(docs, 300, languages=1).collect()} == {"a"}
    assert sorted(language.sample(docs.repartition(7), 300).collect()) == sorted(drawn)


def test_numbers_that_look_like_letters_are_none():
    assert language.words_of("½ ② Ⅷ ²") == []
    assert language.words_of("Área x²y ½kg 12ab") == ["área", "x", "y", "kg", "ab"]


def test_tied_languages_and_repeated_rows(spark):
    rows = [(1, "casa", "b"), (2, "casa", "a"), (2, "casa", "a"), (3, None, "a"), (4, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identified(docs, language.fit(docs), "found", "sure").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["found"]) for r in got] == [(1, "a"), (2, "a"), (2, "a"), (3, "und"), (4, "und")]
    assert [r["sure"] for r in got] == [0.5, 0.5, 0.5, 0.0, 0.0]


def test_held_out_accuracy(spark):
    got = language.op3_language(spark, "/root/testdata/sf0.01").filter("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_words_first_then_grams(spark):
    rows = [(1, "hello world again", "en", "s"), (2, "bonjour monde encore", "fr", "s")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert model.predict("HELLO", {})[0] == "en" and model.predict("bonjourno", {})[0] == "fr"
    assert model.predict("worldly hello", {})[0] == "en"
    assert [model.predict(t, {}) for t in (None, "", "12 !?")] == [("und", 0.0)] * 3
    assert model.unseen("monde")[0] > model.unseen("monde")[1]


# secrets

def test_base_spans_and_added_secrets(spark):
    key = "xK9vQ2mZ7rT4wB8nL3pD6sF1"
    texts = [
        'Token: "abcdef1" x', "secret:token:abcdef123", "api_key=short", "APIKEY = 'longenough'", "AKIA" + "A" * 16, "AKIAABC", "deadbeef" * 3, "deadbeef" * 2 + "xyz", None,
        f"plain words and {key} here", "internationalisation considerations everywhere", "paſſword=abcdefgh", "😀 passwd='hunter22'"]
    base = [["assign:0:15"], [], [], ["assign:0:20"], ["access:0:20"], [], ["hex:0:24"], [], [], [], [], [], ["assign:2:18"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)] + [(1000 + i, sentence(200, i)) for i in range(20)], "doc_id long, text string")
    got = by_id(secrets.scan(docs, secrets.fit(docs)))
    for i, want in enumerate(base):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[i]
        more = set(got[i]["spans"].split(",")) - set(want) - {""}
        assert more == ({f"random:16:{16 + len(key)}"} if texts[i] and key in texts[i] else set()), texts[i]
    assert all(got[1000 + i]["spans"] == "" for i in range(20))


# personal data

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_base(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if not (k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_base_equals_the_patterns_and_context_adds(spark):
    draw = random.Random(13)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", ".5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-9999", "+4", " ", "-", "😀", "\n", "12", "x", "mail0.example.com", "0001.1.1.1"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(300)]
    texts += ["9" * 30000, "1 " * 20000, "1." * 5000, "x@" + "a." * 5000 + "b", None, "", "a" * 50000 + "@b.co"]
    added = ["mail me: john.doe (at) example (dot) com now", "call (212) 555-0188 now"]
    clean = ["order 1234-5678 of 2024", sentence(30, 4)]
    plain = [f"write to a{i}@mail.example.com or call +1 (212) 555-{1000 + i}" for i in range(60)]
    texts += added + clean + plain
    got = by_id(personal.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        want = personal_base(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in personal.KINDS] == [want.count(f"{k}:") for k in personal.KINDS]
        if text in added:
            assert got[i]["spans"] == ("email:9:40" if "(at)" in text else "phone:5:19")
        if text in clean:
            assert got[i]["spans"] == ""


def test_em_finds_the_reliable_labelers():
    draw, counts = random.Random(1), Counter()
    for _ in range(5000):
        truth = draw.random() < 0.4
        good = [1 if (truth if draw.random() < 0.95 else not truth) else -1 for _ in range(3)]
        counts[(*good, draw.choice([-1, 0, 1]))] += 1
    post = personal.estimate(sorted(counts.items()))
    assert post[1, 1, 1, -1] > 0.99 and post[-1, -1, -1, 1] < 0.01 and abs(post[1, 1, -1, 1] - post[1, 1, -1, -1]) < 0.1


# pages

@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p>a<p>b", "a\nb"), ("x<b>y</b>z<br>w", "xyz w"), ("<p>a &lt;b&gt; &amp;c &#233;&copy</p>", "a <b> &c é©"),
    ("<nav>n</nav><div id=content><p>one</p><ul><li>a<li>b</ul></div><div class='comments'><p>c</p></div><footer>f", "one\na\nb"),
    ("<article><script>var a='</article>';</script><p>t</p><aside>s</aside><form>q<input></form><p class=notice>n</p></article>", "t"),
    ("<p title='a>b'>ok</p><!-- x <p>no</p> --> tail", "ok\ntail"), ("1 < 2 <3 & 4", "1 < 2 <3 & 4"),
    ("<body>out<article><h1>T</h1><p><b>un<br><p>closed</article>after", "T\nun\nclosed"), ("<div class='ad'>x", ""),
    ("<head><title>t</title></head><body><header>h</header><main><p>m\n  n</p></main>", "m n"), ("a" * 100_000, "a" * 100_000)])
def test_main_text(page, text):
    assert html_text.main_text(html_text.parse(page)) == text


def test_deep_and_broken_markup_end_in_time():
    for page in ("<div>" * 20_000 + "x", "<" * 50_000, '<a href="' * 5_000, "</p>" * 20_000, "<p>" * 20_000, "&" * 50_000):
        html_text.main_text(html_text.parse(page))


def test_templates_of_a_site_go_and_shared_passages_stay(spark):
    box = "<div><p>Join our club</p><span>today</span></div>"
    same = "<p>A passage that every article quotes.</p>"
    pages = [(i, f"http://a.example.com/{i}", f"<body>{box}<div><p>Story {i}</p></div></body>") for i in range(8)]
    pages += [(100 + i, f"http://b.example.com/{i}", f"<body>{box}<article><p>Story {i}</p>{same}</article></body>") for i in range(8)]
    pages += [(200 + i, "http://c.example.com/x", "<div><p>Copied page</p></div>") for i in range(9)] + [(300, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3" and got[103] == "Story 3\nA passage that every article quotes." and got[200] == "Copied page" and got[300] == ""
