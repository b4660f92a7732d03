"""The pipeline's stages against the operators' brute force on the smallest tables."""

import os
import struct
import zlib
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from wastelens.llm import common, decontaminate, language, simhash, token_binary

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_on_what_the_last_one_kept(spark):
    docs = common.table(spark, SMALL, "documents")
    junk = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 34", "en", "src1", 5)], docs.schema)
    docs = docs.union(junk)
    columns = docs.columns

    kept = common.cut_lineage(pipeline.language_stage(spark, docs, SMALL), "t")
    assert kept.columns == columns and {r[0] for r in docs.collect()} - {r[0] for r in kept.collect()} == {10**6, 10**6 + 1}

    single = common.cut_lineage(pipeline.near_duplicate_stage(spark, kept, SMALL), "t")
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in kept.collect()}
    ids = sorted(prints)
    smallest = {i: i for i in ids}
    for _ in range(len(ids)):  # labels spread until nothing changes
        before = dict(smallest)
        for i in ids:
            smallest[i] = min(smallest[j] for j in ids if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3)
        if before == smallest:
            break
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(smallest.values()))

    clean = common.cut_lineage(pipeline.decontamination_stage(spark, single, SMALL), "t")
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"])) for r in common.table(spark, SMALL, "benchmark").collect()]
    windows = {tuple(w[p:p + 10]) for _, w in items for p in range(len(w) - 9)}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    hit = {}
    for i, text in before.items():
        words = decontaminate.words_of(text)
        hit[i] = len({q for p in range(len(words) - 9) if tuple(words[p:p + 10]) in windows for q in range(p, p + 10)})
        if not hit[i]:
            assert after[i] == text
        elif hit[i] > 0.5 * len(words):
            assert i not in after
        else:
            left = decontaminate.words_of(after[i])
            assert len(left) == len(words) - hit[i]

    mixed = common.cut_lineage(pipeline.mixing_stage(spark, clean, SMALL), "t")
    words = sum(len(t.split()) for t in after.values())
    taken = sum(len(r["text"].split()) for r in mixed.collect())
    assert mixed.columns == columns and abs(taken - words) <= len({r["source"] for r in clean.collect()})

    final = pipeline.token_stage(spark, mixed, SMALL)
    encode = token_binary.Encoder(token_binary.tokenizer_path())
    start, want = 0, []
    for doc_id, text in sorted((r["doc_id"], r["text"]) for r in mixed.collect()):
        ids = [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert rows_of(final) == sorted(want, key=str)


def test_run_equals_its_stages_and_keeps_the_order(spark):
    assert [n for n, _ in pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    got = pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert max(Counter(r["doc_id"] for r in got.collect()).values()) <= 4


def test_empty_documents_pass_every_stage(spark):
    docs = common.table(spark, SMALL, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        docs = common.cut_lineage(stage(spark, docs, SMALL), "t")
        assert docs.collect() == [], name
    assert language.UNKNOWN == "und"
