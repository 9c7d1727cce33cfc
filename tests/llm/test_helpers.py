"""Union-find, census and word hashes against plain Python."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citegrain.llm import census, class_lm, graph, shingle_join, suffix_dedup, tokens
from citegrain.llm.texts import SPACE, fold, slices, text_slices, word_count


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    pairs = {
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)],
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(7, i) for i in range(60)] * 2,
        "none": [],
    }[shape]
    edges = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == roots([(a, b) for a, b in pairs if a != b])


def test_word_hashes_tell_words_apart():
    texts = [b"a b A\tlonger  word", b"", b"  ", "é É b".encode()]
    hashes, counts = census.word_hashes(texts)
    assert counts.tolist() == [5, 0, 0, 3]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[7] and hashes[5] != hashes[6]
    assert len(set(hashes.tolist())) == 6


def test_census_totals(spark):
    rng = random.Random(2)
    sent = {b: Counter(rng.randrange(60) << 58 for _ in range(50)) for b in range(4)}
    tables = []
    for b, counted in sent.items():
        keys = np.array(sorted(counted), np.uint64)
        tables.append(census.report(b, keys, np.array([counted[int(k)] for k in keys]), 5))
    reports = spark.createDataFrame(pa.concat_tables(tables).to_pandas(), census.REPORT)
    rows = census.answers(reports, lambda t: t.astype("<u4"), lambda k, t: t.sum().tobytes()).toArrow()
    total = sum(sent.values(), Counter())
    summed = 0
    for b, counted in sent.items():
        own = rows.filter(pa.compute.equal(rows.column("block"), b))
        assert census.answered(own, "<u4").tolist() == [total[k] for k in sorted(counted)]
    for blob in rows.filter(pa.compute.equal(rows.column("block"), -1)).column("totals").to_pylist():
        summed += int(np.frombuffer(blob, "<i8")[0])
    assert summed == sum(total.values())


def test_word_count_and_fold(spark):
    import re
    import zlib

    texts = ["", " ", "a", " a", "a ", "a\n\nb\x0b c", None, " ", "é é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows.select("doc_id", "text", word_count().alias("n"), fold(4).alias("f")).collect()
    for r in got:
        assert r.n == len(re.findall(SPACE.replace("[", "[^", 1) + "+", r.text or ""))
        assert r.f == zlib.crc32(str(r.doc_id).encode()) % 4


def test_blocks_and_parts_of_a_census_stay_small():
    """What one task holds does not grow with the documents."""
    for total in (10**8, 10**9, 10**11):
        assert total / census.cut(total, census.BLOCK_BYTES) <= 8 << 20
        for module in (shingle_join, class_lm, suffix_dedup):
            assert total / census.cut(total, module.PART_BYTES) <= 24 << 20
    shared = int(865e6 * shingle_join.CENSUS_SHARE)  # of check_l, where a part of 34 MB was too much
    assert shared / census.cut(shared, shingle_join.PART_BYTES) <= 4 << 20


def test_text_slices():
    column = pa.array(["é" * 400, None, "", "b" * 500, "c" * 2000] * 2000)
    got = [t for a, b, texts in text_slices(column, 100_000) for t in texts if b - a == len(texts)]
    assert got == [t or "" for t in column.to_pylist()] and list(text_slices(column.slice(0, 0), 9)) == []
    tracemalloc.start()
    marks = pa.array([shingle_join.words_key(t) for _, _, texts in text_slices(column, 100_000) for t in texts])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(marks) == len(column) and most < column.nbytes / 2


def test_slices():
    assert list(slices([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices([], 6)) == []


@pytest.mark.parametrize("name, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_of_a_small_cache(monkeypatch, name, words):
    """Ids do not depend on what the cache holds; it stays near its bound."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 3000)
    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path, words)
    whole.encode_special_tokens = True
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join(f"{rng.choice('abcd')}{rng.randrange(90)}ing." for _ in range(rng.randrange(1, 60))) + " <|endoftext|>"
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert own.held < 3000 + 120 * 300
