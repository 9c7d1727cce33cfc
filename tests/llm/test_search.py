"""Lexical search, hard negatives and decontamination against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.llm import decontamination, hard_negatives, lexical_search, terms

ITEM = "item_id bigint, text string, score double, rank int, id bigint, mark bigint"


def words_of(text):
    plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)


def case_prose(rng, n):
    return " ".join(f"w{rng.randrange(400)}x" for _ in range(n))


@pytest.fixture(scope="module")
def item_rows(cases):
    _, rows = cases
    texts = [r[1] for r in rows if r[1]]
    rng = random.Random(9)
    passage = next(t for t in texts if t.count("\n") == 2 and len(t) > 300).split("\n")[1]
    found = [texts[0], passage.upper(), " ".join(passage.split(" ")[:14]), case_prose(rng, 20), "two words", "ONE", "", None]
    found += ["naïve café́", "日本語のテキスト", "w1x w1x w2x w3x", "never-seen terms qqq", passage, texts[3] + " tail end"]
    rows = [(i, t, 0.0, 1, 2, 3) for i, t in enumerate(found)]
    return [*rows, rows[0], (0, "w5x w6x", 0.0, 1, 2, 3), (None, passage, 0.0, 1, 2, 3), (99, " ".join(f"w{i}x" for i in range(150)), 0.0, 1, 2, 3)]


@pytest.fixture(scope="module")
def items(spark, item_rows):
    return spark.createDataFrame(item_rows, ITEM)


def order(value):
    return (value is None, value if value is not None else 0)


def best_documents(rows, item_rows, k):
    docs = [(r[0], words_of(r[1])) for r in rows]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    expected = []
    for item_id, text in {(r[0], r[1] or "") for r in item_rows}:
        asked, scored = words_of(text), []
        for i, w, c in docs:
            m = 100 - 25 + (25 * len(w) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in asked if t in c
            )
            if score > 0:
                scored.append((-score, order(i), i))
        for rank, (score, _, i) in enumerate(sorted(scored)[:k], 1):
            expected.append((item_id, rank, i, -score))
    return sorted(expected, key=str)


@pytest.mark.parametrize("k", [3, 20])
def test_search(cases, items, item_rows, k):
    docs, rows = cases
    got = lexical_search.search(docs, items, k=k).collect()
    assert sorted((tuple(r) for r in got), key=str) == best_documents(rows, item_rows, k)


def test_search_in_blocks(cases, items, item_rows, monkeypatch):
    monkeypatch.setattr(terms, "ITEM_BYTES", (2000, 2000))
    docs, rows = cases
    got = lexical_search.search(docs, items, k=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == best_documents(rows, item_rows, 5)


def test_search_leaves_masks_out():
    rng = np.random.default_rng(3)
    lists, best = [], lexical_search.Best(5)
    for j in range(70):
        rows = np.flatnonzero(rng.random(4000) < 0.5 / (j + 1))
        lists.append((rows, rng.integers(900, 1000, len(rows)) * (j + 1)))
    scored = lexical_search.search_shard(lists, np.arange(4000), best)
    whole = np.zeros(4000, np.int64)
    for rows, parts in lists:
        whole[rows] += parts
    expected = np.lexsort((np.arange(4000), -whole))[:5]
    assert best.ids.tolist() == expected.tolist() and best.scores.tolist() == whole[expected].tolist()
    assert scored < 400


def test_length_factor_beyond_64_bits():
    n, big = np.array([0, 10**9], np.int64), 10**12
    assert lexical_search.length_factor(n, big, 10**13).tolist() == [75, 75 + 25 * 10**9 * big // 10**13]


def test_search_empty(spark, nothing, cases, items):
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(cases[0], spark.createDataFrame([], ITEM)).count() == 0


def test_terms_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"é{rng.randrange(99)}" for _ in range(3000)).encode(), b"", b"x" * 9000, b"-- A,b\xc3\xa9;"]
    whole = terms.term_hashes(texts)
    monkeypatch.setattr(terms, "SLICE_BYTES", 500)
    assert all((a == b).all() for a, b in zip(whole, terms.term_hashes(texts)))
    assert whole[1].tolist() == [3000, 0, 1, 2]


# ---- decontamination


def brute_hits(rows, item_rows, window=10):
    windows = {}
    for item_id, text in {(r[0], r[1] or "") for r in item_rows}:
        w = words_of(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item_id is None else str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w, hit, found = words_of(r[1]), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i:i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((r[0], len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_hits(cases, items, item_rows):
    docs, rows = cases
    got = decontamination.hits(docs, items).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(rows, item_rows)


def test_hits_in_blocks(cases, items, item_rows, monkeypatch):
    monkeypatch.setattr(terms, "ITEM_BYTES", (600, 600))
    docs, rows = cases
    got = decontamination.hits(docs, items).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(rows, item_rows)


def test_clean(spark, cases, items, item_rows, nothing):
    docs, rows = cases
    docs = docs.withColumn("hit_id", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("n_hit", F.lit(3))
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns
    expected = sorted(str(i) for i, _, n, _ in brute_hits(rows, item_rows) if not n)
    assert sorted(str(r.doc_id) for r in left.collect()) == expected
    assert decontamination.clean(nothing, items).count() == 0
    assert decontamination.clean(docs, spark.createDataFrame([], ITEM)).count() == len(rows)


def test_longest_matches(cases, items, item_rows):
    docs, rows = cases
    texts = [(r[0], words_of(r[1])) for r in rows]
    expected = []
    for item_id, text in {(r[0], r[1] or "") for r in item_rows}:
        w, best = words_of(text), None
        for i, d in texts:
            where = {}
            for p, word in enumerate(d):
                where.setdefault(word, []).append(p)
            for s, word in enumerate(w):
                for p in where.get(word, ()):
                    n = 0
                    while s + n < len(w) and p + n < len(d) and w[s + n] == d[p + n]:
                        n += 1
                    new = (-n, s, order(i), p, i)
                    best = min(new, best or new)
        if best:
            expected.append((item_id, -best[0], best[1], best[4], best[3]))
    got = decontamination.longest_matches(docs, items).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("depth", [1, 3, 10, 60])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    text = np.concatenate([rng.integers(0, 3, 200), np.ones(80, int), rng.integers(0, 3, 40)])
    order_ = decontamination.suffix_array(text, depth)
    assert sorted(order_.tolist()) == list(range(len(text)))
    cut = [text[i:i + depth].tolist() for i in order_]
    assert cut == sorted(cut)


# ---- hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, id int, number string, block int"


def vector_rows():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.3) for x in c]
        rows.append((i, v, rng.randrange(3)))
    same = rows[17][1]
    rows += [(400 + i, same, i % 2) for i in range(60)]
    rows += [(500, None, 1), (501, [1.0, None] * 3, 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] * 6, 0)]
    rows += [(504, rows[3][1], None), (505, [], 1), (600, [0.5, 0.25], 0), (700, [0.0] * 6, 2), (None, rows[5][1], 1)]
    rows += [rows[100], (200, rows[7][1], 2), rows[30], (800, [1e30] * 6, 1)]
    return [(*r, 1, "n", 2) for r in rows]


def brute_negatives(rows, k=5, m=10):
    taken = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in v) < 2**52:
            taken.append((i, v + [0] * (6 - len(v)), label))
    out = []
    for a, va, la in (t for t in taken if t[0] is not None and t[0] % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(va, v)), order(i), i, label) for i, v, label in taken if i != a]
        for p in sorted(s for s in scored if s[3] == la)[:k]:
            fit = sorted(s for s in scored if s[3] != la and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:m]
            out += [(a, p[2], r, s[2], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def test_hard_negatives(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, F.col("label"))
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    expected = brute_negatives(rows)
    assert len(expected) > 100 and sorted((tuple(r) for r in got), key=str) == expected


def test_hard_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 500)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, F.col("label"))
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_negatives(rows)


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("id") % 100 == 0, F.col("label")).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, 1, "", 1)], VECTORS)
    assert hard_negatives.mine(alone, F.col("id") % 100 == 0, F.col("label")).count() == 0


def test_cover_tree():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 300, (20, 5))
    points = np.floor(centres[rng.integers(0, 20, 1500)] + rng.normal(0, 12, (1500, 5)))
    points[200:400] = points[7]
    order_, nodes, radii = hard_negatives.cover_tree(points)
    assert sorted(order_.tolist()) == list(range(1500))
    reach = (points**2).sum(1)
    tall = np.column_stack([points, np.sqrt(reach.max() - reach)])
    leaves = np.zeros(1500, int)
    for (c, parent, level, begin, end, leaf), r in zip(nodes.tolist(), radii):
        below = order_[begin:end]
        assert np.linalg.norm(tall[below] - tall[c], axis=1).max() <= r and c in below
        if parent >= 0:
            assert nodes[parent][3] <= begin and end <= nodes[parent][4] and level == nodes[parent][2] + 1
        leaves[begin:end] += leaf
    assert (leaves == 1).all()
    blob = {
        "size": 5, "ids": order_.astype("<i8").tobytes(), "labels": np.zeros(1500, "<i8").tobytes(),
        "vectors": points[order_].astype("<i4").tobytes(), "radii": radii.tobytes(),
    }
    place = np.empty(1500, int)
    place[order_] = np.arange(1500)
    nodes[:, 0] = place[nodes[:, 0]]
    tree = hard_negatives.Tree(blob | {"nodes": nodes.astype("<i8").tobytes()})
    anchor = points[11]
    low, high = tree.bounds(anchor[None])
    for n, (a, b) in enumerate(zip(tree.begin, tree.end)):
        products = tree.points[a:b] @ anchor
        assert low[0, n] <= products.min() and products.max() <= high[0, n]
    best = np.sort(points @ anchor)[-5]
    met = tree.leaves(low, high, np.array([best]), np.array([np.inf]))[0]
    assert (tree.end - tree.begin)[met].sum() < 800  # bounds leave most candidates out

