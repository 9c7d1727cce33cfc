"""Exact, line, suffix and shingle duplicates against brute force, edge cases included."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from citegrain.llm import exact_dedup, line_dedup, queries, shingle_join, suffix_dedup

LAST = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"


def key(doc_id):
    return LAST if doc_id is None else doc_id


@pytest.mark.parametrize("bits, hashed", [(None, exact_dedup.hash64), (3, lambda d: (d[0] & 3) - 2 << 61)])
def test_exact(cases, bits, hashed):
    docs, rows = cases
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        first = min(map(key, ids))
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, None if first == LAST else first, len(ids), digest) for i in ids]
    found = exact_dedup.duplicates(docs, capacity=500, bits=bits, hashed=hashed).collect()
    assert sorted(map(repr, want)) == sorted(repr((r[0], r[1], r[2], r[4])) for r in found)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_empty(nothing):
    assert exact_dedup.duplicates(nothing).collect() == []


def clusters(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def gram_set(text, n=5):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i:i + n]) for i in range(len(words) - n + 1)])


def test_shingle_join(cases):
    docs, rows = cases
    sets = {i: gram_set(r[1]) for i, r in enumerate(rows)}
    of = clusters(sets, 80)
    first = {}
    for i, r in enumerate(rows):
        first[of[i]] = min(first.get(of[i], LAST), key(r[0]))
    want = sorted((key(r[0]), len(sets[i]), first[of[i]] if sets[i] else key(r[0])) for i, r in enumerate(rows))
    assert sorted(tuple(r) for r in shingle_join.groups(docs).collect()) == want
    kept = shingle_join.one_per_group(docs)
    assert kept.columns == docs.columns
    assert {key(r.doc_id) for r in kept.collect()} == {w[2] for w in want}


def test_shingle_join_of_a_large_group(spark):
    """Copies with edits of their own: few pairs of them are similar, all are to the original."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(200), 3):
            words[j] = f"e{rng.randrange(10**9)}"
        rows.append((2 + i, " ".join(words)))
    sets = {i: gram_set(t) for i, t in rows}
    of = clusters(sets, 80)
    got = shingle_join.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.id: r.component_id for r in got} == of and len(set(of.values())) == 1


def test_gram_sets_take_a_slice_at_a_time():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice((0, 1, 3, 40, 900)))).encode() for _ in range(2000)]
    shingle_join.gram_sets(texts[:9])  # tables that are kept
    tracemalloc.start()
    grams, sizes = shingle_join.gram_sets(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one_by_one = [shingle_join.gram_sets([t]) for t in texts]
    assert grams.tolist() == [g for found, _ in one_by_one for g in found.tolist()]
    assert sizes.tolist() == [s.tolist()[0] for _, s in one_by_one]
    assert most < 2 * grams.nbytes + (24 << 20) < 20 * sum(map(len, texts))


def test_shingle_join_empty(nothing):
    assert shingle_join.groups(nothing).collect() == []
    assert shingle_join.one_per_group(nothing).collect() == []


def line_set(line):
    units = line.encode("utf-16-be")
    return frozenset(units[2 * i:2 * i + 10] for i in range(max(len(units) // 2 - 4, 1)))


def test_line_dedup(cases):
    docs, rows = cases
    places, sets = defaultdict(list), {}
    for r in rows:
        for pos, line in enumerate((r[1] or "").split("\n")):
            norm = line.lower().strip(" \t\n\x0b\f\r")
            if norm:
                places[norm].append((key(r[0]), pos))
                sets[norm] = line_set(norm)
    of = clusters(sets, 80)
    first = {}
    for norm, found in places.items():
        first[of[norm]] = min([first.get(of[norm], (LAST, LAST)), *found])
    want = sorted((i, p) for norm, found in places.items() for i, p in found if (i, p) != first[of[norm]])
    got = sorted((r.id, r.pos) for r in line_dedup.doubled_lines(docs).collect())
    assert got == want
    left = line_dedup.dedup_lines(docs)
    assert left.columns[: len(docs.columns)] == docs.columns and left.count() == len(rows)
    gone = set(want)
    for r in left.collect():
        source = [x for x in rows if key(x[0]) == key(r.doc_id)]
        texts = ["\n".join(line for p, line in enumerate((x[1] or "").split("\n")) if (key(x[0]), p) not in gone) for x in source]
        assert (r.text or "") in texts
    kept = line_dedup.drop_emptied(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_line_dedup_of_templates(spark):
    """Families that share most of their shingles fill the same buckets; each has a near copy of its own."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for family in range(60):
        own = [f"f{family}n{i}" for i in range(10)]
        for copy in range(2):
            words = template + own
            words[5 + rng.randrange(50)] = f"e{family}c{copy}"
            rows.append((len(rows), " ".join(words)))
    of = clusters({i: line_set(t) for i, t in rows}, 80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(r.id for r in line_dedup.doubled_lines(docs).collect())
    assert got == [i for i, first in sorted(of.items()) if i != first] and len(got) == 60


def test_line_dedup_of_edited_lines(spark):
    """One letter more in lines of 10 to 20 words and in long unbroken ones; random lines stay."""
    rng = random.Random(6)
    rows, pairs = [], []
    for n in [10, 15, 20] * 40 + [0] * 40:
        letters = "abcdefghijklmnop"
        line = "".join(rng.choices(letters, k=200)) if not n else " ".join("".join(rng.choices(letters, k=6)) for _ in range(n))
        at = rng.randrange(1, len(line) - 1)
        other = line[:at] + "z" + line[at:]
        pairs.append((len(rows), len(rows) + 1, len(line_set(line) & line_set(other)) / len(line_set(line) | line_set(other))))
        rows += [(len(rows), line), (len(rows) + 1, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.id for r in line_dedup.doubled_lines(docs).collect()}
    similar = {b for _, b, j in pairs if j >= 0.8}
    assert len(similar) > 150 and got <= similar and len(got) >= 0.97 * len(similar)


def test_line_dedup_keeps_clear_of_names(spark, cases):
    docs = cases[0].selectExpr("*", "1 AS any_left", "2 AS any_left_", "3 AS lines_dropped")
    assert line_dedup.drop_emptied(docs).columns == docs.columns
    found = shingle_join.one_per_group(docs.selectExpr("*", "4 AS _stays", "5 AS stays"))
    assert found.columns[-2:] == ["_stays", "stays"] and found.count() > 0


def test_line_dedup_query_of_null_ids(spark, tmp_path):
    """A null id is the last in the order: its copies are reported like all others."""
    rows = [(1, "one line\nanother line", "en", "s", 1), (None, "of its own\nanother line\none line", "en", "s", 1)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.gone) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0, None), None: (3, 2, [1, 2])}


def test_values_are_compared_and_banded_without_writing_them_out(spark):
    """Code for each value by itself grows too large to be compiled."""
    rng = random.Random(2)
    rows = [(i, 0, [rng.randrange(3) for _ in range(line_dedup.VALUES)]) for i in range(40)]
    lines = spark.createDataFrame(rows, "n bigint, kind int, values array<int>")
    both = lines.crossJoin(lines.selectExpr("n AS m", "values AS others"))
    agreed = both.select("n", "m", line_dedup.agreement("values", "others").alias("agreed"))
    assert all(r.agreed == sum(x == y for x, y in zip(rows[r.n][2], rows[r.m][2])) for r in agreed.collect())
    marks = both.select("*", line_dedup.marked("values").alias("ma"), line_dedup.marked("others").alias("mb"))
    for r in marks.withColumn("most", line_dedup.most_agreement("ma", "mb")).collect():
        assert r.most == sum(x & 3 == y & 3 for x, y in zip(r["values"], r.others))
    for found in (agreed, line_dedup.more_buckets(lines.selectExpr("n", "0L AS bucket", "n AS root"), lines.select("n", "values"))):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("values") < line_dedup.VALUES
    sets = line_dedup.bands()
    held = defaultdict(set)
    for n, _, values in rows:
        for b, of in enumerate(sets):
            held[b, *(values[j] for j in of)].add(n)
    got = defaultdict(set)
    for r in line_dedup.bucketed(lines).collect():
        got[r.bucket].add(r.n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in held.values() if len(x) > 1)


def test_buckets_of_lines_take_one_pass(spark):
    """Hardly any bucket holds two lines: they are dealt once, and all pairs of up to three lines meet their hubs."""
    rng = random.Random(3)
    rows = [(i, 0, [rng.randrange(3) for _ in range(line_dedup.VALUES)]) for i in range(60)]
    lines = spark.createDataFrame(rows, "n bigint, kind int, values array<int>")
    met = line_dedup.bucketed(lines)
    open_ = lines.selectExpr("n", "0L AS bucket", "n % 7 AS root")
    for found in (met, line_dedup.split_only(open_)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == (found is met) and "Join" not in plan and plan.count("Window ") == 1
    held = defaultdict(dict)
    for r in met.collect():
        held[r.bucket][r.n] = r.hubs
        assert len(set(r.hubs)) == len(r.hubs) <= 4
    for members in held.values():
        assert all(set(hubs) <= set(members) for hubs in members.values())
        if len(members) <= 3:
            assert all(a in members[b] or b in members[a] for a in members for b in members if a != b)
    assert {r.n for r in line_dedup.split_only(open_).collect()} == set(range(60))
    assert line_dedup.split_only(open_.where("root = 1")).collect() == []


def test_words_hold_the_low_bits_of_all_values(spark):
    rng = random.Random(8)
    rows = [(i, i // 2, [rng.choice((7, -1, 263, rng.getrandbits(31) - 2**30)) for _ in range(24)]) for i in range(40)]
    values = spark.createDataFrame(rows, "n bigint, line bigint, values array<int>")
    values = values.select("n", "line", "values", *line_dedup.words("values"))
    both = line_dedup.with_words(values, "p", "lp").crossJoin(line_dedup.with_words(values, "q", "lq"))
    for r in both.select("p", "q", line_dedup.agreed("p", "q").alias("agreed")).collect():
        assert r.agreed == sum(x & 255 == y & 255 for x, y in zip(rows[r.p][2], rows[r.q][2]))
    met = spark.createDataFrame([(n, 5, 40, [0, 39]) for n in range(40)], "n bigint, bucket bigint, held bigint, hubs array<bigint>")
    want = defaultdict(int)
    for p in range(40):
        for q in {0, 39}:
            a, b = sorted((rows[p][1], rows[q][1]))
            n = sum(x & 255 == y & 255 for x, y in zip(rows[p][2], rows[q][2]))
            if a != b and n >= line_dedup.AGREED:
                want[a, b] = max(want[a, b], n)
    assert {(r.a, r.b): r.agreed for r in line_dedup.with_hubs(met, values).collect()} == want and want


def test_outlines_bound_the_similarity(spark):
    """No similar pair is left out, most others of lines of ordinary length are; long lines fill all bits."""
    rng = random.Random(12)
    lines = ["", "abc", "日本語のテキスト", "a" * 300, "ab" * 200, "😀" * 9]
    for n in (3, 30, 60, 2000):
        base = [f"w{rng.randrange(10**5)}" for _ in range(n)]
        for share in (0, 0.01, 0.03, 0.1, 0.2, 0.3, 0.3):
            lines.append(" ".join(f"e{rng.randrange(10**5)}" if rng.random() < share else w for w in base))
    texts = spark.createDataFrame([*enumerate(lines)], "n bigint, norm string")
    pairs = [(a, b) for b in range(len(lines)) for a in range(b)]
    left = line_dedup.may_be_similar(spark.createDataFrame(pairs, "a bigint, b bigint"), texts, 0.8).collect()
    left = {(r.a, r.b) for r in left}
    sets = [line_set(x) for x in lines]
    of = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    assert {p for p, j in of.items() if j >= 0.8} <= left
    far = {(a, b) for (a, b), j in of.items() if j < 0.6 and all(100 < len(sets[x]) < 500 for x in (a, b))}
    assert len(far) > 50 and not far & left


def test_line_dedup_empty(nothing):
    assert line_dedup.dedup_lines(nothing).collect() == []


@pytest.mark.parametrize("most", [1 << 28, 3000])
def test_suffix_order(most):
    rng = np.random.default_rng(3)
    for k in range(12):
        text = rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(1, 1500)))
        if k % 3 == 0:
            text = np.tile(text[: max(2, len(text) // 7)], 9)
        order = suffix_dedup.suffix_order(text, 257, 50, most)
        whole = text.astype(np.uint8).tobytes()
        starts = [whole[i:i + 50] for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and starts == sorted(starts)


def test_suffixes_are_taken_from_queues_in_large_blocks(monkeypatch):
    """A call a block of few suffixes would cost more than the suffixes."""
    calls = []
    deal = suffix_dedup.Queues.deal
    monkeypatch.setattr(suffix_dedup.Queues, "deal", lambda *a: calls.append(1) or deal(*a))
    text = np.random.default_rng(5).integers(1, 60, 20000)
    order = suffix_dedup.suffix_order(text, 257, 50)
    whole = text.astype(np.uint8).tobytes()
    starts = [whole[i:i + 50] for i in order]
    assert starts == sorted(starts) and len(calls) < 3000


def test_suffix_dedup(cases):
    docs, rows = cases
    earlier, want = {}, []
    raws = [(key(r[0]), (r[1] or "").encode()) for r in rows]
    for i, raw in raws:
        for p in range(len(raw) - 49):
            window = raw[p:p + 50]
            earlier[window] = min(earlier.get(window, i), i)
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if earlier[raw[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((None if i == LAST else i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = [tuple(r) for r in suffix_dedup.dedup(docs).collect()]
    assert sorted(map(repr, [(*g[:5], bytes(g[5])) for g in got])) == sorted(map(repr, want))
    assert any(w[2] for w in want)


def test_suffix_dedup_empty(nothing):
    assert suffix_dedup.dedup(nothing).collect() == []
