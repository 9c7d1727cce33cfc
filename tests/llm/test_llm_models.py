"""Classifier, rules, language model, mixing, packing and the token store, edge cases included."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citegrain.llm import class_lm, crf, grammar_store, mixing, packing, quality_rules, tokens
from citegrain.llm.queries import op7_quality_classifier, op9_class_lm
from citegrain.llm.texts import labels
from citegrain.llm.tokens import Encoder

WORD = r"[^\x20\x09-\x0D]+"
WORDS_FILE, BYTES_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    chain = crf.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    counts = np.array([3, 1, 5])
    x = rng.normal(size=(9, 3))
    at, want = 0, []
    for n in counts:
        total = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            score = sum(float(x[at + t] @ chain.theta) for t in range(n) if path[t])
            score += sum(chain.moves[a, b] for a, b in zip(path, path[1:]))
            for t in range(n):
                total[t, path[t]] += math.exp(score)
        want += (total[:, 1] / total.sum(axis=1)).tolist()
        at += n
    assert np.allclose(chain.marginals(x, counts), want)


def test_classifier_on_held_out_documents(spark):
    scored = op7_quality_classifier(spark, SF_DIR).join(labels(spark, SF_DIR), "doc_id").toPandas()
    held = scored[scored.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert scored.score.between(0, 1).all()


def test_classifier_edges(spark, cases, nothing):
    docs, rows = cases
    marks = spark.createDataFrame([(r[0], int(i % 3 > 0)) for i, r in enumerate(rows)] + [(None, 1)], "doc_id bigint, quality int")
    chain = crf.fit(docs, marks)
    scored = crf.with_score(docs, chain, "q").collect()
    assert len(scored) == len(rows) and all(0 <= r.q <= 1 for r in scored)
    by_text = defaultdict(set)
    for r in scored:
        by_text[r.text or ""].add(r.q)
    assert all(len(v) == 1 for v in by_text.values())
    kept = crf.keep_good(docs, chain)
    assert kept.columns == docs.columns
    blank = crf.fit(nothing, marks)
    assert crf.with_score(nothing, blank, "q").collect() == []
    assert {r.q for r in crf.with_score(docs, blank, "q").collect()} == {0.5}


def base_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def plain_em(votes, rounds=1000):
    """Posteriors of rows of votes: two classes, each rule's three answers counted for each class, row by row."""
    said = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(-math.log(9) * votes.sum(axis=1)))
    for _ in range(rounds):
        before, logs = good, 0
        for sign, share in ((1, good), (-1, 1 - good)):
            rates = (1 + np.einsum("i,irv->rv", share, said)) / (3 + share.sum())
            logs = logs + sign * (np.einsum("irv,rv->i", said, np.log(rates)) + math.log(1 + share.sum()))
        good = 1 / (1 + np.exp(-np.clip(logs, -700, 700)))
        if np.abs(good - before).max() <= 1e-9:
            break
    return good


def votes_of(judged):
    names = [c for c in judged[0].asDict() if c.startswith("vote_")]
    return np.array([[r[n] for n in names] for r in judged])


def test_rules(cases, nothing):
    docs, rows = cases
    judged = quality_rules.judged(quality_rules.base_counts(docs)).collect()
    got = [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in judged]
    assert sorted(got) == sorted(base_counts(r[1]) for r in rows)
    for r, p in zip(judged, plain_em(votes_of(judged))):
        assert math.isclose(r.posterior, p, rel_tol=1e-6, abs_tol=1e-9)
        assert r.good == (r.posterior >= 0.5)
    assert quality_rules.judged(quality_rules.base_counts(nothing)).collect() == []


def test_verdicts_equal_plain_em_and_labels(spark):
    """Of labelled documents that the base rules pass, the bad ones go and the good ones stay."""
    docs, marks = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judged(quality_rules.base_counts(docs)).collect()
    assert [r.good for r in judged] == list(plain_em(votes_of(judged)) >= 0.5)
    quality = {r.doc_id: r.quality for r in marks.collect()}
    passed = [r for r in judged if r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words]
    good = [r.good for r in passed if quality.get(r.doc_id) == 1]
    bad = [r.good for r in passed if quality.get(r.doc_id) == 0]
    assert good and bad and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_em_finds_share_and_rates_of_each_class():
    rng = random.Random(8)
    right = ((0.98, 0.9), (0.9, 0.95), (0.8, 0.9), (0.86, 0.7))  # of bad, of good documents
    patterns = Counter()
    for _ in range(40_000):
        good = rng.random() < 0.7
        truth = 1 if good else -1
        patterns[tuple(0 if rng.random() < 0.3 else truth if rng.random() < a[good] else -truth for a in right)] += 1
    found = quality_rules.estimate(patterns)
    assert abs(found.prior - 0.7) < 0.02
    for r, chances in enumerate(right):
        assert all(abs(a - b) < 0.03 for a, b in zip(found.accuracy(r), chances))


def test_language_model_base_and_held_out(spark):
    scored = op9_class_lm(spark, SF_DIR)
    texts = {r.doc_id: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + ["\n"]
             for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    check_base(scored.collect(), texts)
    held = scored.where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum()


def plain_class_scores(texts, held, vocabulary, classes):
    """log10 probabilities of the texts, with counts and the parallel sweep written out."""
    counts = Counter(w for i, words in texts.items() if not held[i] for w in words)
    key = {w: int(class_lm.word_keys([w.encode()])[0][0]) for words in texts.values() for w in words[:-1]}
    chosen = sorted((w for w in counts if w in key and counts[w] > 1), key=lambda w: (-counts[w], key[w]))[:vocabulary]
    end, total = classes + 4, classes + 5

    def shape(w):
        return 2 * (w[-1] in ".,;:!?|*&%$#") + (len(w.encode()) > 6)

    def pairs_of(name):
        found = Counter()
        for i, words in texts.items():
            if not held[i]:
                found.update((name(a), name(b)) for a, b in zip(["\n", *words], words))
        return found

    slot = {w: r for r, w in enumerate(chosen)} | {"\n": len(chosen) + 4}
    pairs = np.zeros((len(chosen) + 5,) * 2)
    for (a, b), n in pairs_of(lambda w: slot.get(w, len(chosen) + shape(w))).items():
        pairs[a, b] = n
    of = class_lm.exchange(pairs, len(chosen), classes)
    known = {w: int(of[r]) for w, r in slot.items()}
    first = lambda w: known.get(w, classes + shape(w))
    joint = pairs_of(first)
    row, column = Counter(), Counter()
    for (a, b), n in joint.items():
        row[a] += n
        column[b] += n

    def grown(x, n):
        return (x + n) * math.log(x + n) - (x * math.log(x) if x else 0)

    near = defaultdict(Counter)
    for i, words in texts.items():
        line = ["\n", *words]
        for a, w, b in zip(line, line[1:], line[2:]) if not held[i] else ():
            near[w][0, first(a)] += 1
            near[w][1, first(b)] += 1
    full = dict(known)
    for w, n in counts.items():
        if n > 1 and w not in known:
            gains = [
                sum(grown(joint[(x, c) if side == 0 else (c, x)], k) for (side, x), k in near[w].items())
                - grown(row[c], n) - grown(column[c], n) for c in range(classes)
            ]
            full[w] = max(range(classes), key=lambda c: (round(gains[c], 9), -c))
    kind = lambda w: full.get(w, classes + shape(w))
    moves = pairs_of(kind)
    matrix = np.zeros((total, total))
    for (a, b), n in moves.items():
        matrix[a, b] = n
    once = Counter(shape(w) for w, n in counts.items() if n == 1 and w in key)
    inside = Counter()
    for w, n in counts.items():
        inside[kind(w)] += n
    logs = class_lm.smoothed(matrix)

    def word(w):
        k = kind(w)
        if k == end:
            return 0
        if k < classes:
            return math.log10(counts[w] / inside[k])
        return math.log10((counts[w] + 0.5) / (inside[k] + 0.5 * (once[k - classes] + 1)))

    return {i: sum(logs[kind(a), kind(b)] + word(b) for a, b in zip(["\n", *words], words)) for i, words in texts.items()}


def test_class_scores_equal_a_plain_model(spark):
    rng = random.Random(3)
    words = [f"{c}{'x' * (n % 9)}{'.' * (n % 5 == 0)}" for n, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 3)]
    texts = {i: [rng.choice(words[:8 + 70 * (j % 3 == i % 3)]) for j in range(rng.randrange(60))] for i in range(120)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    texts = {i: [*t, "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    want = plain_class_scores(texts, held, 12, 4)
    for r in class_lm.scores(docs.repartition(3), vocabulary=12, classes=4).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9), r


def check_base(scored, texts):
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, words in texts.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    for r in scored:
        words = texts[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_language_model_edges(spark, cases, nothing):
    docs, rows = cases
    first = {r[0]: r for r in reversed(rows)}
    unique = spark.createDataFrame(list(first.values()), docs.schema)
    texts = {i: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + ["\n"] for i, r in first.items()}
    check_base(class_lm.scores(unique, vocabulary=50, classes=4).collect(), texts)
    every = class_lm.scores(docs, vocabulary=50, classes=4).collect()
    assert len(every) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in every)
    assert class_lm.scores(nothing).collect() == []
    alone = [r.doc_id for r in every if r.held_out]
    untrained = class_lm.scores(docs.where(docs.doc_id.isin(alone)), vocabulary=5, classes=2).collect()
    assert untrained and all(r.n_known == 0 and math.isfinite(r.score) for r in untrained)


def test_texts_of_a_batch_are_held_slice_by_slice():
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text[i:i + 4000] for i in range(0, len(text), 4000)] * 20)})
    whole = pa.chunked_array([batch.column(0), pa.array(["", text], pa.string())])
    got = [(b - a, t) for a, b, texts in class_lm.byte_slices(whole) for t in texts]
    assert [t.decode() for _, t in got] == whole.to_pylist() and got[-1][0] == 1

    class Frame:  # keeps the function that a task runs
        def select(self, _):
            return self

        def mapInArrow(self, function, _):
            self.function = function
            return self

    frame = Frame()
    class_lm.beside(frame, class_lm.Seeds(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((5, 5))), 1)
    class_lm.word_keys([b"one"])  # tables that are kept
    tracemalloc.start()
    assert sum(r.num_rows for r in frame.function([batch])) >= 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * batch.nbytes  # texts and their bytes alone would be more


def test_exchange_raises_mutual_information():
    rng = np.random.default_rng(2)
    kinds = np.arange(24) // 6
    pairs = np.zeros((25, 25))
    for a in range(24):
        for b in range(24):
            pairs[a, b] = rng.poisson(30 if (kinds[a] + 1) % 4 == kinds[b] else 1)
    pairs[24, :24] = 5
    pairs[:24, 24] = 5

    def information(of):
        member = np.eye(of.max() + 1)[of]
        joint = member.T @ pairs @ member
        joint = joint / joint.sum()
        return (joint * np.log(np.maximum(joint, 1e-300) / np.outer(joint.sum(1), joint.sum(0)).clip(1e-300))).sum()

    of = class_lm.exchange(pairs, 24, 4, sweeps=8)
    start = np.append(np.arange(24) % 4, 4)
    assert information(of) > information(start)
    assert all(len(set(of[:24][kinds == k])) == 1 for k in range(4))
    joint = np.eye(5)[of].T @ pairs @ np.eye(5)[of]
    assert np.allclose((10 ** class_lm.smoothed(joint)).sum(axis=1), 1)


def level(sizes, weights, most=3.0):
    goals, rest, active = {}, float(sum(sizes.values())), set(sizes)
    while True:
        total = sum(weights[s] for s in active)
        over = [s for s in active if rest * weights[s] / total > most * sizes[s]]
        if not over:
            return goals | {s: rest * weights[s] / total for s in active}
        for s in over:
            goals[s] = most * sizes[s]
            rest -= goals[s]
            active.discard(s)


def test_mixing(cases, nothing):
    docs, rows = cases
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(WORD, r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = level(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(re.findall(WORD, r.row.text or "")) and r.source_size == sizes[r.row.source]
        assert math.isclose(r.target, goals[r.row.source], rel_tol=1e-9) and 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r.size
        largest[r.row.source] = max(largest[r.row.source], r.size)
    assert all(abs(taken[s] - goals[s]) <= largest[s] / 2 + 1 for s in goals)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.row.doc_id, r.row.text, r.copies) for r in again) == Counter((r.row.doc_id, r.row.text, r.copies) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("path, words", [(WORDS_FILE, True), (BYTES_FILE, False)])
def test_encoder_equals_whole_text(cases, path, words):
    tokenizer = Tokenizer.from_file(path)
    odd = ["", " ", "  a", "a ", "a  b", "a\n\nb", "a \n b", "a\tb", "it's  don't\x1cq", "\x85x y", "x 　y", "\na", "a\r\nb", "a.,b c.", "ok!? x's."]
    encoder = Encoder(path, words)
    for text in [*odd, *[r[1] or "" for r in cases[1]]]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_packing(cases, nothing):
    docs, rows = cases
    tokenizer = Tokenizer.from_file(WORDS_FILE)
    pieces = packing.pack(docs, WORDS_FILE, capacity=256, classes=8).toPandas()
    assert pieces.length.sum() == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 256
        full = int(seq.length.sum())
        assert seq.padding.iloc[0] == (0 if full & (full - 1) == 0 else 256 - full)
    for p in pieces.itertuples():
        assert zlib.crc32(p.tokens) == p.ids_crc32 and len(p.tokens) == 4 * p.length
    texts = Counter(r[0] for r in rows)
    for r in rows:
        if texts[r[0]] == 1 and r[0] is not None:
            own = pieces[pieces.doc_id == r[0]].sort_values("start")
            ids = np.frombuffer(b"".join(own.tokens), "<u4").tolist()
            assert ids == [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
            assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    padding = pieces.groupby("sequence_id").padding.first().sum()
    assert padding < 0.02 * pieces.length.sum()
    assert packing.pack(nothing, WORDS_FILE).collect() == []


def test_repair_round_trip():
    rng = np.random.default_rng(6)
    for k in range(8):
        counts = rng.integers(1, 90, 60).tolist()
        ids = rng.choice(5 if k % 2 else 2, sum(counts)).astype("<u4")
        if k == 3:
            ids[:] = 5
        payload = grammar_store.to_file([None, *range(59)], counts, ids, 50, 7)
        shard = grammar_store.Shard(payload)
        assert shard.keys == [None, *range(59)] and shard.earlier == 7 and shard.ids == len(ids)
        at = 0
        for i, n in enumerate(counts):
            assert shard.document(i).tolist() == ids[at:at + n].tolist()
            at += n
        assert [d.tolist() for d in shard.documents()] == [shard.document(i).tolist() for i in range(60)]
        assert len(shard.rules) and len(shard.symbols) < len(ids)


def test_repair_goes_on_while_a_pair_pays():
    rng = np.random.default_rng(7)
    for most in (2, 4096):
        ids, last = rng.zipf(1.3, 20_000) % 40, rng.random(20_000) < 0.01
        last[-1] = True
        symbols, rules = grammar_store.repair(ids.astype("<u4"), last.copy(), 40, most=most)
        lengths = grammar_store.rule_lengths(rules, 40)
        ends = np.cumsum(np.where(symbols < 40, 1, lengths[symbols - 40]))
        inside = ~last[ends - 1][:-1]
        pairs = Counter(zip(symbols[:-1][inside].tolist(), symbols[1:][inside].tolist()))
        assert len(rules) and max(pairs.values()) < 4 and set(np.flatnonzero(last) + 1) <= set(ends.tolist())


def test_texts_are_encoded_together(cases, monkeypatch):
    """A slice's pieces are looked up once each, and the ids are those of every text by itself."""
    texts = [r[1] or "" for r in cases[1]] + ["plain words, here. Don't stop: 'em.\nnext line;x a.b!", "caf\u00e9, na\u00efve. a\u00a0b\u2003 c"]
    texts += [" lead", "trail ", "a\tb c", "tab\t end", "x\x1cy", "line\n\nline", "it's. we'll! 5. 5, <|endoftext|>."] * 3
    tokenizer = Tokenizer.from_file(BYTES_FILE)
    tokenizer.encode_special_tokens = True
    own = Encoder(BYTES_FILE, False)
    end = (7).to_bytes(4, "little")
    for least, turns in ((None, 1), (500, 2)):
        if least:
            monkeypatch.setattr(tokens, "CACHE_BYTES", least)
        for _ in range(turns):
            ids, sizes = own.many(texts, end)
            got = np.split(ids, np.cumsum(sizes)[:-1])
            assert [g.tolist() for g in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    plain, asked = [" ".join(f"w{i % 50}," for i in range(5000))] * 4, []
    monkeypatch.setattr(own, "_table", lambda pieces, table=own._table: asked.append(len(pieces)) or table(pieces))
    own.many(plain, end)
    assert sum(asked) < 200


def test_rules_are_expanded_once():
    ids = np.random.default_rng(8).zipf(1.2, 50_000).astype("<u4") % 60
    shard = grammar_store.Shard(grammar_store.to_file(list(range(50)), [1000] * 50, ids, 60, 0))
    asked, expand = [], shard.expand
    shard.expand = lambda symbols: asked.append(len(symbols)) or expand(symbols)
    assert np.concatenate(shard.documents()).tolist() == ids.tolist() and sum(asked) <= len(shard.rules)


def test_pairs_in_order():
    symbols = np.random.default_rng(9).integers(0, 40, 3000)
    at = np.flatnonzero(symbols[:-1] != 3)
    want = np.argsort(symbols[at] << 32 | symbols[at + 1], kind="stable").tolist()
    assert all(grammar_store._order(symbols, at, kinds).tolist() == want for kinds in (40, 1 << 30))


def test_store(cases, nothing):
    docs, rows = cases
    tokenizer = Tokenizer.from_file(BYTES_FILE)
    files = grammar_store.write(docs, BYTES_FILE, 0, 50257)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in grammar_store.read(files).collect())
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((at, r[0], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert grammar_store.read(grammar_store.write(nothing, BYTES_FILE, 0, 50257)).collect() == []
