import random

import pytest

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, root string, size int, "
    "key string, extra int, `odd name` string, lines_kept int"
)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    picked = [f"w{rng.randrange(vocabulary)}x" for _ in range(words)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in picked)


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def case_rows() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    texts = list(base)
    texts += [base[0], base[0] + "  ", base[0].replace(" ", "\t", 1), base[1].upper(), base[2]]
    texts += [edited(rng, base[3], share) for share in (0.01, 0.02, 0.03, 0.05, 0.3)]
    passage = prose(rng, 60)
    texts += [prose(rng, 15) + "\n" + passage + "\n" + prose(rng, 15) for _ in range(6)]
    texts += [None, None, "", "", " ", "\n\n", "one", "One", "two words", "two  words", "a b c d e", "a b c d f"]
    texts += ["same line here\n" * 8 + prose(rng, 60), "日本語のテキスト " * 40, "naïve café́ ΣΑΣ\x1c\x85 end", "#$% ** " * 50]
    texts += ["\n".join(prose(rng, 12) for _ in range(400)), prose(rng, 9000), "x" * 30000]
    rows = [(3 * i - 20, t, "en", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[5], None, None, None), (None, None, None, None, None)]
    return [(*r, 0.5, "r", 1, "k", 2, "o", 3) for r in rows]


@pytest.fixture(scope="session")
def cases(spark):
    rows = case_rows()
    return spark.createDataFrame(rows, COLUMNS).repartition(3), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
