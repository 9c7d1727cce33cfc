"""Quality by weak supervision: rules vote or abstain, and EM weighs them.

Each rule says good (1), bad (-1) or nothing (0) about a text.  How accurate a rule is and how common good
documents are is estimated by expectation-maximisation over the counts of the vote patterns of all documents;
a document is kept if its posterior probability of being good reaches a threshold.  Patterns number at most
3 to the power of the rules, so the driver holds a table of that size at most.

Everything is DataFrame operations; a text is read in one row and shuffled nowhere.  Defined results: a null
text has no words; an empty table gives an empty result; ties do not arise; repeated rows get equal results;
other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.texts import SPACE, whole_text

SYMBOLS = "#*$%&|<>"
WINDOW = 3
# What a rule can say: bad, nothing, good.
SAYS = (-1, 0, 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def base_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines) per document.

    For repeated words, windows of three become longs of hash bits above place bits; sorted, equal windows are
    neighbours, and a neighbour's words are compared before it counts.  The places of repeated windows,
    sorted, cover up to three words each, less what the next one covers.
    """
    whole = whole_text(text)
    step = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("t"))
    step = step.select("doc_id", "t", _words(F.col("t")).alias("w"))
    mask = F.expr("shiftleft(1L, cast(ceil(log2(cast(greatest(size(w), 2) as double))) as int)) - 1L")
    step = step.select("doc_id", "t", "w", mask.alias("mask"))

    def key(i: Column) -> Column:
        return F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.bitwise_not("mask"))

    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: key(i).bitwiseOR(i.cast("bigint")))
    windows = F.when(F.size("w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length(F.regexp_replace("t", f"{SPACE}+", ""))
    step = step.select(
        "doc_id", "t", "w", "mask", F.sort_array(windows).alias("k"), chars.cast("bigint").alias("word_chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
    )

    def at(i: Column) -> Column:
        return F.get("k", i).bitwiseAND(F.col("mask")).cast("int")

    def equal(i: Column, j: Column) -> Column:
        bits = F.get("k", i).bitwiseAND(F.bitwise_not("mask")) == F.get("k", j).bitwiseAND(F.bitwise_not("mask"))
        p, q = at(i), at(j)
        same = F.get("w", p) == F.get("w", q)
        for d in range(1, WINDOW):
            same = same & (F.get("w", p + d) == F.get("w", q + d))
        return F.coalesce(bits, F.lit(False)) & same

    again = F.filter("k", lambda _, i: equal(i, i + 1) | ((i > 0) & equal(i, i - 1)))
    places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("mask"))))
    step = step.select("doc_id", "t", "w", "word_chars", "n_dup_lines", places.alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1), x + WINDOW) - x)),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    symbols = F.length("t") - F.length(F.translate("t", SYMBOLS, ""))
    upper = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return step.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"), "word_chars", symbols.cast("bigint").alias("n_symbols"),
        "n_dup_lines", covered.alias("n_repeat_words"), upper.cast("bigint").alias("n_upper"),
        (F.size(F.split("t", "\n"))).cast("bigint").alias("n_lines"),
    )


def votes() -> dict[str, Column]:
    """The rules, over the columns of `base_counts`: 1 good, -1 bad, 0 no opinion."""
    words, chars = F.col("n_words"), F.greatest("word_chars", F.lit(1))
    symbols, upper, repeats = F.col("n_symbols"), F.col("n_upper"), F.col("n_repeat_words")
    copies, lines = F.col("n_dup_lines"), F.col("n_lines")
    mean = chars / F.greatest(words, F.lit(1))

    def bad(when: Column) -> Column:
        return F.when(when, -1).otherwise(0)

    even = (symbols * 100 <= chars) & (upper * 10 <= chars)
    return {
        "few_words": bad(words < 5),
        "symbols": bad(symbols * 20 > chars),
        "upper_case": bad(upper * 2 > chars),
        "repeats": bad(repeats * 5 > words * 2),
        "copied_lines": bad(copies * 3 > lines),
        "odd_words": bad((mean < 2) | (mean > 14)),
        "plain": F.when(even, 1).when(symbols * 5 > chars, -1).otherwise(0),
        "varied": F.when(even & (repeats * 5 <= words), 1).otherwise(0),
        "own_lines": F.when(even & (copies * 5 <= lines), 1).otherwise(0),
    }


@dataclass(frozen=True)
class Voters:
    """Share of good documents, and for each rule how often it says each of `SAYS` of bad and of good documents."""

    prior: float
    rates: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]

    def weight(self, rule: int, vote: int) -> float:
        bad, good = self.rates[rule]
        return math.log(good[SAYS.index(vote)]) - math.log(bad[SAYS.index(vote)])

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        odds += sum(self.weight(r, vote) for r, vote in enumerate(pattern))
        return 1 / (1 + math.exp(min(700.0, max(-700.0, -odds))))

    def accuracy(self, rule: int) -> tuple[float, float]:
        """How often the rule is right of bad and of good documents, where it speaks."""
        bad, good = self.rates[rule]
        return bad[0] / (bad[0] + bad[2]), good[2] / (good[0] + good[2])


def estimate(
    patterns: dict[tuple[int, ...], int], rounds: int = 1000, start: float = 0.9, close: float = 1e-9
) -> Voters:
    """EM on pattern counts, until no posterior moves by more than `close`.

    The share of good documents and every rate are estimated, silence included: a rule that says nothing of a
    document tells something too.  Only the start knows good from bad: there each vote is right with chance
    `start`.  Every count begins at one, so that no rate is zero.
    """
    rules, total = len(next(iter(patterns), ())), sum(patterns.values())
    weight = math.log(start) - math.log(1 - start)
    good = {p: 1 / (1 + math.exp(-weight * sum(p))) for p in sorted(patterns)}
    voters = Voters(0.5, (((1 / 3,) * 3,) * 2,) * rules)
    for _ in range(rounds if total else 0):
        held = [(p, n * (1 - good[p]), n * good[p]) for p, n in sorted(patterns.items())]
        sums = [sum(h[1] for h in held), sum(h[2] for h in held)]
        rates = [
            tuple(
                tuple((1 + sum(h[c + 1] for h in held if h[0][r] == vote)) / (len(SAYS) + sums[c]) for vote in SAYS)
                for c in (0, 1)
            )
            for r in range(rules)
        ]
        voters = Voters((1 + sums[1]) / (2 + total), tuple(rates))
        after = {p: voters.posterior(p) for p in good}
        moved, good = max(abs(after[p] - good[p]) for p in good), after
        if moved <= close:
            break
    return voters


def judged(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds `posterior` and `good` to the rows of `base_counts`; EM sees the patterns of all of them."""
    rules = votes()
    voted = counts.withColumns({f"vote_{k}": v for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    found = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {tuple(row[n] for n in names): row["n"] for row in found}
    voters = estimate(patterns)
    logit = F.lit(math.log(voters.prior) - math.log(1 - voters.prior))
    for r, name in enumerate(names if patterns else []):
        weights = [F.lit(voters.weight(r, vote)) for vote in SAYS]
        logit = logit + F.when(F.col(name) < 0, weights[0]).when(F.col(name) > 0, weights[2]).otherwise(weights[1])
    voted = voted.withColumn("posterior", 1 / (1 + F.exp(-logit)))
    return voted.withColumn("good", F.col("posterior") >= threshold)
