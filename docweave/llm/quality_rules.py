"""Quality rules combined by weak supervision.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the votes of all documents that pass the base rule estimates how often each rule casts each vote on good and on bad documents, and the posterior
probability of the label "good" replaces the usual demand that every rule pass. A rule that looks for one defect votes good
on most bad documents too; having an accuracy for each vote, the model takes its bad votes for strong evidence and its good
ones for weak.

Everything that touches documents is DataFrame functions. The model sees the corpus only as a histogram of vote patterns,
of 3 ** len(RULES) rows at most whatever the input, which is why it may be fitted on the driver.

Defined results: a null or empty text has no words and so fails the base rule; repeated rows are counted and returned as
often as they occur; columns besides `id_col` and `text_col` are not looked at, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BLANKS, UPPER, stored, words_of

SYMBOLS = "#*$%&|<>"
#: 31 bits for a window's place, the rest for a hash of its words.
PLACE_BITS = 31


@dataclass(frozen=True)
class Rule:
    """Votes good up to `good`, bad from `bad` on, and abstains between; measure is a quotient of two count columns."""

    name: str
    top: str
    bottom: str
    good: float
    bad: float


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.002, 0.02),
    Rule("symbol_words", "n_symbols", "n_words", 0.02, 0.1),
    Rule("repeats", "n_repeat_words", "n_words", 0.1, 0.3),
    Rule("capitals", "n_capitals", "word_chars", 0.1, 0.4),
    Rule("shouting", "n_marks", "n_words", 0.02, 0.15),
    Rule("line_copies", "n_dup_lines", "n_lines", 0.05, 0.3),
    Rule("no_sentences", "n_words", "n_stops", 60.0, 200.0),
)
EM_ROUNDS, PRIOR, SMOOTHING = 20, 0.6, 10.0
#: The shares of votes 1, 0 and -1 that estimation starts from, on good and on bad documents.
VOTES, START = (1, 0, -1), ((0.9, 0.08, 0.02), (0.7, 0.1, 0.2))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules look at, a row for each row of docs."""
    text, n = F.col("_text"), F.col("n_words")
    without = lambda s, chars: F.char_length(s) - F.char_length(F.translate(s, chars, ""))
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_words", words_of(text)).withColumn("n_words", F.size("_words").cast("long"))
    base = base.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    place = F.lit((1 << PLACE_BITS) - 1)
    window = lambda i: [F.get("_words", i + k) for k in range(3)]
    hashed = F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.shiftleft(F.xxhash64(*window(i)), PLACE_BITS).bitwiseOR(i.cast("long")))
    base = base.withColumn("_windows", F.sort_array(F.when(n >= 3, hashed).otherwise(F.array().cast("array<bigint>"))))
    key = lambda x: F.shiftright(x, PLACE_BITS)
    twin = lambda name, part: lambda x, i: (part(F.get(name, i - 1)) == part(x)) | (part(F.get(name, i + 1)) == part(x))
    # Windows whose hashes meet are compared word by word, so that the hash decides nothing.
    base = base.withColumn("_alike", F.filter("_windows", twin("_windows", key)))
    spelt = F.transform("_alike", lambda x: F.struct(F.concat_ws(" ", *window(x.bitwiseAND(place).cast("int"))).alias("w"), x.bitwiseAND(place).alias("p")))
    base = base.withColumn("_spelt", F.sort_array(spelt))
    same = F.filter("_spelt", twin("_spelt", lambda x: x["w"]))
    base = base.withColumn("_at", F.sort_array(F.transform(same, lambda x: x["p"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return base.select(
        id_col,
        "n_words",
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        without(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        without(text, UPPER).cast("long").alias("n_capitals"),
        without(text, "!").cast("long").alias("n_marks"),
        without(text, ".!?").cast("long").alias("n_stops"),
    )


def vote(rule: Rule) -> Column:
    top, bottom = F.col(rule.top).cast("double"), F.greatest(F.col(rule.bottom), F.lit(1)).cast("double")
    return F.when(top <= rule.good * bottom, 1).when(top >= rule.bad * bottom, -1).otherwise(0)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = EM_ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over a histogram of vote patterns: a bias and, for each rule and vote, what it adds to the log odds of "good".

    Smoothing keeps the estimates inside (0, 1) and at their starting values where nothing votes.
    """
    share, rates = PRIOR, [[dict(zip(VOTES, START[y], strict=True)) for _ in range(n_rules)] for y in (0, 1)]
    for _ in range(rounds):
        bias, own = log_odds(share, rates)
        total, found = [0.0, 0.0], [[dict.fromkeys(VOTES, 0.0) for _ in range(n_rules)] for _ in (0, 1)]
        for pattern, n in sorted(patterns):
            good = 1 / (1 + math.exp(-(bias + sum(w[v] for w, v in zip(own, pattern, strict=True)))))
            for y, p in enumerate((good, 1 - good)):
                total[y] += n * p
                for j, v in enumerate(pattern):
                    found[y][j][v] += n * p
        share = (total[0] + SMOOTHING * PRIOR) / (total[0] + total[1] + SMOOTHING)
        rates = [[{v: (found[y][j][v] + SMOOTHING * START[y][k]) / (total[y] + SMOOTHING) for k, v in enumerate(VOTES)} for j in range(n_rules)] for y in (0, 1)]
    return log_odds(share, rates)


def log_odds(share: float, rates: list[list[dict[int, float]]]) -> tuple[float, list[dict[int, float]]]:
    return math.log(share / (1 - share)), [{v: math.log(good[v] / bad[v]) for v in VOTES} for good, bad in zip(*rates, strict=True)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: its counts, base_failed, a vote_<rule> for each rule, posterior and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of them in repeated windows. Such documents are not kept
    whatever the posterior, and take no part in the estimation, which would otherwise find just them again.
    """
    counts = stored(measure(docs, id_col, text_col))
    n, names = F.col("n_words"), [f"vote_{r.name}" for r in rules]
    voted = counts.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)).withColumns(dict(zip(names, map(vote, rules), strict=True)))
    seen = [(tuple(r[k] for k in names), r["n"]) for r in voted.filter(~F.col("base_failed")).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    bias, own = fit(seen, len(rules))
    odds = F.lit(bias)
    for k, w in zip(names, own, strict=True):
        odds = odds + F.when(F.col(k) == 1, w[1]).when(F.col(k) == -1, w[-1]).otherwise(w[0])
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
