"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0). Documents with equal votes count as one vote pattern, so that
expectation-maximisation works on at most 3^rules counted patterns, whatever the number of documents; it estimates
how often each rule is right about good and about bad documents and the share of good ones. A document's posterior
probability of being good follows from its votes and those estimates.

Null or empty text: no words, every rule abstains, the posterior is the share of good documents; the base test fails
it. Repeated rows are judged alike. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import saved, words_of

WINDOW = 5
ROUNDS = 30
#: Where the estimates start: a rule seldom turns on a good document, and finds only its own kind of bad one.
START_RIGHT = (0.99, 0.4)
START_GOOD = 0.7

#: name, bad when, good when (else the rule abstains). Only sums and products of whole numbers, so that every engine
#: decides alike.
RULES = [
    ("symbols", "n_words >= 10 AND 10 * n_symbols > n_words", "n_words >= 10 AND 50 * n_symbols <= n_words"),
    ("repeats", "n_words >= 10 AND 10 * n_repeat_words > n_words", "n_words >= 10 AND 50 * n_repeat_words <= n_words"),
    ("lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_lines >= 4 AND 20 * n_dup_lines <= n_lines"),
    ("marks", "word_chars >= 40 AND 100 * (word_chars - n_letters) > 11 * word_chars",
     "word_chars >= 40 AND 100 * (word_chars - n_letters) <= 8 * word_chars"),
    ("starts", "n_words >= 10 AND 10 * n_odd_starts > n_words", "n_words >= 10 AND 50 * n_odd_starts <= n_words"),
    ("runs", "n_words >= 10 AND 10 * n_runs > n_words", "n_words >= 10 AND 50 * n_runs <= n_words"),
    ("capitals", "word_chars >= 40 AND 10 * n_capitals > 4 * word_chars",
     "word_chars >= 40 AND 10 * n_capitals <= word_chars"),
    ("shouts", "n_words >= 10 AND 10 * n_shouts > n_words", "n_words >= 10 AND 50 * n_shouts <= n_words"),
]


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more; ``hashes`` are in order of position."""
    def covered(ranked: Column) -> Column:
        def twice(j: Column) -> Column:
            here = F.get(ranked, j)["h"]
            return F.coalesce(here == F.get(ranked, j - 1)["h"], F.lit(False)) | F.coalesce(
                here == F.get(ranked, j + 1)["h"], F.lit(False))

        places = F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), twice), lambda j: F.get(ranked, j)["at"]))
        return F.aggregate(
            places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
            lambda a, at: F.struct(at.alias("last"), (a["total"] + F.least(F.lit(WINDOW), at - a["last"])).alias("total")),
            lambda a: a["total"])

    ranked = F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bound(ranked, covered))


def rule_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts that the rules read."""
    kept = [F.col(c) for c in keep]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*kept, body.alias("_llm_text"), words_of(F.col(text)).alias("_llm_words"))
    words, raw = F.col("_llm_words"), F.col("_llm_text")
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))))
    hashed = split.select(
        *kept, "_llm_text", "_llm_words",
        F.coalesce(hashes, F.array().cast("array<bigint>")).alias("_llm_hashes"),
        F.filter(F.split(raw, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0).alias("_llm_lines"))
    left = lambda pattern: F.length(F.regexp_replace(raw, pattern, "")).cast("long")
    return hashed.select(
        *kept, F.size("_llm_words").cast("long").alias("n_words"),
        F.length(F.array_join("_llm_words", "")).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_llm_lines") - F.size(F.array_distinct("_llm_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_llm_hashes")).cast("long").alias("n_repeat_words"),
        F.size("_llm_lines").cast("long").alias("n_lines"),
        left(r"[^A-Z]+").alias("n_capitals"),
        left(r"[^!]+").alias("n_shouts"),
        left(r"[^\p{L}]+").alias("n_letters"),
        F.regexp_count(raw, F.lit(r"(^|[\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long").alias("n_odd_starts"),
        F.regexp_count(raw, F.lit(r"[!#$%&*]{2,}")).cast("long").alias("n_runs"))


def with_votes(features: DataFrame) -> DataFrame:
    return features.withColumns({
        f"vote_{name}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for name, bad, good in RULES})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents and, for each rule, how often its vote is right on good and on bad ones. One
    vote each way is added to every count, so no estimate reaches 0 or 1."""
    n = len(RULES)
    good, right = START_GOOD, [START_RIGHT] * n
    for _ in range(rounds):
        weight = [[1.0, 1.0] for _ in range(n)]
        hit = [list(START_RIGHT) for _ in range(n)]
        total = [0.0, 0.0]
        for votes, count in patterns:
            p = posterior(votes, good, right)
            for side, share in enumerate((p * count, (1 - p) * count)):
                total[side] += share
                for j, vote in enumerate(votes):
                    if vote:
                        weight[j][side] += share
                        hit[j][side] += share if (vote > 0) == (side == 0) else 0.0
        good = (total[0] + 1) / (total[0] + total[1] + 2)
        right = [tuple(h / w for h, w in zip(hit[j], weight[j])) for j in range(n)]
    return good, right


def posterior(votes: tuple[int, ...], good: float, right: list[tuple[float, float]]) -> float:
    odds = log(good / (1 - good)) + sum(vote_odds(v, *r) for v, r in zip(votes, right))
    return 1 / (1 + exp(-max(-700.0, min(700.0, odds))))


def vote_odds(vote: int, on_good: float, on_bad: float) -> float:
    if vote == 0:
        return 0.0
    return log(on_good / (1 - on_bad)) if vote > 0 else log((1 - on_good) / on_bad)


def judged(features: DataFrame) -> DataFrame:
    """``features`` with the votes, base_failed, p_good and kept. ``features`` is read twice: save it first."""
    voted = with_votes(features)
    names = [f"vote_{name}" for name, _, _ in RULES]
    # at most 3^len(RULES) rows, whatever the input
    counted = voted.filter("n_words > 0").groupBy(*names).count().collect()
    patterns = sorted((tuple(r[c] for c in names), r["count"]) for r in counted)
    good, right = estimate(patterns)
    odds = F.lit(log(good / (1 - good)))
    for name, rates in zip(names, right):
        odds = odds + F.when(F.col(name) > 0, vote_odds(1, *rates)).when(
            F.col(name) < 0, vote_odds(-1, *rates)).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality_verdicts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with the counts, votes, p_good, base_failed and kept."""
    return judged(saved(rule_features(docs, keep, text), "rules"))


def good_only(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that the base test or the rules reject."""
    rows = docs.select(F.struct(*docs.columns).alias("_llm_row"), F.col(text).alias("_llm_body"))
    return quality_verdicts(rows, ["_llm_row"], "_llm_body").filter("kept").select("_llm_row.*")
