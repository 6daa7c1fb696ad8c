"""Quality of documents by hierarchical empirical Bayes, in DataFrame operations.

Three levels give a prior: the share of good documents among all labelled ones; that of a host, shrunk towards it; that
of a path on the host, shrunk towards the host's. How much is shrunk follows from the data: the spread of the groups'
shares beyond chance gives the number of pseudo-labels that the level above is worth (method of moments), so that sparse
groups stay near their parent and large ones speak for themselves. The document's own evidence is a classifier's: the
log-likelihood ratios of its binned features among labelled good and bad documents, summed. Prior odds times evidence is
the posterior.

A document without text has no features' evidence beyond that of the empty bins. Null hosts and paths are groups of
their own. A document labelled more than once counts as good if half of its labels or more are; null labels do not
count. Without labels every posterior is one half. Repeated rows are judged alike.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import join_facts, saved
from tickframe.llm.rules import rule_features

#: Feature, numerator, denominator and ascending bounds: the bin is the number of bounds that the ratio exceeds.
#: A denominator of 0 gives bin -1.
FEATURES = [
    ("words", "n_words", "1", (4, 9, 29, 99, 999)),
    ("symbols", "n_symbols", "n_words", (0.01, 0.05, 0.2, 0.6)),
    ("repeats", "n_repeat_words", "n_words", (0.01, 0.05, 0.2, 0.5, 0.8)),
    ("lines", "n_dup_lines", "n_lines", (0.01, 0.1, 0.3, 0.6)),
    ("length", "word_chars", "n_words", (2.5, 4.0, 6.0, 9.0)),
    ("marks", "word_chars - n_letters", "word_chars", (0.03, 0.06, 0.1, 0.2)),
    ("capitals", "n_capitals", "word_chars", (0.02, 0.05, 0.15, 0.5)),
    ("runs", "n_runs", "n_words", (0.01, 0.1, 0.3)),
    ("starts", "n_odd_starts", "n_words", (0.01, 0.05, 0.2)),
]
SMOOTH = 1.0
#: Pseudo-labels at least and at most that a parent is worth.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6


def bin_sql(over: str, under: str, bounds: tuple[float, ...]) -> str:
    """The bin as SQL that Spark and others read alike."""
    steps = " + ".join(f"CASE WHEN ({over}) > {b!r} * ({under}) THEN 1 ELSE 0 END" for b in bounds)
    return f"CASE WHEN ({under}) = 0 THEN -1 ELSE {steps} END"


def with_bins(features: DataFrame) -> DataFrame:
    return features.select("*", *[F.expr(bin_sql(over, under, bounds)).cast("int").alias(f"bin_{name}")
                                  for name, over, under, bounds in FEATURES])


def prior_weight(groups: DataFrame, good: str, n: str) -> float:
    """Pseudo-labels that the parent is worth, from the between-group variance of the shares of good documents. One
    row comes to the driver."""
    whole = groups.agg(F.sum(good).alias("k"), F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(n) * F.col(n)).alias("nn"),
                       F.sum(F.col(good) * F.col(good) / F.col(n)).alias("kk")).first()
    if not whole["n"] or whole["g"] < 2:
        return MOST_PRIOR
    p, total = whole["k"] / whole["n"], float(whole["n"])
    within = p * (1 - p)
    spread = whole["kk"] - total * p * p  # sum of n (share - p)^2
    room = total - float(whole["nn"]) / total - (whole["g"] - 1)
    if within <= 0 or room <= 0:
        return MOST_PRIOR
    rho = (spread / within - (whole["g"] - 1)) / room
    return MOST_PRIOR if rho <= 1 / (1 + MOST_PRIOR) else max(LEAST_PRIOR, (1 - rho) / rho)


def _key(*columns: Column) -> Column:
    """A text that is the same for equal columns only, nulls included."""
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns])


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
            path: str = "lang", label: str = "quality") -> DataFrame:
    """(id, host_rate, path_rate, evidence, p_quality, kept) of every document."""
    named = docs.select(F.col(doc_id).alias("id"), _key(F.col(host).cast("string")).alias("host"),
                        _key(F.col(host).cast("string"), F.col(path).cast("string")).alias("path"), F.col(text).alias("_llm_body"))
    rows = saved(with_bins(rule_features(named, ["id", "host", "path"], "_llm_body")), "features")
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        (F.avg(label) >= 0.5).cast("long").alias("good"))
    bins = [f"bin_{name}" for name, *_ in FEATURES]
    learned = saved(rows.select("id", "host", "path", *bins).join(known, "id"), "learned")

    cells = learned.select("good", F.explode(F.array(*[
        F.struct(F.lit(b).alias("feature"), F.col(b).alias("bin")) for b in bins])).alias("cell")).groupBy(
        "cell.feature", "cell.bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()  # features x bins
    n = sum(r["n"] for r in cells if r["feature"] == bins[0])
    k = sum(r["good"] for r in cells if r["feature"] == bins[0])
    evidence = F.lit(0.0)
    for (name, _, _, bounds), column in zip(FEATURES, bins):
        size = len(bounds) + 2
        ratio = {r["bin"]: log((r["good"] + SMOOTH) / (k + SMOOTH * size)) - log(
            (r["n"] - r["good"] + SMOOTH) / (n - k + SMOOTH * size)) for r in cells if r["feature"] == column}
        unseen = log(1 / (k + SMOOTH * size)) - log(1 / (n - k + SMOOTH * size)) if n else 0.0
        part = F.lit(unseen)
        for value, odds in sorted(ratio.items()):
            part = F.when(F.col(column) == value, odds).otherwise(part)
        evidence = evidence + part

    every = (k + 1) / (n + 2)
    hosts = learned.groupBy("host").agg(F.sum("good").alias("k"), F.count("*").alias("n"))
    paths = learned.groupBy("host", "path").agg(F.sum("good").alias("pk"), F.count("*").alias("pn"))
    host_worth = prior_weight(hosts, "k", "n")
    path_worth = prior_weight(paths, "pk", "pn")
    host_rates = hosts.withColumn("host_rate", (F.col("k") + host_worth * every) / (F.col("n") + host_worth))
    # every host and path of the documents has a rate, labelled or not
    sizes = rows.groupBy("host", "path").agg(F.count("*").alias("docs"))
    rates = sizes.join(host_rates.select("host", "host_rate"), "host", "left").join(paths, ["host", "path"], "left").select(
        "path", "docs", F.coalesce("host_rate", F.lit(every)).alias("host_rate"), F.coalesce("pk", F.lit(0)).alias("pk"),
        F.coalesce("pn", F.lit(0)).alias("pn"))
    rates = saved(rates.select("path", "docs", "host_rate", (
        (F.col("pk") + path_worth * F.col("host_rate")) / (F.col("pn") + path_worth)).alias("path_rate")), "rates")
    total = rates.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    judged = join_facts(rows.select("id", "path", evidence.alias("evidence")), rates, "path", "docs", total)
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence")
    return judged.select("id", "host_rate", "path_rate", "evidence", (1 / (1 + F.exp(-odds))).alias("p_quality")).withColumn(
        "kept", F.col("p_quality") >= 0.5)
