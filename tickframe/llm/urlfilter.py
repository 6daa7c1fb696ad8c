"""URL filter: rules by host and path, and gradient-boosted trees for the rest; DataFrame operations only.

The URLs that a rule decides are the labelled ones. Trees are boosted on lexical features (length, depth, digit share,
entropy, parameters, labels, hyphens) and on the share of blocked URLs among the labelled ones of the same last host label, the
same last two labels and the same host. Those shares count every labelled URL; a labelled URL sees those of the other folds
only, equal URLs being of one fold. Facts of a host are joined with the hot ones broadcast, so a host may hold most rows.

A tree asks the same question of all its nodes on a level, so a level is one aggregation of gradients over (node, feature,
bin), a few thousand sums at most, from which the driver takes the split with the largest gain. Trees are fitted on at most
``SAMPLE`` labelled URLs, those of the least digest; the statistics and the verdicts cover all. Scoring is a column expression.

Results: a null URL or one without ``://`` has empty host and path, fits no rule and is judged by the trees; repeated rows are
judged alike; without any labelled URL all others are allowed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import join_facts, saved


class Rule(NamedTuple):
    """Fits its host and all hosts below it, if the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, RIDGE = 8, 3, 0.4, 1.0
#: Folds of the shares, and the labelled URLs that the overall share counts as in each.
FOLDS, PRIOR = 4, 5.0
_SHARES = tuple(round(0.05 + 0.1 * i, 2) for i in range(10))
#: Feature and the bounds of its bins; a bin is how many bounds the value reaches.
FEATURES: tuple[tuple[str, tuple[float, ...]], ...] = (
    ("url_length", (20, 25, 30, 35, 40, 45, 50, 60, 80, 120)),
    ("host_length", (8, 12, 16, 20, 24, 28, 32, 40)),
    ("depth", (1, 2, 3, 4, 6, 8)),
    ("digit_share", (0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.3)),
    ("entropy", (3.0, 3.25, 3.5, 3.75, 4.0, 4.25, 4.5, 5.0)),
    ("n_params", (1, 2, 3, 5)),
    ("n_labels", (2, 3, 4, 5)),
    ("n_hyphens", (1, 2, 3)),
    ("last_share", _SHARES),
    ("site_share", _SHARES),
    ("host_share", _SHARES),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- parts and rules -----------------------------------------------------------------------------

def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host in lower case, path, query) of a URL; empty where there is no ``://``."""
    colon = F.instr(url, "://")
    rest = F.when(colon > 0, F.substr(url, colon + F.lit(3))).otherwise("")
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)(?:\?([^#]*))?", group), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2), part(3)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, action) of the longest rule that fits, null if none does. Of equally long ones block goes first,
    then code points decide."""
    chosen, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last rule wins: the longest, among equally long ones a blocking one, then the first by code points.
    for rule in sorted(sorted(rules, key=lambda r: r.text, reverse=True), key=lambda r: (len(r.text), r.action == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, rule.text).otherwise(chosen)
        action = F.when(fits, rule.action).otherwise(action)
    return chosen, action


# --- features ------------------------------------------------------------------------------------

def _lexical(url: Column, host: Column, path: Column, query: Column) -> dict[str, Column]:
    size = F.char_length(url)
    characters = F.array_distinct(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)))
    counts = F.transform(characters, lambda c: (size - F.char_length(F.replace(url, c, F.lit("")))).cast("double"))
    filled = lambda text, mark: F.size(F.filter(F.split(text, mark), lambda x: x != "")).cast("double")
    entropy = F.log2(size) - F.aggregate(counts, F.lit(0.0), lambda a, n: a + n * F.log2(n)) / size
    return {
        "url_length": size.cast("double"), "host_length": F.char_length(host).cast("double"), "depth": filled(path, "/"),
        "digit_share": F.when(size > 0, F.round(F.char_length(F.regexp_replace(url, "[^0-9]+", "")) / size, 6)).otherwise(0.0),
        "entropy": F.when(size > 0, F.round(entropy, 6)).otherwise(0.0), "n_params": filled(query, "&"),
        "n_labels": filled(host, r"\."), "n_hyphens": (F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
    }


def _host_shares(rows: DataFrame) -> tuple[DataFrame, float]:
    """Per host its rows and, for each fold and for all, the blocked share of its last label, its site and itself."""
    counts = [F.count("*").alias("rows")]
    for fold in range(FOLDS + 1):  # the last stands for all
        seen = F.col("label").isNotNull() & (F.col("fold") != fold)
        counts += [F.count(F.when(seen, 1)).alias(f"n{fold}"), F.coalesce(F.sum(F.when(seen, F.col("label"))), F.lit(0)).alias(f"k{fold}")]
    names = [f"{x}{fold}" for fold in range(FOLDS + 1) for x in "nk"]
    labels = F.split("host", r"\.")
    hosts = saved(rows.groupBy("host").agg(*counts).withColumns({
        "last": F.element_at(labels, -1), "site": F.array_join(F.slice(F.reverse(labels), 1, 2), ".")}), "hosts")
    n, k, n_hosts = (v or 0 for v in hosts.agg(F.sum(f"n{FOLDS}"), F.sum(f"k{FOLDS}"), F.count("*")).first())
    overall = (k + 1) / (n + 2)
    share = lambda level: F.array(*[
        F.round((F.col(f"k{fold}") + PRIOR * overall) / (F.col(f"n{fold}") + PRIOR), 6) for fold in range(FOLDS + 1)]).alias(level)
    judged = hosts.select("host", "rows", "last", "site", share("host_share"))
    for key in ("last", "site"):
        facts = hosts.groupBy(key).agg(F.count("*").alias("hosts"), *[F.sum(c).alias(c) for c in names])
        judged = join_facts(judged, facts.select(key, "hosts", share(f"{key}_share")), key, "hosts", n_hosts)
    return saved(judged.select("host", "rows", *[f"{level}_share" for level in ("last", "site", "host")]), "host-shares"), overall


def features(urls: DataFrame, url_col: str, rules=RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, host, path, rule, action, label (1 block, 0 allow, null where no rule fits), fold and the features
    of every row, written to the shared folder."""
    kept = [F.col(c) for c in keep]
    base = urls.select(*kept, F.col(url_col).cast("string").alias("_url"))
    text = F.coalesce("_url", F.lit(""))
    host, path, query = url_parts(text)
    split = base.select(*keep, text.alias("_url"), host.alias("host"), path.alias("path"), query.alias("_query"))
    chosen, action = rule_of(F.col("host"), F.col("path"), rules)
    digest = F.conv(F.substring(F.md5(F.col("_url").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = saved(split.select(
        *keep, "host", "path", chosen.alias("rule"), action.alias("action"), F.when(action.isNotNull(), (action == "block").cast("int")).alias("label"),
        digest.alias("digest"), F.pmod(digest, F.lit(FOLDS)).cast("int").alias("fold"),
        *[c.alias(n) for n, c in _lexical(F.col("_url"), F.col("host"), F.col("path"), F.col("_query")).items()]), "urls")
    shares, _ = _host_shares(rows)
    joined = join_facts(rows, shares, "host", "rows", rows.count())
    fold = F.when(F.col("label").isNotNull(), F.col("fold")).otherwise(FOLDS) + 1
    return saved(joined.withColumns({f"{level}_share": F.element_at(F.col(f"{level}_share"), fold) for level in ("last", "site", "host")}),
                 "url-features")


# --- trees ---------------------------------------------------------------------------------------

class Tree(NamedTuple):
    splits: list[tuple[int, int]]  # (feature, bin): a one in the node number where the bin is reached
    values: list[float]


class Model(NamedTuple):
    start: float
    trees: list[Tree]


def _bins() -> list[Column]:
    return [sum(((F.col(name) >= float(b)).cast("int") for b in bounds[1:]), (F.col(name) >= float(bounds[0])).cast("int")) for name, bounds in FEATURES]


def _node(splits: list[tuple[int, int]]) -> Column:
    """Number of the node a row of ``bins`` is in."""
    return sum(((F.get("bins", F.lit(f)) >= b).cast("int") * (1 << level) for level, (f, b) in enumerate(splits)), F.lit(0))


def margin(model: Model) -> Column:
    """Log odds of block, from the column ``bins``."""
    total = F.lit(model.start)
    for tree in model.trees:
        total = total + F.get(F.array(*map(F.lit, tree.values)), _node(tree.splits))
    return total


def _best_split(sums: dict[tuple[int, int, int], tuple[float, float]], nodes: int) -> tuple[int, int, list[tuple[float, float]]]:
    """(feature, bin, gradient and curvature of the nodes it makes) of the largest gain, the first among equal ones."""
    best = None
    for f, (_, bounds) in enumerate(FEATURES):
        rows = [[sums.get((node, f, b), (0.0, 0.0)) for b in range(len(bounds) + 1)] for node in range(nodes)]
        for cut in range(1, len(bounds) + 1):
            sides = [tuple(map(sum, zip(*row[:cut]))) for row in rows] + [tuple(map(sum, zip(*row[cut:]))) for row in rows]
            gain = round(sum(g * g / (h + RIDGE) for g, h in sides), 9)
            if best is None or gain > best[0]:
                best = gain, f, cut, sides
    return best[1:]


def train(featured: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of the least digests, ``sample`` at most; equal rows count as one with their number."""
    drawn = featured.filter("label IS NOT NULL").orderBy("digest", "label", *[name for name, _ in FEATURES]).limit(sample)
    rows = saved(drawn.select(F.array(*_bins()).alias("bins"), "label").groupBy("bins").agg(
        F.sum("label").cast("double").alias("k"), F.count("*").cast("double").alias("n")), "url-sample")
    k, n = (v or 0.0 for v in rows.agg(F.sum("k"), F.sum("n")).first())
    model = Model(log((k + 1) / (n - k + 1)), [])
    for _ in range(TREES if n else 0):
        p = 1 / (1 + F.exp(-margin(model)))
        sloped = rows.select("bins", (F.col("k") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        splits, sides = [], []
        for level in range(DEPTH):
            # At most nodes x features x bins sums come to the driver.
            cells = sloped.select(_node(splits).alias("node"), "g", "h", F.posexplode("bins").alias("f", "b"))
            sums = {(r["node"], r["f"], r["b"]): (r["g"], r["h"]) for r in cells.groupBy("node", "f", "b").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
            f, cut, sides = _best_split(sums, 1 << level)
            splits.append((f, cut))
        model.trees.append(Tree(splits, [RATE * g / (h + RIDGE) for g, h in sides]))
    return model


def judge(urls: DataFrame, keep: tuple[str, ...], url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` with host, path, rule, verdict (block or allow) and p_block, the trees' probability."""
    featured = features(urls, url_col, rules, keep)
    model = train(featured, sample)
    scored = featured.withColumn("bins", F.array(*_bins())).withColumn("p_block", 1 / (1 + F.exp(-margin(model))))
    verdict = F.coalesce("action", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return scored.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "p_block")
