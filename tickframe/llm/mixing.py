"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a share of the mix in words. Shares go by weight and stop at a number of epochs of the source; the
excess goes to the others by weight until none is above. A source first gives its whole epochs, then a fraction: every
document draws the exponential key -ln(u) / quality, u from a hash of its id, and those with the smallest keys are
taken until the words left are reached. The document across that line is taken if that comes nearer.

A hot source is never sorted whole: keys fall into BINS ordered bins, whose words are summed by (source, bin) and
prefix-summed over at most BINS rows a source; only the bin with the line in it is sorted, about 1/BINS of the source.
The result is a threshold per source, so a document's decision needs no shuffle of its text.

Null text has no words. Ties in the key go by id, then by the text's hash; rows equal in both are taken together.
Null sources are one source, the last. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickframe.llm.common import SPACE, HOT_SHARE, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BINS = 1 << 12
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The share of letters among the characters that are not white space, 0.05 at least."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(F.length(F.regexp_replace(text, SPACE, "")), F.lit(0)), F.lit(0.0)))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return -F.log((drawn.cast("double") + 0.5) / float(1 << 48)) / weight


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, size, n; one row each) with its target. Weights go round by code point, null last.

    One row a source is ranked and levelled here, never rows of documents. A source is full if its ceiling divided by
    its weight is at most the level; ordering by that ratio finds the level by prefix sums.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")))
    ratio = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").isNull(), "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = weighed.select(
        "*", (F.lit(SHARE) * F.sum("size").over(everything)).alias("budget"),
        F.coalesce(F.sum(MOST_EPOCHS * F.col("size")).over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(after).alias("open_weight"))
    level = (F.col("budget") - F.col("full")) / F.col("open_weight")
    # the first source, in this order, that its share does not fill sets the level of all after it
    stops = filled.withColumn("stop", F.when(level * F.col("weight") < MOST_EPOCHS * F.col("size"), level))
    final = stops.withColumn("level", F.first("stop", ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, 0)))
    return final.select("source", "size", "n", F.coalesce(
        F.col("level") * F.col("weight"), (MOST_EPOCHS * F.col("size")).cast("double")).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """``rows`` (saved: id, source, size, key, tie) with source_size, target and copies."""
    total, longest = rows.agg(F.count("*"), F.avg("key")).first()
    scale = 1.0 / longest if longest else 1.0
    rows = rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-F.col("key") * scale)))).cast("int"))
    binned = saved(rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "bins")
    facts = targets(binned.groupBy("source").agg(F.sum("words").alias("size"), F.sum("n").alias("n")))
    facts = saved(facts.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
                  .withColumn("rest", F.col("target") - F.col("epochs") * F.col("size")), "facts")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    summed = binned.withColumn("before", F.coalesce(F.sum("words").over(by_bin), F.lit(0)))
    line = summed.join(facts, same(summed, facts)).filter("before < rest and before + words >= rest").select(
        summed["source"].alias("source"), "bin", "before", "rest")
    inside = rows.join(line, same(rows, line) & (rows["bin"] == line["bin"])).select(
        rows["source"], "key", rows["id"], "tie", "size", "before", "rest")
    in_bin = Window.partitionBy("source").orderBy("key", F.col("id").isNull(), "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(in_bin), F.lit(0))).filter(
        2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest"))
    mark = F.struct("key", F.col("id").isNull().alias("none"), "id", "tie")
    last = taken.groupBy("source").agg(F.max(mark).alias("last"))
    lines = line.join(last, same(line, last), "left").select(line["source"], F.col("bin").alias("line_bin"), "last")
    known = saved(facts.join(lines, same(facts, lines), "left").select(
        facts["source"], "size", "n", "target", "epochs", "rest", "line_bin", "last"), "mixed")
    known = known.withColumnsRenamed({"source": "_llm_source", "size": "source_size"})
    hot = known.filter(F.col("n") > HOT_SHARE * total)  # fewer than 1/HOT_SHARE by definition
    cold = known.filter(F.col("n") <= HOT_SHARE * total)
    on = F.col("source").eqNullSafe(F.col("_llm_source"))
    rest = rows.join(F.broadcast(hot.select("_llm_source")), on, "left_anti")
    met = rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))
    extra = F.when(F.col("rest") <= 0, 0).when(F.col("line_bin").isNull(), 1).when(F.col("bin") < F.col("line_bin"), 1).when(
        F.col("bin") > F.col("line_bin"), 0).when(mark <= F.col("last"), 1).otherwise(0)
    return met.select("id", "source", "tie", "size", "source_size", "target", (F.col("epochs") + extra).alias("copies"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, tie, size, source_size, target, copies) of every document; tie is the text's hash."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                       sampling_key(F.col(doc_id), quality(F.col(text))).alias("key"), F.xxhash64(text).alias("tie"))
    return plan(saved(rows, "sizes"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs``, each as often as the mix takes it."""
    often = mixture(docs, doc_id, text, source).filter("copies > 0").groupBy("id", "tie").agg(F.max("copies").alias("_llm_copies"))
    often = often.withColumnsRenamed({"id": "_llm_id", "tie": "_llm_tie"})
    keyed = docs.withColumn("_llm_t", F.xxhash64(text))
    met = keyed.join(often, keyed[doc_id].eqNullSafe(F.col("_llm_id")) & (F.col("_llm_t") == F.col("_llm_tie")))
    return met.select(*[met[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_llm_copies").cast("int")))
                      .alias("_llm_turn")).drop("_llm_turn")
