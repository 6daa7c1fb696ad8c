"""Language-model scores of whole texts: causal self-attention over subword ids, mixed with the corpus's word shares.

Tokens are words and one end a text. Words are counted over every training document. A word's probability is

    share * c / N + (1 - share) * product of its subwords' probabilities under the attention model

Both parts are distributions, so the mixture is one (of the texts' canonical spellings). The attention model learns from every
training document, at least once, by learners that train side by side and average their weights; only one document in ASIDE is
its validation part, on which the mixing share is fitted, each word's count less its own occurrence.

The count of every word of every text is needed. Frequent words, with more than FREQUENT of all tokens and so fewer than
1/FREQUENT of them, are broadcast and looked up; every occurrence of another word is joined with the table of counts, where
no word is frequent enough to make a hot key.

Null text is the empty text: its one token is the end. Repeated rows are scored alike. With no training document the
counts are zero and the attention model is untrained.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.attention import IDS, Model, Subwords, learned_vocabulary, vocabulary_path
from tickframe.llm.common import batches, join_facts, saved

FREQUENT = 1e-6
#: Up to so many training words, LEARN_EPOCHS passes are made over all texts in each of ROUNDS rounds. Of more words fewer passes are
#: made, but one over every text at least.
SAMPLE_WORDS, ROUNDS, LEARN_EPOCHS = 300_000, 3, 4
#: Words that a learner holds at once; their number over it is the square of the number of learners. Weights averaged at a time.
LEARNER_WORDS, FAN_IN = 300_000, 16
BINS = 20  # bins of the logarithm of a ratio, in a unit
ASIDE = 50  # one in so many training documents is kept for the mixing share
END_WORD = b"\n"  # no word holds white space
_HELD_WORDS = 300_000


@lru_cache(maxsize=1)
def subwords_of(vocabulary: str | bytes) -> Subwords:
    """The last one for each worker process, so that tasks share the words it has spelled."""
    return Subwords(vocabulary)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they came; given out whenever many are held."""
    held: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, times = list(held), list(held.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at:at + 50_000], pa.binary()), pa.array(times[at:at + 50_000], pa.int64())],
                                             names=["word", "c"])
        held.clear()

    for batch in batches(source):
        for text in batch.column(0).to_pylist():
            held.update(words_of(text))
            held[END_WORD] += 1
        if len(held) > _HELD_WORDS:
            yield from out()
    yield from out()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all documents, saved; the end is END_WORD."""
    body = docs.select(F.col(text).cast("binary").alias("t"))
    return saved(body.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def _spell(path: str | bytes):
    """How often each id is used in spelling counted words."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, total = subwords_of(path), np.zeros(IDS)
        for batch in source:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            end = np.array([w == END_WORD for w in words], bool)
            total[Subwords.END] += c[end].sum()
            ids = subwords.ids([[w for w in words if w != END_WORD]])[0][:-1]
            if len(ids):
                total += np.bincount(ids, c[~end][np.cumsum(subwords.begins[ids]) - 1], IDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def subword_counts(counts: DataFrame, path: str | bytes) -> np.ndarray:
    """How often every id is used in the corpus; IDS rows at most come to the driver."""
    rows = counts.mapInArrow(_spell(path), "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(IDS)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def word_logs(model: Model, subwords: Subwords, texts: list[list[bytes]]) -> np.ndarray:
    """The attention model's natural log-probability of every token, text after text, the end after each."""
    ids, sizes = subwords.ids(texts)
    return np.add.reduceat(model.log_probabilities(ids, sizes), np.flatnonzero(subwords.begins[ids]))


def mixing_share(logs: np.ndarray, shares: np.ndarray, times: np.ndarray | None = None, rounds: int = 30) -> float:
    """The mixing share of highest likelihood, by expectation-maximisation, inside [0.001, 0.999]. Token i came ``times[i]`` times."""
    if not len(logs) or not shares.any():
        return 0.0
    p, share = np.exp(logs), 0.5
    for _ in range(rounds):
        one = share * shares
        share = min(0.999, max(0.001, float(np.average(one / (one + (1 - share) * p + 1e-300), weights=times))))
    return share


def _learn(model, path: str | bytes, epochs: int, span: tuple[float, float], expected: float):
    """Weights of every learner in the task, each from the shared ones; a learner's texts, about ``expected`` words, pass in parts
    of LEARNER_WORDS, and the rate falls along ``span`` from part to part."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(path)
        net, now, seen, held, words, passed = None, None, 0, [], 0, 0

        def part() -> int:
            ids = subwords.ids(held)[0]
            low, high = (span[0] + (span[1] - span[0]) * min(1.0, w / expected) for w in (passed, passed + words))
            net.fit(ids, epochs, span=(low, high))
            held.clear()
            return len(ids)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([float(seen)]), pa.array([net.packed()], pa.binary())], names=["learner", "n", "weights"])

        for batch in batches(source):
            for learner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if learner != now or words >= LEARNER_WORDS:
                    if held:
                        seen, passed, words = seen + part(), passed + words, 0
                    if learner != now:
                        if net is not None:
                            yield row()
                        net, now, seen, passed = model.value.copy(), learner, 0, 0
                held.append(words_of(text))
                words += len(held[-1]) + 1
        if net is not None:
            seen += part()
            yield row()

    return run


def averaged(parts: pa.Table) -> tuple[float, bytes]:
    """The mean of learners' weights, each by the ids it has seen, in the order of the learners."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["learner"])
    total = sum(r["n"] for r in rows) or 1.0
    mean = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["n"] / total) for r in rows)
    return total, mean.astype(np.float32).tobytes()


def _average(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    total, weights = averaged(parts)
    return pa.table({"learner": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([total]), "weights": pa.array([weights], pa.binary())})


def _tokens(model, path: str | bytes):
    """Every token and its log-probability under the attention model."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(path)
        for batch in batches(source, 1 << 20):
            texts = [words_of(t) for t in batch.column(0).to_pylist()]
            if texts:
                logs = word_logs(model.value, subwords, texts)
                yield pa.RecordBatch.from_arrays([pa.array([w for t in texts for w in (*t, END_WORD)], pa.binary()), pa.array(logs)], names=["word", "log"])

    return run


def train(docs: DataFrame, counts: DataFrame, n_tokens: int, path: str | bytes, doc_id: str, text: str) -> tuple[Model, float]:
    """The attention model and the mixing share, from all training documents, in an order set by the hash of id and text.

    Documents are dealt to learners, whose number grows with the square root of the input, as what each of them reads does. In each
    of ROUNDS rounds every learner trains the shared weights on its own texts, and the mean of theirs is shared next; means are
    taken FAN_IN at a time. Where fewer passes than rounds are made, each round takes its own part of the documents. The mixing
    share is fitted on the documents set aside, by the ratio of both parts in bins."""
    send = docs.sparkSession.sparkContext.broadcast
    model = Model(subword_counts(counts, path))
    passes = min(ROUNDS * LEARN_EPOCHS, max(1, round(ROUNDS * LEARN_EPOCHS * SAMPLE_WORDS / max(1, n_tokens))))
    parted = passes < ROUNDS
    epochs = passes if parted else round(passes / ROUNDS)
    learners = max(1, round(math.sqrt(n_tokens / LEARNER_WORDS)))
    expected = max(1, n_tokens) / learners / (ROUNDS if parted else 1)
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(29)), F.lit(1 << 40))
    drawn = docs.filter(F.col(text).isNotNull()).select(draw.alias("d"), F.col(text).cast("binary").alias("t"))
    turned = F.floor(F.col("d") / ASIDE)
    dealt = drawn.filter(F.col("d") % ASIDE != 0).withColumn("learner", F.floor(turned / ROUNDS) % learners)
    for turn in range(ROUNDS):
        mine = dealt.filter(turned % ROUNDS == turn) if parted else dealt
        parts = mine.repartitionById(learners, F.col("learner").cast("int")).sortWithinPartitions("learner", "d", "t").select("learner", "t").mapInArrow(
            _learn(send(model), path, epochs, (turn / ROUNDS, (turn + 1) / ROUNDS), expected), "learner long, n double, weights binary")
        left = learners
        while left > FAN_IN:
            parts = parts.groupBy(F.floor(F.col("learner") / FAN_IN).alias("head")).applyInArrow(_average, "learner long, n double, weights binary")
            left = -(-left // FAN_IN)
        rows = parts.toArrow()
        if rows.num_rows:
            model = model.copy()
            model.unpack(averaged(rows)[1])
    model.ready()
    aside = drawn.filter(F.col("d") % ASIDE == 0).select("t").mapInArrow(_tokens(send(model), path), "word binary, log double")
    known = join_facts(aside, counts.withColumn("times", F.col("c")), "word", "c", n_tokens)
    ratio = F.ln((F.col("times") - 1) / F.lit(max(1, n_tokens))) - F.col("log")  # null for a word of its own text alone
    bins = known.groupBy(F.round(F.least(F.greatest(ratio, F.lit(-50)), F.lit(50)) * BINS).alias("bin")).count().toArrow()
    at = np.array([np.nan if b is None else b for b in bins["bin"].to_pylist()], np.float64)
    times = bins["count"].to_numpy()
    return model, mixing_share(-np.nan_to_num(at) / BINS, (~np.isnan(at)).astype(np.float64), times)


def _score(model, frequent, share: float, total: int, path: str | bytes, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, known, net = subwords_of(path), frequent.value, model.value
        row = TaskContext.get().partitionId() << 36
        get = known.get
        for batch in batches(source, 1 << 20):
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            logs = word_logs(net, subwords, texts)
            flat = [w for t in texts for w in (*t, END_WORD)]
            c = np.fromiter(map(get, flat, repeat(0)), np.float64, len(flat))
            tokens = np.array([len(t) + 1 for t in texts])
            starts = np.cumsum(tokens) - tokens
            seen = c > 0
            logs += math.log(1 - share)
            mixed = np.where(seen, np.logaddexp(logs, np.log(np.maximum(share * c / total, 1e-300))), 0.0)
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), batch.column(0), batch.column(1), pa.array(tokens), pa.array(np.add.reduceat(seen.astype(np.int64), starts)),
                pa.array(np.add.reduceat(np.where(seen, np.log10(c + 0.1), 0.0), starts)), pa.array(np.add.reduceat(mixed, starts) / math.log(10)),
                pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.float64())], schema=schema)
            at = np.flatnonzero(~seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rows, tokens)[at]), *[pa.nulls(len(at), schema.field(i).type) for i in range(1, 7)],
                 pa.array([flat[i] for i in at.tolist()], pa.binary()), pa.array(logs[at])], schema=schema)

    return run


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           own_vocabulary: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document. Words are spelled with the first merges
    of ``vocabulary``, a file's path, or with merges learned from the training documents' frequent words."""
    spark = docs.sparkSession
    training = docs.filter(~held_out)
    counts = word_counts(training, text)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # fewer than 1/FREQUENT rows by definition
    frequent = {bytes(r["word"]): r["c"] for r in counts.filter(F.col("c") > FREQUENT * n).collect()}
    path = learned_vocabulary({w: c for w, c in frequent.items() if w != END_WORD}) if own_vocabulary else vocabulary or vocabulary_path()
    model, share = train(training, counts, n, path, doc_id, text)
    narrow = docs.select(F.col(doc_id).alias("id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("_llm_text"))
    kind = narrow.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("row", pa.int64()), ("id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("log", pa.float64())])
    send = spark.sparkContext.broadcast
    out = saved(narrow.mapInArrow(
        _score(send(model), send(frequent), share, max(1, n), path, schema),
        f"row long, id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, log double"),
        "scored")
    rare = out.filter("word is not null").select("row", "word", "log").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    both = F.log10(share * F.col("c") / max(1, n) + F.exp("log"))
    # a word so long that its probability is no double, not seen in training
    mixed = F.when((F.col("c") == 0) | (share == 0.0), F.col("log") / math.log(10)).otherwise(both)
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("known"),
                                   F.sum(mixed).alias("mixed"))
    level = math.log10(n + 0.1 * (v + 1))
    return out.filter("word is null").join(rare, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * level).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"))
