"""Language of whole texts by sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters, over lower-cased letters with one space for all else, are hashed to BUCKETS
features. Their document frequencies are counted over every training document. The weights are trained with
follow-the-regularised-leader (per-coordinate steps, elastic net: L1 leaves unused weights at zero, L2 shrinks the rest)
on a bounded sample of labelled documents, as many of each language as its share of SAMPLE allows; a part of the sample
is kept aside to fit the temperature by which scores are calibrated.

Null text, or text without a letter, is ``und`` with score 0; so is every text if there is nothing to learn from.
Documents without a language are not learned from. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import batches

BUCKETS = 1 << 16
SAMPLE = 6000
ASIDE = 4  # one in so many of the sample is for calibration
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
SCALE = 40.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x30000)] + [False], bool)


def buckets_of(text: str | None) -> np.ndarray:
    """The feature of every n-gram of the text; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(codes, 0x30000)]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 32)
    # one space for each run of anything else, none at the ends
    codes = codes[letter | np.concatenate(([False], letter[:-1]))]
    codes = np.concatenate(([32], codes[:-1] if codes[-1] == 32 else codes, [32])).astype(np.uint64)
    grams = [codes]
    for n in (2, 3):
        if len(codes) >= n:
            last = grams[-1]
            grams.append(last[:-1] * np.uint64(1_000_003) + codes[n - 1:])
    mixed = np.concatenate([g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i) for i, g in enumerate(grams)])
    return (mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def _frequencies(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents have each feature, and at -1 how many documents there are."""
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches(source):
        for text in batch.column(0).to_pylist():
            mark = np.zeros(BUCKETS, bool)
            mark[buckets_of(text)] = True
            seen += mark
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["bucket", "n"])


def _sparse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        found = [np.unique(buckets_of(t), return_counts=True) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0].astype("<u4").tobytes() for f in found], pa.binary()),
             pa.array([f[1].astype("<u4").tobytes() for f in found], pa.binary()), batch.column(2)],
            names=["lang", "at", "n", "aside"])


class Model:
    """Weights by feature and language (IDF and scale folded in), languages, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def logits(self, at: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        rows = self.weights[at]
        return (rows.mean(0) if share is None else share @ rows) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at = buckets_of(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, k: int, epochs: int = EPOCHS,
                  seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net; an example is (features, their shares of the text, language)."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, share, label = examples[i]
            at, x = np.append(at, BUCKETS), np.append(share * idf[at] * SCALE, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[label] -= 1
            g = np.outer(x, p)
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def calibrate(model: Model, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The temperature of least log-loss on examples kept aside, by golden-section search of its logarithm."""
    if not examples:
        return 1.0
    logits = np.stack([model.logits(at, share) for at, share, _ in examples])
    labels = np.array([e[2] for e in examples])

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        top = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(s)), labels]).mean())

    a, b, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, learns: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the documents of ``docs`` for which ``learns`` holds and language and text are known."""
    known = docs.filter(learns & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    totals = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    seen = {r["bucket"]: r["n"] for r in totals.collect()}  # BUCKETS + 1 rows at most
    n_docs = seen.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    quota = max(2, sample // len(languages))
    rate = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, quota / counts[name])))])
    drawn = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    aside = F.pmod(F.xxhash64("text", F.lit(18)), F.lit(ASIDE)) == 0
    rows = known.filter(drawn < F.element_at(rate, F.col("lang"))).select("lang", "text", aside.alias("aside"))
    place = {name: i for i, name in enumerate(languages)}
    fitting, kept = [], []
    for r in rows.mapInArrow(_sparse, "lang string, at binary, n binary, aside boolean").limit(2 * sample).collect():
        at, n = np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4")
        if len(at):
            (kept if r["aside"] else fitting).append((at, n / n.sum(), place[r["lang"]]))
    order = lambda e: (e[2], len(e[0]), e[0][:8].tolist(), float(e[1].max()))  # noqa: E731  the same order at every run
    fitting, kept = sorted(fitting, key=order), sorted(kept, key=order)
    weights, bias = follow_leader(fitting, idf, len(languages))
    model = Model(languages, (weights * idf[:, None] * SCALE).astype(np.float32), bias.astype(np.float32), 1.0)
    model.temperature = calibrate(model, kept)
    return model


def predict(docs: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with lang_pred and score."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            said = [model.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array([s[0] for s in said], pa.string()),
                                                              pa.array([s[1] for s in said], pa.float64())],
                names=keep + ["lang_pred", "score"])

    narrow = docs.select(*keep, F.col(text).alias("_llm_text"))
    schema = ", ".join([f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return narrow.mapInArrow(run, schema)
