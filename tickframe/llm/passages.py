"""Substring dedup by hashing windows of words.

A text is a row of words in lower case, of characters where a script has no spaces between words. Every window of ``min_words`` words that follow each other is looked at, wherever
it begins; one that occurs at an earlier place by (rank, text hash, place) is removed, and so a passage goes word by word
from its first shared word to its last. A word is removed only as part of a run of ``min_words`` words or more that stand
in this order in one earlier place, so short sentences and names which recur by chance stay. The earliest occurrence of a
word is never removed, so every word survives once.

Most windows occur once, so they are not grouped themselves at first. Each is given a seed, the least hash of the runs of
half its words inside it. Equal windows have equal seeds and neighbours mostly share theirs, so seeds are few, and only places
of seeds that occur more than once are looked at again. Such a place is digested (128 bits) with its context, the words of
every window that can hold it: where that occurs earlier, all windows of the place do, by one row. What is left is where a
shared passage begins, ends or was edited: places of one seed in different contexts, of which the earliest of each context is
taken apart into windows, which are digested and grouped over all documents.

Null text stays null, empty text empty. Rows that equal each other in rank and text are one document here and are
treated alike. Rank nulls come last. Removed spans are given as (start, length) in code points of the original text. Units,
the pieces at line ends, after sentence ends and before a capitalised word, are what the number of removed units counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import HOT_SHARE, batches, released, saved

MIN_WORDS = 20
_CUT = re.compile(r"[ \t\r\f\v]*\n\s*|(?<=[.!?])[ \t]+|[ \t]+(?=[^\W\d_a-zß-öø-ÿ])")

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
_CLOSE = r"\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_TOKEN, _CLOSED = re.compile(rf"[{_CLOSE}]|[^\s{_CLOSE}]+"), re.compile(f"[{_CLOSE}]")
#: Stands where a text has no word; the bytes of a word from which it is hashed by itself.
_NO_WORD, LONG_WORD = np.uint64(0xD6E8FEB86659FD93), 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def units(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with the white space after it) of every unit that is not blank."""
    at = 0
    for cut in _CUT.finditer(text):
        if cut.start() > at:
            yield at, cut.start(), cut.end()
        at = cut.end()
    if at < len(text):
        yield at, len(text), len(text)


def normalised(unit: str) -> tuple[bytes, int]:
    """The unit's 128-bit digest and its number of words."""
    words = unit.lower().split()
    return xxhash.xxh3_128_digest(" ".join(words).encode()), len(words)


def tokens(text: str) -> list[str]:
    """The words of a text, in lower case; each character is one where a script has no spaces between words."""
    return _TOKEN.findall(text.lower()) if not text.isascii() and _CLOSED.search(text) else text.lower().split()


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of every word (none holds a blank), eight bytes of all words at a time; of long words xxh3."""
    raw = np.frombuffer(" ".join([*words, ""]).encode(errors="surrogatepass") + bytes(8), np.uint8)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate((np.zeros(1, np.int64), ends + 1))[:len(words)]
    left = ends - starts
    out = left.astype(np.uint64) * _STEP
    long = np.flatnonzero(left > LONG_WORD)
    at = np.flatnonzero(left <= LONG_WORD)
    while len(at):
        part = eight[starts[at]] & _FIRST_BYTES[np.minimum(left[at], 8)]
        part ^= out[at]
        for bits in (32, 29):
            part ^= part >> np.uint64(bits)
            part *= _MIX
        out[at] = part ^ (part >> np.uint64(32))
        starts[at] += 8
        left[at] -= 8
        at = at[left[at] > 0]
    out[long] = [xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


class _Words:
    """The words of several texts in one row of hashes, with ``before`` and ``after`` places that hold no word around each text."""

    def __init__(self, texts: list[str], before: int = 0, after: int = 0):
        words = [tokens(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes + (before + after)) - self.sizes - after
        n, self.text = int(self.sizes.sum()), np.repeat(np.arange(len(texts)), self.sizes)
        #: where each word stands in the row
        self.at = np.arange(n) + (self.starts - np.cumsum(self.sizes) + self.sizes)[self.text]
        self.own = np.full(n + len(texts) * (before + after), _NO_WORD)
        self.own[self.at] = word_hashes(list(chain.from_iterable(words)))

    def seeds(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, place, place of the seed's run, the first if it is there twice, and the seed) of every window of
        ``min_words`` words."""
        half = max(1, min_words // 2)
        whole = self.at + min_words <= (self.starts + self.sizes)[self.text]
        at, runs = self.at[whole], run_hashes(self.own, half)
        places = first_least(runs, min_words - half + 1)[at] if len(at) else at
        return self.text[whole], at, places, runs[places]

    def digests(self, at: np.ndarray, n: int) -> pa.Array:
        """128 bits of the ``n`` words from each of the places."""
        both = np.empty((len(at), 2), np.uint64)
        if len(at):
            both[:, 0] = run_hashes(self.own, n)[at]
            other = self.own * _MIX
            both[:, 1] = run_hashes(other ^ (other >> np.uint64(29)), n)[at]
        ends = np.arange(0, 16 * len(at) + 1, 16, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(both)])


def run_hashes(own: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` hashes of words, put together from runs of 1, 2, 4, ... words."""
    if len(own) < n:
        return np.empty(0, np.uint64)

    def after(a: np.ndarray, width: int, b: np.ndarray, more: int) -> np.ndarray:
        last = len(own) - width - more + 1
        out = a[:last] * np.uint64(pow(int(_STEP), more, 1 << 64))
        out += b[width:width + last]
        return out

    whole, done, part, width = None, 0, own, 1
    while True:
        if n & width:
            whole, done = (part if whole is None else after(whole, done, part, width)), done + width
        if done == n:
            break
        part, width = after(part, width, part, width), 2 * width
    out = whole ^ (whole >> np.uint64(32))
    out *= _MIX
    return out


def first_least(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the least of every ``n`` values in a row, the first of equal ones."""
    at, best, width = np.arange(len(values)), values, 1
    while width < n:
        step = min(width, n - width)
        lower = best[step:] < best[:-step]
        at, best = np.where(lower, at[step:], at[:-step]), np.minimum(best[:-step], best[step:])
        width += step
    return at


def _new(places: np.ndarray) -> np.ndarray:
    """Which places are not the one before; places of seeds never go back."""
    return np.concatenate(([True], places[1:] != places[:-1])) if len(places) else np.empty(0, bool)


def _seeds(min_words: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1 << 20):
            text, _, places, found = _Words(batch.column("_llm_text").to_pylist()).seeds(min_words)
            # once for each place, which neighbouring windows share; a text that repeats itself has it at several
            new = _new(places)
            at = pa.array(text[new])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_llm_rank").take(at), batch.column("_llm_tie").take(at), pa.array(found[new].view(np.int64))],
                names=["_llm_rank", "_llm_tie", "_llm_seed"])

    return run


def _contexts(min_words: int):
    """Every place of a seed that occurs more than once, with the digest of all words of windows that can hold it."""
    more = min_words - max(1, min_words // 2)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1 << 20):
            words = _Words(batch.column("_llm_text").to_pylist(), more, min_words)
            text, _, places, found = words.seeds(min_words)
            # a seed that one of the texts has in its set occurs more than once, whichever text it is met in
            hit = _new(places)
            hit[hit] = np.isin(found[hit], batch.column("_llm_seeds").flatten().to_numpy().view(np.uint64))
            text, places, found = text[hit], places[hit], found[hit]
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_llm_rank").take(at), batch.column("_llm_tie").take(at), pa.array((places - words.starts[text]).astype(np.int32)),
                 pa.array(found.view(np.int64)), words.digests(places - more, more + min_words)],
                names=["_llm_rank", "_llm_tie", "_llm_word", "_llm_seed", "_llm_digest"])

    return run


def _windows(min_words: int):
    """The windows of the given places, digested."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1 << 20):
            words = _Words(batch.column("_llm_text").to_pylist())
            text, windows = windows_of(words, batch.column("_llm_places"), min_words)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_llm_rank").take(at), batch.column("_llm_tie").take(at), pa.array((windows - words.starts[text]).astype(np.int32)),
                 words.digests(windows, min_words)], names=["_llm_rank", "_llm_tie", "_llm_word", "_llm_digest"])

    return run


def windows_of(words: _Words, wanted: pa.ListArray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place) of the windows whose seed lies at one of the places that ``wanted`` has for the text."""
    text, windows, places, _ = words.seeds(min_words)
    marks = np.zeros(len(words.own), bool)
    sizes = wanted.value_lengths().fill_null(0).to_numpy()
    marks[np.repeat(words.starts, sizes) + wanted.flatten().to_numpy()] = True
    hit = marks[places]
    return text[hit], windows[hit]


def _word_starts(text: str) -> np.ndarray:
    """Where every word of ``_TOKEN`` begins."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[points]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    return np.flatnonzero((kind == 2) | (kind == 1) & (before != 1))


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 white space, 2 a word of its own, 1 any other."""
    out = np.ones(0x110000, np.uint8)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = 0
    for a, b in re.findall(r"(.)-(.)", _CLOSED.pattern.encode().decode("unicode_escape")):
        out[ord(a):ord(b) + 1] = 2
    return out


def _whole_units(text: str, start: int, end: int) -> int:
    """The number of units that lie between both places. A cut never reaches over a character that is not blank, so only the white
    space before the first place is looked at with it."""
    n, from_, at = 0, start, 0 if start == 0 else None
    while from_ and text[from_ - 1].isspace():
        from_ -= 1
    for cut in _CUT.finditer(text, from_):
        n += at is not None and at < cut.start() <= end
        if cut.end() >= end:
            return n
        if cut.end() >= start:
            at = cut.end()
    return n + (at is not None and at < len(text) <= end)


def without_windows(text: str, later: list[int], min_words: int) -> tuple[str, list[tuple[int, int]], int]:
    """The text without its windows that occur earlier, the spans removed and the number of units wholly removed.
    ``later`` holds the first words of those windows, in order."""
    starts = [*_word_starts(text).tolist(), len(text)]
    runs: list[list[int]] = []
    for i in later:
        if runs and i <= runs[-1][1]:
            runs[-1][1] = i + min_words
        else:
            runs.append([i, i + min_words])
    spans = [(starts[a], starts[b] - starts[a]) for a, b in runs]
    return _without(text, spans), spans, sum(_whole_units(text, start, start + length) for start, length in spans)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, length in spans:
        kept.append(text[at:start])
        at = start + length
    kept.append(text[at:])
    return "".join(kept)


def cleaned(text: str, later: list[int], min_words: int) -> tuple[str, list[tuple[int, int]], int]:
    """By whole units: the text without its runs of later occurrences, the spans removed and the number of units removed. ``later``
    holds the places of units that occur earlier, in order."""
    marks, spans, run, words, removed = set(later), [], [], 0, 0

    def close() -> None:
        nonlocal run, words, removed
        if words >= min_words:
            spans.append((run[0][0], run[-1][1] - run[0][0]))
            removed += len(run)
        run, words = [], 0

    for i, (a, b, after) in enumerate(units(text)):
        if i in marks:
            run.append((a, after))
            words += len(text[a:b].split())
        else:
            close()
    close()
    return _without(text, spans), spans, removed


def _clean(min_words: int, columns: list[str], schema: pa.Schema | None = None):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts, laters, places = (batch.column(c) for c in ("_llm_text", "_llm_later", "_llm_places"))
            held = np.flatnonzero(places.value_lengths().fill_null(0).to_numpy())
            words = _Words(texts.take(pa.array(held)).to_pylist())
            text, windows = windows_of(words, places.take(pa.array(held)), min_words)
            parts = np.split(windows - words.starts[text], np.searchsorted(text, np.arange(1, len(held))))
            more = dict(zip(held.tolist(), parts))
            out = []
            for k, (text, later) in enumerate(zip(texts.to_pylist(), laters.to_pylist())):
                if k in more:
                    later = sorted({*(later or ()), *more[k].tolist()})
                out.append(without_windows(text, later, min_words) if later else (text, [], 0))
            kept = [batch.column(c) for c in columns]
            spans = pa.array([[{"start": s, "length": n} for s, n in o[1]] for o in out],
                             pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array([o[0] for o in out], pa.string()), spans, pa.array([o[2] for o in out], pa.int64())],
                names=columns + ["_llm_clean", "_llm_removed", "_llm_n_removed"])

    return run


def _by_document(body: DataFrame, what: DataFrame, column: str) -> DataFrame:
    """``body`` of the documents that ``what`` has values of ``column`` for, with the set of them."""
    sets = what.groupBy("_llm_rank", "_llm_tie").agg(F.collect_set(column).alias("_llm_set")).withColumnsRenamed(
        {"_llm_rank": "_llm_r", "_llm_tie": "_llm_t"})
    return body.join(sets, F.col("_llm_rank").eqNullSafe(F.col("_llm_r")) & (F.col("_llm_tie") == F.col("_llm_t")))


def _with_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """Join per-key facts (saved; n is the number of rows with the key, ``total`` of all) to many rows. Hot keys, fewer than
    1/HOT_SHARE by their definition, come to the driver: a filter parts their rows, which meet broadcast facts unshuffled."""
    hot, cold = facts.filter(F.col("n") > HOT_SHARE * total).drop("n"), facts.filter(F.col("n") <= HOT_SHARE * total).drop("n")
    marks = [r[0] for r in hot.select(key).collect()]
    if not marks:
        return rows.join(cold, key)
    return rows.filter(F.col(key).isin(marks)).join(F.broadcast(hot), key).unionByName(
        rows.filter(~F.col(key).isin(marks)).join(cold, key))


def _after_first(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows whose digest stands at an earlier place; ``firsts`` has the first place and the number n of every digest."""
    shared = firsts.filter("n > 1").select("_llm_digest", "first", "n")
    return _with_facts(rows, shared, "_llm_digest", rows.count()).filter(~(_place() == F.col("first")))


def _place() -> Column:
    return F.struct(F.col("_llm_rank").isNull().alias("none"), "_llm_rank", "_llm_tie", "_llm_word")


def later_windows(docs: DataFrame, rank: str, text: str, min_words: int) -> DataFrame:
    """(_llm_rank, _llm_tie, _llm_later, _llm_places): for every document with one, the first words of windows that occur
    earlier, and the places of seeds all of whose windows do; either may be null."""
    body = docs.select(F.col(rank).alias("_llm_rank"), F.xxhash64(text).alias("_llm_tie"), F.col(text).alias("_llm_text"))
    body = body.filter("_llm_text is not null")
    kind = body.schema["_llm_rank"].dataType.simpleString()
    keys = f"_llm_rank {kind}, _llm_tie long"
    seeded = saved(body.mapInArrow(_seeds(min_words), f"{keys}, _llm_seed long"), "seeds")
    often = saved(seeded.groupBy("_llm_seed").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    some = _by_document(body, _with_facts(seeded, often, "_llm_seed", seeded.count()), "_llm_seed")
    contexts = saved(some.select("_llm_rank", "_llm_tie", "_llm_text", F.col("_llm_set").alias("_llm_seeds")).mapInArrow(
        _contexts(min_words), f"{keys}, _llm_word int, _llm_seed long, _llm_digest binary"), "contexts")
    released(seeded, often)
    firsts = saved(contexts.groupBy("_llm_digest").agg(
        F.min(_place()).alias("first"), F.count("*").alias("n"), F.min("_llm_seed").alias("_llm_seed")), "firsts")
    places = saved(_after_first(contexts.drop("_llm_seed"), firsts).groupBy("_llm_rank", "_llm_tie").agg(
        F.sort_array(F.collect_set("_llm_word")).alias("_llm_places")), "places")
    released(contexts)
    forks = saved(firsts.groupBy("_llm_seed").agg(F.count("*").alias("n")).filter("n > 1"), "forks")
    apart = _with_facts(firsts.select("_llm_seed", "first"), forks, "_llm_seed", firsts.count()).select("first.*")
    found = saved(_by_document(body, apart, "_llm_word").select("_llm_rank", "_llm_tie", "_llm_text", F.col("_llm_set").alias("_llm_places")).mapInArrow(
        _windows(min_words), f"{keys}, _llm_word int, _llm_digest binary"), "windows")
    released(firsts, forks)
    shared = saved(found.groupBy("_llm_digest").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1"), "shared")
    later = _after_first(found, shared).groupBy("_llm_rank", "_llm_tie").agg(F.sort_array(F.collect_set("_llm_word")).alias("_llm_later"))
    both = saved(later.unionByName(places, allowMissingColumns=True).groupBy("_llm_rank", "_llm_tie").agg(
        F.first("_llm_later", True).alias("_llm_later"), F.first("_llm_places", True).alias("_llm_places")), "later")
    released(found, shared, places)
    return both


def without_repeats(docs: DataFrame, rank: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text cleaned and the columns _llm_removed (spans) and _llm_n_removed (units)."""
    later = later_windows(docs, rank, text, min_words).withColumnsRenamed({"_llm_rank": "_llm_r", "_llm_tie": "_llm_t"})
    keyed = docs.withColumn("_llm_t0", F.xxhash64(text))
    joined = keyed.join(later, keyed[rank].eqNullSafe(later["_llm_r"]) & (F.col("_llm_t0") == F.col("_llm_t")), "left")
    columns = [c for c in docs.columns if c != text]
    flat = joined.select(*columns, F.col(text).alias("_llm_text"), "_llm_later", "_llm_places")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [
        "_llm_clean string, _llm_removed array<struct<start:long,length:long>>, _llm_n_removed long"])
    done = flat.mapInArrow(_clean(min_words, columns), schema)
    return done.select(*[F.col("_llm_clean").alias(text) if c == text else F.col(c) for c in docs.columns],
                       "_llm_removed", "_llm_n_removed")
