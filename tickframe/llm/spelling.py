"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

Words are counted in the tasks that read the texts and summed by word. One edit moves a word's letter counts by 1 (a letter
more or less) or by exactly 2 in L1 (one letter for another), so the near words of a word of length l lie in three range
searches: radius 1 among words of length l-1 and l+1, radius 2 among words of length l.

Words of one length are dealt to cells of about ``CELL`` words by the upper part of a k-d tree whose planes are fitted on a
bounded sample of the words (``SAMPLE``; only where cells end depends on it). A word is stored in its own cell and asked in
every cell whose box lies within the radius. In a cell a k-d tree with tight boxes is built over the distinct letter counts,
all words asked descend it together, and a subtree is left as soon as its box lies beyond the radius. The order of the
letters of the remaining pairs is compared. Anagrams never meet: their distance is 0 and one edit makes it 1 or 2. Only sums
leave a cell (how many near words, and the best), never pairs.

Results: null or wordless texts bring nothing; a null id counts as empty text before the colon; repeated rows count again;
equal best words are told apart by code points; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import batches, saved

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, TYPO = 5, 3, 97
#: Words of a cell, words of the sample the planes are fitted on, distinct letter counts of a leaf within a cell.
CELL, SAMPLE, LEAF = 20_000, 100_000, 24
#: Words that a task counts before it hands its counts on, and pairs compared at once.
HELD, PAIRS = 300_000, 200_000

# Latin-1 bytes: A-Z in lower case, letters as they are, all else a space.
_TO_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_DIM = np.zeros(256, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:] = np.arange(26, 90)
DIMS = 90


# --- words ---------------------------------------------------------------------------------------

def document_words(key: str, text: str) -> Counter:
    """Words (Latin-1 bytes) of one text with their counts: runs of letters in lower case, now and then with a letter less."""
    start = zlib.crc32(f"{key}:".encode())
    counts = Counter()
    # Characters beyond Latin-1 become '?', which ends a run as they do.
    for run, n in Counter(text.encode("latin-1", "replace").translate(_TO_RUNS).split()).items():
        if len(run) < MIN_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % TYPO == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_LENGTH:
                continue
        counts[run] += n
    return counts


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words of at least ``MIN_LENGTH`` letters that occur ``MIN_COUNT`` times or more."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def rows() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches(source):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update(document_words(key, text))
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()

    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = read.filter("text IS NOT NULL").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# --- trees ---------------------------------------------------------------------------------------

def letter_counts(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _DIM[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(row * DIMS + letters, minlength=len(words) * DIMS).reshape(-1, DIMS).astype(np.int32)


class Tree:
    """A k-d tree over rows of small counts. ``tight`` boxes enclose the points; others are bounded by the planes alone, so
    that points not seen when the tree was built belong to a leaf as well."""

    def __init__(self, points: np.ndarray, leaf_size: float, tight: bool):
        self.low, self.high, self.children, self.plane, self.members = [], [], [], [], {}
        pending = [(np.arange(len(points)), np.zeros(points.shape[1], np.int32), np.full(points.shape[1], 1 << 30, np.int32), None)]
        while pending:
            inside, low, high, parent = pending.pop()
            node = len(self.low)
            some = points[inside]
            if tight:
                low, high = some.min(axis=0), some.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.plane.append(None)
            if parent is not None:
                self.children[parent].append(node)
            cut = _balanced_cut(some) if len(inside) > leaf_size else None
            if cut is None:
                self.members[node] = inside
                continue
            dim, at = self.plane[node] = cut
            below = some[:, dim] <= at
            left, right = high.copy(), low.copy()
            left[dim], right[dim] = at, at + 1
            # The last one pushed is built first: children end up in the order left, right.
            pending += [(inside[~below], right, high, node), (inside[below], low, left, node)]
        self.leaf_number = {node: k for k, node in enumerate(self.members)}

    def home(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of every point, by the planes."""
        home = np.zeros(len(points), np.int64)
        pending = [(0, np.arange(len(points)))]
        while pending:
            node, some = pending.pop()
            if self.plane[node] is None:
                home[some] = self.leaf_number[node]
            elif len(some):
                dim, at = self.plane[node]
                below = points[some, dim] <= at
                left, right = self.children[node]
                pending += [(left, some[below]), (right, some[~below])]
        return home

    def reach(self, points: np.ndarray, radius: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf node, places of the points whose distance to its box is within their radius)."""
        pending = [(0, np.arange(len(points)))]
        while pending:
            node, some = pending.pop()
            asked = points[some]
            far = np.maximum(self.low[node] - asked, 0).sum(axis=1) + np.maximum(asked - self.high[node], 0).sum(axis=1)
            some = some[far <= radius[some]]
            if len(some):
                if node in self.members:
                    yield node, some
                else:
                    pending += [(child, some) for child in self.children[node]]


def _balanced_cut(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value) of the plane nearest to halving the points; None if all are equal."""
    at = np.floor(points.mean(axis=0)).astype(np.int64)
    share = (points <= at).mean(axis=0)
    dim = int(np.argmin(np.abs(share - 0.5)))
    return None if share[dim] == 1 else (dim, int(at[dim]))


# --- cells ---------------------------------------------------------------------------------------

def _upper_trees(words: DataFrame) -> dict[int, Tree]:
    """Trees for the lengths with more words than a cell holds; at most ``SAMPLE`` words or so are looked at."""
    sizes = {r["size"]: r["count"] for r in words.groupBy(F.length("word").alias("size")).count().filter(F.col("count") > CELL).collect()}
    if not sizes:
        return {}
    step = sum(sizes.values()) // SAMPLE + 1
    drawn = words.filter(F.length("word").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(step)) == 0)).select("word").collect()
    by_size = {}
    for row in drawn:
        by_size.setdefault(len(row["word"]), []).append(row["word"].encode("latin-1"))
    return {size: Tree(letter_counts(sorted(some)), max(1.0, len(some) * CELL / sizes[size]), tight=False) for size, some in by_size.items()}


def _dealt(trees: dict[int, Tree]):
    """Rows (size, cell, word, n): a word with its count in its own cell and without in each cell where it asks."""

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1 << 20):
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts, sizes = letter_counts(words), np.array([len(w) for w in words])
            size, cell, row, own = [], [], [], []

            def put(of_size, in_cell, rows, is_home):
                size.append(of_size)
                cell.append(np.broadcast_to(in_cell, len(rows)))
                row.append(rows)
                own.append(np.full(len(rows), is_home))

            for length in np.unique(sizes):
                some = np.flatnonzero(sizes == length)
                tree = trees.get(int(length))
                put(np.full(len(some), length), tree.home(counts[some]) if tree else 0, some, True)
                for other, radius in ((length - 1, 1), (length, 2), (length + 1, 1)):
                    tree = trees.get(int(other))
                    for node, which in tree.reach(counts[some], np.full(len(some), radius)) if tree else [(None, np.arange(len(some)))]:
                        put(np.full(len(which), other), tree.leaf_number[node] if tree else 0, some[which], False)
            at = np.concatenate(row)
            n = batch.column(1).take(pa.array(at)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(size), pa.int32()), pa.array(np.concatenate(cell), pa.int32()), batch.column(0).take(pa.array(at)),
                 pa.array(n, pa.int64(), mask=~np.concatenate(own))], names=["size", "cell", "word", "n"])

    return deal


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart; widths are equal or differ by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= short.shape[1]


def near_in_cell(home: list[bytes], n: np.ndarray, asked: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every asked word the number of near words in ``home`` (sorted, of one length) and the place of the best, or -1."""
    vectors, vector_of = np.unique(letter_counts(home), axis=0, return_inverse=True)
    members = np.argsort(vector_of, kind="stable")
    ends = np.cumsum(np.bincount(vector_of, minlength=len(vectors)))
    counts = letter_counts(asked)
    used = np.flatnonzero(vectors.any(axis=0) | counts.any(axis=0))
    vectors, counts = vectors[:, used], counts[:, used]
    sizes = np.array([len(w) for w in asked])
    length = len(home[0])
    change = np.where(sizes == length, 2, 1)
    tree = Tree(vectors, LEAF, tight=True)
    home_letters = _letters(home)
    places = {size: np.flatnonzero(sizes == size) for size in np.unique(sizes)}
    asked_letters = {size: _letters([asked[i] for i in rows]) for size, rows in places.items()}
    place_in = np.zeros(len(asked), np.int64)
    for rows in places.values():
        place_in[rows] = np.arange(len(rows))
    rank = np.empty(len(home), np.int64)
    rank[np.lexsort((np.arange(len(home)), -n))] = np.arange(len(home))
    n_near, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(home))

    def compare(who: np.ndarray, vector: np.ndarray) -> None:
        """Asked words against all words of a letter count, a bounded number of pairs at a time."""
        first = np.concatenate(([0], ends))[vector]
        width = ends[vector] - first
        upto = np.cumsum(width)
        at = 0
        while at < len(who):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            pair = np.repeat(np.arange(at, stop), width[at:stop])
            inside = np.arange(len(pair)) - np.repeat(upto[at:stop] - width[at:stop] - (upto[at - 1] if at else 0), width[at:stop])
            q, h = who[pair], members[first[pair] + inside]
            for size, letters in asked_letters.items():
                same = sizes[q] == size
                if same.any():
                    p, g = q[same], h[same]
                    found = one_edit(letters[place_in[p]], home_letters[g])
                    np.add.at(n_near, p[found], 1)
                    np.minimum.at(best, p[found], rank[g[found]])
            at = stop

    for node, some in tree.reach(counts, change):
        inside = tree.members[node]
        for at in range(0, len(some), 1 + PAIRS // (8 * len(inside))):
            who = some[at:at + 1 + PAIRS // (8 * len(inside))]
            distance = np.abs(counts[who][:, None, :] - vectors[inside][None, :, :]).sum(axis=2)
            q, v = np.nonzero(distance == change[who][:, None])
            if len(q):
                compare(who[q], inside[v])
    by_rank = np.append(np.argsort(rank), -1)
    return n_near, by_rank[best]


def _near(table: pa.Table) -> pa.Table:
    words, n = table.column("word").to_pylist(), table.column("n").fill_null(0).to_numpy()  # a count is never 0
    known, asked_at = np.flatnonzero(n), np.flatnonzero(n == 0)
    out = {"word": [], "n_near": [], "best_n": [], "best": []}
    if len(known) and len(asked_at):
        home = sorted((words[i].encode("latin-1"), n[i]) for i in known)
        asked = [words[i].encode("latin-1") for i in asked_at]
        counts = np.array([k for _, k in home], np.int64)
        n_near, best = near_in_cell([w for w, _ in home], counts, asked)
        some = np.flatnonzero(n_near)
        out = {"word": [words[asked_at[i]] for i in some], "n_near": n_near[some], "best_n": counts[best[some]],
               "best": [home[b][0].decode("latin-1") for b in best[some]]}
    return pa.table([pa.array(out["word"], pa.string()), pa.array(out["n_near"], pa.int64()), pa.array(out["best_n"], pa.int64()),
                     pa.array(out["best"], pa.string())], names=list(out))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near word; ``words`` is a written table (word, n)."""
    dealt = words.select("word", "n").mapInArrow(_dealt(_upper_trees(words)), "size int, cell int, word string, n long")
    found = dealt.groupBy("size", "cell").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form. A form occurs at least twice as often, so chains are no longer than the
    logarithm of the largest count, and pointers that double reach their end in the logarithm of that."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = saved(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                    "roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = saved(word_counts(docs, id_col, text_col), "words")
    good = F.col("best_n") >= 2 * F.col("n")
    judged = saved(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
