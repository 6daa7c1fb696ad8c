"""Near-duplicates by SimHash and a binary trie self-join.

A fingerprint word has a bit set where more than half of the document's shingle hashes have it. Two fingerprints link
when a word of theirs differs in at most ``bits`` bits. The search walks a binary trie against itself: a pair of
nodes carries the number of bits in which their paths differ and is dropped once that exceeds the budget.

The trie is dealt out by its top: if ``bits`` bits may differ among ``bits + c`` blocks of a word, some c blocks are
equal. So for every choice of c blocks, fingerprints that agree there form one trie of their own, keyed by those
bits. ``c`` follows the number of fingerprints, such that a trie of random ones stays small; every c finds all links.
Each choice is one more row a fingerprint, so the tries are dealt in rounds: the rows of one take no more of the disk than
about half of the texts do, and are gone before the next.

Copies are one fingerprint before any of this, so a group of copies costs no pairs, and a node pair whose leaves are
all connected already is skipped, so a dense group costs no list of its pairs either. What comes out is a forest of
links with the same components.

SimHash only estimates similarity. ``one_of_each`` takes such links as candidates: it compares the shingle sets of both
ends and groups by the links that reach the line. A node without a link in the first forest has no candidate at all; the
others are walked again with parity sketches, of which the differing bits never exceed the differing shingles. So a pair
whose sketches differ too much is below the line for certain and never leaves its task, and what does is nearly always a
link: a forest of such pairs is enough, however dense the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import batches, join_facts, released, saved
from tickframe.llm.graph import components

SEED = 42
#: A trie of random fingerprints should hold about this many leaves at most. Fewer leaves are fewer comparisons, but each
#: block more that must agree is several times the rows.
TRIE_LEAVES = 4096
#: Node pairs with at most this many leaf pairs are compared leaf by leaf, many at once; those with at most so many one by one.
LEAF_PAIRS, BLOCK_PAIRS = 1 << 10, 1 << 16
#: Leaf pairs compared at once, and node pairs walked at once.
CHUNK = 1 << 19
TASK_ROWS = 200_000
TASK_BYTES = 64 << 20
#: Bytes of a dealt row, of which its shuffle files take about half; of the rows of a round in any case, for a shingle of the
#: documents and, where these are not known, for a fingerprint.
ROW_BYTES, ROUND_BYTES, SHINGLE_BYTES, PRINT_BYTES = 48, 512 << 20, 6, 3072
#: For the rounding of line * size.
SLACK = 1e-9
#: A parity sketch has at least this many bits a shingle, and less than twice as many.
SKETCH_BITS = 4
#: Bytes of sketches compared at once.
SKETCH_BYTES = 8 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; of all words if there are fewer; none without a word. Only A-Z is
    lower-cased and only ASCII white space parts words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed 64-bit fingerprint words; the first is of the hashes themselves, others of mixed ones."""
    out = []
    for k in range(words):
        mixed = hashes
        if k:
            mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX[(k - 1) % 3]
            mixed ^= mixed >> np.uint64(29 + k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            part = mixed[at:at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = 2 * ones > len(mixed)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """A signed 64-bit digest of the set of hashes and its size."""
    own = np.unique(hashes)
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)), len(own)


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """For every place of a row of bits, whether an odd number of these distinct hashes fall on it. The row is a power of
    two of bytes, and one half as long is the exclusive or of its halves."""
    n = 64
    while n < SKETCH_BITS * len(own):
        n *= 2
    at = own & np.uint64(n - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=n) & 1).astype(bool), bitorder="little")


class Sketches:
    """The sketches of nodes, by length."""

    def __init__(self, rows: list[bytes], size: np.ndarray, line: float):
        self.size, self.line = size, line
        self.length = np.array([len(r) for r in rows], np.int64)
        self.place = np.zeros(len(rows), np.int64)
        self.bits: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == n)
            self.place[own] = np.arange(len(own))
            self.bits[n] = np.frombuffer(b"".join(rows[i] for i in own.tolist()), np.uint64).reshape(len(own), n // 8)

    def can_reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the nodes' sets may have a Jaccard similarity of ``line``; true for all that have."""
        a, b = np.where(self.length[a] < self.length[b], b, a), np.where(self.length[a] < self.length[b], a, b)
        apart = np.zeros(len(a), np.int64)
        kinds = self.length[a] * (1 << 32) + self.length[b]
        for kind in np.unique(kinds).tolist():
            which = np.flatnonzero(kinds == kind)
            for part in np.array_split(which, len(which) * (kind >> 32) // SKETCH_BYTES + 1):
                left, right = self.bits[kind >> 32][self.place[a[part]]], self.bits[kind & 0xFFFFFFFF][self.place[b[part]]]
                while left.shape[1] > right.shape[1]:
                    half = left.shape[1] // 2
                    left = left[:, :half] ^ left[:, half:]
                apart[part] = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
        both = self.size[a] + self.size[b]
        return apart <= (1 - self.line) / (1 + self.line) * both + SLACK


def _fingerprints(shingle: int, words: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            rows = [fingerprint(shingle_hashes(t.as_py(), shingle), words) for t in batch.column("_llm_text")]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            prints = [pa.array([r[k] for r in rows], pa.int64()) for k in range(words)]
            yield pa.RecordBatch.from_arrays(kept + prints, names=batch.schema.names[:-1] + [f"fp{k}" for k in range(words)])

    return run


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4, words: int = 1, text: str = "text") -> DataFrame:
    """The columns ``keep`` and fp0, fp1, ... of every document; null text has no words and so all bits clear."""
    narrow = docs.select(*keep, F.col(text).cast("binary").alias("_llm_text"))
    schema = ", ".join([f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep] + [f"fp{k} long" for k in range(words)])
    return narrow.mapInArrow(_fingerprints(shingle, words), schema)


def _shingled(shingle: int, words: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            hashes = [shingle_hashes(t.as_py(), shingle) for t in batch.column("_llm_text")]
            prints = [fingerprint(h, words) for h in hashes]
            sets = [set_digest(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_llm_id"), batch.column("_llm_tie"), pa.array([d for d, _ in sets], pa.int64()),
                 pa.array([n for _, n in sets], pa.int64()), *[pa.array([r[k] for r in prints], pa.int64()) for k in range(words)]],
                names=["_llm_id", "_llm_tie", "node", "size"] + [f"fp{k}" for k in range(words)])

    return run


def _shingle_sets(shingle: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column("_llm_text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _sketched(shingle: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            sketches = [parity_sketch(np.unique(shingle_hashes(t.as_py(), shingle))).tobytes() for t in batch.column("_llm_text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sketches, pa.binary())], names=["node", "sketch"])

    return run


def blocks_for(bits: int, n: int) -> tuple[int, list[int]]:
    """The number of equal blocks c and the masks of all choices of c among bits + c blocks."""
    for c in range(1, 65 - bits):
        widths = sorted(64 // (bits + c) + (i < 64 % (bits + c)) for i in range(bits + c))
        if n <= TRIE_LEAVES << sum(widths[:c]) or comb(bits + c + 1, c + 1) > 1000:
            break
    masks, at = [], 0
    for i in range(bits + c):
        width = 64 // (bits + c) + (i < 64 % (bits + c))
        masks.append(((1 << width) - 1) << at)
        at += width
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return c, [signed(sum(choice)) for choice in combinations(masks, c)]


class _Forest:
    """Which nodes are connected so far: the label of a node is the smallest node connected to it. ``owner`` is the node of
    every leaf, the same in all tries that it stands in, and ``node`` the number of its sketch if there are any."""

    def __init__(self, owner: np.ndarray, node: np.ndarray | None = None):
        self.owner, self.node = owner, node
        self.label = np.arange(int(owner.max(initial=-1)) + 1)
        self._steps()

    def _steps(self) -> None:
        self.leaf = self.label[self.owner]
        self.change = np.concatenate(([0], np.cumsum(self.leaf[1:] != self.leaf[:-1])))

    def fresh(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.leaf[a] != self.leaf[b]

    def one(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Whether all leaves from s to e - 1 have one label."""
        return self.change[e - 1] == self.change[s]

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Connect the pairs and return those that made a connection, one for each, at most n - 1 in all."""
        made = []
        while True:
            x, y = self.label[self.owner[a]], self.label[self.owner[b]]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            made.append((a[first], b[first]))
            up = np.arange(len(self.label))
            up[high[first]] = low[first]
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]
        if made:
            self._steps()
            return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        return np.empty(0, np.int64), np.empty(0, np.int64)


class _Every(_Forest):
    """Keeps every pair between nodes that are not connected from the start, and connects none."""

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        open_ = self.fresh(a, b)
        return a[open_], b[open_]


def _compare(fp: np.ndarray, pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The near ones of all leaf pairs of the node pairs (columns s1 e1 s2 e2) in one chunk."""
    s1, e1, s2, e2 = pairs
    counts = (e1 - s1) * (e2 - s2)
    at = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = (e2 - s2)[at]
    a, b = s1[at] + k // width, s2[at] + k % width
    up = a < b
    a, b = a[up], b[up]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[near], b[near]


def _compare_blocks(fp: np.ndarray, forest: _Forest, pairs: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near leaf pairs of larger node pairs, all leaves of one node with all of the other; given out when there are many, so
    that those which are connected by then need no comparing."""
    held, n = [], 0
    for s1, e1, s2, e2 in pairs.T.tolist():
        if forest.one(s1, e1) and forest.one(s2, e2) and not forest.fresh(s1, s2):
            continue
        near = np.flatnonzero(np.bitwise_count(fp[s1:e1, None] ^ fp[s2:e2]) <= bits)
        a, b = s1 + near // (e2 - s2), s2 + near % (e2 - s2)
        open_ = (a < b) & forest.fresh(a, b)
        held.append((a[open_], b[open_]))
        n += len(held[-1][0])
        if n > CHUNK:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _joined(forest: _Forest, a: np.ndarray, b: np.ndarray, size: np.ndarray | None = None, line: float = 0.0,
            sketches: Sketches | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Connects near leaf pairs that may reach the line and returns those that made a connection."""
    if size is not None:  # sets that differ more in size cannot reach the line
        near = np.minimum(size[a], size[b]) >= line * np.maximum(size[a], size[b]) - SLACK
        a, b = a[near], b[near]
    if sketches is None:
        return forest.join(a, b)
    made, step = [], LEAF_PAIRS
    while len(a):  # a part at a time, each twice the last, as the links of one settle pairs of the next
        open_ = forest.fresh(a, b)
        a, b = a[open_], b[open_]
        reach = sketches.can_reach(forest.node[a[:step]], forest.node[b[:step]])
        made.append(forest.join(a[:step][reach], b[:step][reach]))
        a, b, step = a[step:], b[step:], 2 * step
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *[m[0] for m in made]]), np.concatenate([empty, *[m[1] for m in made]])


def trie_links(fp: np.ndarray, starts: np.ndarray, bits: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links (leaf positions) among the leaves of several tries. ``fp`` is unsigned and sorted within each
    trie; ``starts`` holds the first leaf of each trie and the number of leaves at its end; ``owner`` numbers the nodes that
    the leaves stand for, each leaf its own if it is missing.

    Node pairs are walked a level at a time in chunks, the deepest first, so memory stays bounded.
    """
    empty = np.empty(0, np.int64)
    found = list(_links(fp, starts, bits, _Forest(np.arange(len(fp)) if owner is None else owner)))
    return np.concatenate([empty, *[a for a, _ in found]]), np.concatenate([empty, *[b for _, b in found]])


def _links(fp: np.ndarray, starts: np.ndarray, bits: int, forest: _Forest, set_size: np.ndarray | None = None,
           line: float = 0.0, sketches: Sketches | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of ``trie_links`` as they are found."""
    roots = np.stack([starts[:-1], starts[1:], starts[:-1], starts[1:]])
    stack = [(63, roots[:, starts[1:] - starts[:-1] > 1], np.zeros(int((starts[1:] - starts[:-1] > 1).sum()), np.int64))]
    zeros: dict[int, np.ndarray] = {}

    def split(level: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Where the leaves with the level's bit set begin in each node; its middle below the last bit."""
        if level < 0:
            return (s + e) // 2
        if level not in zeros:
            bit = (fp >> np.uint64(level)) & np.uint64(1)
            zeros[level] = np.concatenate(([0], np.cumsum(bit == 0)))
        return s + zeros[level][e] - zeros[level][s]

    while stack:
        level, pairs, spent = stack.pop()
        s1, e1, s2, e2 = pairs
        done = forest.one(s1, e1) & forest.one(s2, e2) & ~forest.fresh(s1, s2)
        pairs, spent = pairs[:, ~done], spent[~done]
        s1, e1, s2, e2 = pairs
        size = (e1 - s1) * (e2 - s2)
        small, large = size <= LEAF_PAIRS, size > BLOCK_PAIRS
        if small.any():
            leaves, sizes = pairs[:, small], size[small]
            room = np.cumsum(sizes) // CHUNK
            for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(room)) + 1):
                yield _joined(forest, *_compare(fp, leaves[:, cut], bits), set_size, line, sketches)
        for a, b in _compare_blocks(fp, forest, pairs[:, ~small & ~large], bits):
            yield _joined(forest, a, b, set_size, line, sketches)
        pairs, spent = pairs[:, large], spent[large]
        if not len(spent):
            continue
        if len(spent) > CHUNK:
            half = len(spent) // 2
            stack += [(level, pairs[:, half:], spent[half:]), (level, pairs[:, :half], spent[:half])]
            continue
        s1, e1, s2, e2 = pairs
        m1, m2 = split(level, s1, e1), split(level, s2, e2)
        self_pair = s1 == s2
        children = []
        apart = int(level >= 0)  # below the last bit all leaves of a node are equal
        for s_, e_, t_, f_, cost in ((s1, m1, s2, m2, 0), (m1, e1, m2, e2, 0), (s1, m1, m2, e2, apart), (m1, e1, s2, m2, apart)):
            keep = (e_ > s_) & (f_ > t_) & (spent + cost <= bits)
            if s_ is m1 and t_ is s2:
                keep &= ~self_pair  # a node's halves meet once
            children.append((np.stack([s_, e_, t_, f_])[:, keep], spent[keep] + cost))
        # one entry a level, else the entries would multiply by four with each
        stack.append((level - 1, np.concatenate([c[0] for c in children], 1), np.concatenate([c[1] for c in children])))


def _walk(bits: int, masks: list[int]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(source))
        if not rows.num_rows:
            return
        trie, fp, node = (rows.column(c).to_numpy() for c in ("trie", "fp", "node"))
        key = fp & np.array(masks, np.int64)[trie % len(masks)]
        fp = fp.astype(np.int64).view(np.uint64)
        order = np.lexsort((fp, key, trie))
        trie, key, fp, node = trie[order], key[order], fp[order], node[order]
        new = np.flatnonzero((trie[1:] != trie[:-1]) | (key[1:] != key[:-1])) + 1
        owner = np.unique(node, return_inverse=True)[1]
        a, b = trie_links(fp, np.concatenate(([0], new, [len(fp)])), bits, owner)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def safe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(source)
        return run(iter(held)) if held else iter(())

    return safe


def _walk_candidates(bits: int, masks: list[int], every: bool, line: float, sketched: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(source)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        trie, fp, node, label, size = (rows.column(c).to_numpy() for c in ("trie", "fp", "node", "label", "size"))
        key = fp & np.array(masks, np.int64)[trie % len(masks)]
        fp = fp.astype(np.int64).view(np.uint64)
        order = np.lexsort((fp, key, trie))
        trie, key, fp, label = (x[order] for x in (trie, key, fp, label))
        new = np.flatnonzero((trie[1:] != trie[:-1]) | (key[1:] != key[:-1])) + 1
        nodes, first, owner = np.unique(node, return_index=True, return_inverse=True)
        sketches = None
        if sketched:
            column = rows.column("sketch").combine_chunks()
            sketches = Sketches([column[i].as_py() for i in first.tolist()], size[first], line)
        node, owner, size = node[order], owner[order], size[order]
        forest = (_Every if every else _Forest)(np.unique(label, return_inverse=True)[1], owner)
        for a, b in _links(fp, np.concatenate(([0], new, [len(fp)])), bits, forest, size, line, sketches):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return run


def rounds_for(tries: int, n_bytes: int, room: int) -> list[range]:
    """Which tries are dealt together, if the rows of one take ``n_bytes`` and those of a round should take ``room`` at most:
    consecutive ones, one at least."""
    most = max(1, max(room, ROUND_BYTES) // max(1, n_bytes))
    count = -(-tries // most)
    ends = [tries * k // count for k in range(count + 1)]
    return [range(a, b) for a, b in zip(ends, ends[1:])]


def _dealt(nodes: DataFrame, n: int, bits: int, words: int, *more: str, n_bytes: int = 0,
           room: int | None = None) -> tuple[list[DataFrame], list[int]]:
    """(trie, fp, node, ``more``), a row for each trie that a fingerprint word stands in, dealt out by trie, a frame for each
    round of tries, and the masks. ``n_bytes`` is what the nodes' sketches take, ``room`` what the rows of a round may."""
    masks = blocks_for(bits, n)[1]
    mask = F.get(F.array(*[F.lit(m) for m in masks]), F.col("trie") % len(masks))
    dealt = []
    for tries in rounds_for(len(masks) * words, n * ROW_BYTES + n_bytes, n * PRINT_BYTES if room is None else room):
        tops = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t // len(masks)).alias("k")) for t in tries]))
        rows = nodes.select("node", *more, F.array(*[f"fp{k}" for k in range(words)]).alias("fps"), tops.alias("top")).select(
            F.col("top.t").alias("trie"), F.get("fps", F.col("top.k")).alias("fp"), "node", *more)
        parts = max(n * len(tries) // TASK_ROWS, n_bytes * len(tries) // TASK_BYTES) + 1
        dealt.append(rows.repartition(parts, "trie", F.col("fp").bitwiseAND(mask)))
    return dealt, masks


def _walked(dealt: list[DataFrame], walk) -> list[DataFrame]:
    """The links of each round; those of several are saved, so that the rows of one are gone before the next."""
    found = [rows.mapInArrow(walk, "a long, b long") for rows in dealt]
    return found if len(found) == 1 else [saved(links, "round") for links in found]


def near_links(nodes: DataFrame, n: int, bits: int, words: int = 1) -> DataFrame:
    """Links (a, b) between nodes, whose components are those of all pairs that differ in at most ``bits`` bits in
    one of their words. ``nodes`` has a long column node, distinct, and fp0, fp1, ...; n is their number.

    A task holds the tries that are dealt to it; only distinct fingerprints are left here, and those that agree
    in a trie's top bits are its size.
    """
    dealt, masks = _dealt(nodes, n, bits, words)
    return reduce(DataFrame.unionByName, _walked(dealt, _walk(bits, masks)))


def near_groups(prints: DataFrame, doc_id: str, bits: int, words: int = 1) -> DataFrame:
    """``prints`` (saved; the id and fp0, ...) with _llm_root, which names the component, and component_id, the
    smallest id in it; null ids count only where a component has no other."""
    fps = [f"fp{k}" for k in range(words)]
    node = F.col("fp0") if words == 1 else F.xxhash64(*fps)
    classes = saved(prints.groupBy(*fps).agg(F.min(doc_id).alias("_llm_least"), F.count("*").alias("_llm_copies"))
                    .withColumn("node", node), "classes")
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("_llm_copies"), F.lit(0))).first()
    roots = components(near_links(classes.select("node", *fps), count, bits, words))
    placed = saved(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    least = placed.groupBy("root").agg(F.min("_llm_least").alias("component_id"), F.count("*").alias("_llm_n"))
    labelled = saved(join_facts(placed, saved(least, "least"), "root", "_llm_n", count).select(
        "node", F.col("root").alias("_llm_root"), "component_id", "_llm_copies"), "labels")
    return join_facts(prints.withColumn("node", node), labelled, "node", "_llm_copies", total).drop("node")


def _verified(pairs: DataFrame, n: int, bodies: DataFrame, shingle: int, line: float) -> DataFrame:
    """The pairs (a, b; saved, n in number) whose shingle sets have a Jaccard similarity of ``line`` or more. ``bodies`` has
    the binary _llm_text of every node, once."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    uses = saved(ends.groupBy("node").agg(F.count("*").alias("_llm_uses")), "uses")
    sets = bodies.join(uses.select("node"), "node", "left_semi").mapInArrow(_shingle_sets(shingle), "node long, shingles array<long>")
    sets = saved(sets.join(uses, "node"), "sets")
    left = join_facts(pairs.withColumnRenamed("a", "node"), sets, "node", "_llm_uses", n).select(
        F.col("node").alias("a"), F.col("b").alias("node"), F.col("shingles").alias("_llm_left"))
    both = join_facts(left, sets, "node", "_llm_uses", n)
    shared = F.size(F.array_intersect("_llm_left", "shingles"))
    union = F.size("_llm_left") + F.size("shingles") - shared
    good = saved(both.filter(shared >= line * union - SLACK).select("a", F.col("node").alias("b")), "verified")
    released(uses, sets)
    return good


def similar_groups(prints: DataFrame, bodies: DataFrame, bits: int, words: int, shingle: int, line: float) -> DataFrame:
    """``prints`` (saved; _llm_id, _llm_tie, node, size, fp0, ...) with _llm_root, which names the component of the pairs
    that differ in at most ``bits`` bits in one of their words and are similar by ``line`` or more. node stands for a shingle
    set, size is its size; ``bodies`` has node and _llm_text of every document that is the first of its set.

    The first walk gives a forest of candidates, which touches every node that has one. Only these are walked again, with
    sketches. A forest all of whose links reach the line has passed over no pair that they do not connect, so that is the
    end. When most links of a forest fail, every pair of sketches that may reach the line between nodes that are not
    connected is compared, so none is lost because a forest took another in its place.
    """
    fps = [f"fp{k}" for k in range(words)]
    classes = saved(prints.groupBy("node").agg(F.min(F.struct("size", *fps)).alias("f"), F.count("*").alias("_llm_copies"))
                    .select("node", "_llm_copies", "f.*"), "classes")
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("_llm_copies"), F.lit(0))).first()
    room = SHINGLE_BYTES * classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // 2
    links, near, every = None, None, False
    walked, n_walked, n_bytes, more = classes.withColumn("label", F.col("node")), count, 0, ["label", "size"]
    while True:
        dealt, masks = _dealt(walked, n_walked, bits, words, *more, n_bytes=n_bytes, room=room)
        rounds = _walked(dealt, _walk_candidates(bits, masks, every, line, links is not None))
        pairs = reduce(DataFrame.unionByName, rounds).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = saved(pairs.distinct(), "candidates")
        released(*rounds[:len(rounds) if len(rounds) > 1 else 0])
        n = pairs.count()
        if not n:
            break
        if near is None:  # every later pair is one of these nodes
            touched = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            near = saved(bodies.join(saved(touched, "ends"), "node", "left_semi").dropDuplicates(["node"]), "near")
        good = _verified(pairs, n, near, shingle, line)
        made = good.count()
        first = links is None
        links = good if first else links.unionByName(good)
        if every or made == n:
            break
        if first:
            sketches = near.mapInArrow(_sketched(shingle), "node long, sketch binary")
            walked, more = saved(walked.join(sketches, "node"), "touched"), ["label", "size", "sketch"]
            n_walked, n_bytes = walked.agg(F.count("*"), F.sum(F.length("sketch"))).first()
        walked = saved(walked.drop("label").join(components(links), "node", "left").withColumn(
            "label", F.coalesce("root", "node")).drop("root"), "labels")
        every = 2 * made < n and not first
    if near is not None:
        released(near)
    if links is None:
        labelled = classes.select("node", F.col("node").alias("_llm_root"), "_llm_copies")
    else:
        labelled = classes.join(components(links), "node", "left").select(
            "node", F.coalesce("root", "node").alias("_llm_root"), "_llm_copies")
    return join_facts(prints, saved(labelled, "labelled"), "node", "_llm_copies", total)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = 8,
                words: int = 3, line: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of the smallest id (nulls last), then of
    the smallest text hash. Groups are the components of the pairs whose shingle sets have a Jaccard similarity of ``line``
    or more, of those that the fingerprints find: several words of the same shingles raise their share without a wider
    budget. Rows equal in id and text are copies, so one of them stays."""
    keyed = docs.withColumn("_llm_tie", F.xxhash64(text))
    body = keyed.select(F.col(doc_id).alias("_llm_id"), "_llm_tie", F.col(text).cast("binary").alias("_llm_text"))
    kind = body.schema["_llm_id"].dataType.simpleString()
    schema = f"_llm_id {kind}, _llm_tie long, node long, size long, " + ", ".join(f"fp{k} long" for k in range(words))
    prints = saved(body.mapInArrow(_shingled(shingle, words), schema), "prints")
    first = F.min(F.struct(F.col("_llm_id").isNull().alias("none"), F.col("_llm_id").alias("id"), F.col("_llm_tie").alias("tie")))
    ends = saved(prints.groupBy("node").agg(first.alias("first")).select(
        F.col("first.id").alias("_llm_end"), F.col("first.tie").alias("_llm_end_tie"), F.col("node")), "ends")
    bodies = body.join(ends, F.col("_llm_id").eqNullSafe(F.col("_llm_end")) & (F.col("_llm_tie") == F.col("_llm_end_tie"))).select(
        "node", "_llm_text")
    chosen = saved(similar_groups(prints, bodies, bits, words, shingle, line).groupBy("_llm_root").agg(first.alias("first")).select(
        F.col("first.id").alias("_llm_first"), F.col("first.tie").alias("_llm_first_tie")), "chosen")
    # structs are equal where both fields are null, and a plain equality lets the texts be shuffled once for both steps
    keyed = keyed.withColumn("_llm_key", F.struct(F.col(doc_id).alias("id")))
    chosen = chosen.select(F.struct(F.col("_llm_first").alias("id")).alias("_llm_first"), "_llm_first_tie")
    stay = keyed.join(chosen, (F.col("_llm_key") == F.col("_llm_first")) & (F.col("_llm_tie") == F.col("_llm_first_tie")), "left_semi")
    return stay.dropDuplicates(["_llm_key", "_llm_tie"]).select(*docs.columns)
