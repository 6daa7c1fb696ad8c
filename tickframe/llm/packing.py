"""Packing documents into sequences of bounded length by order-preserving dynamic programming.

A partition's documents, in their order, are one stream of tokens. Windows may end after a document (free), after a
sentence (a small penalty for the document cut) or, where neither comes for long and at the end of the stream,
anywhere (a larger one). With positions p and g(i) = cost(i) + p(i), the best way to end at candidate j is

    cost(j) = penalty(j) + limit - p(j) + min of g(i) over candidates i with p(j) - p(i) <= limit

whose sliding minimum a monotone queue keeps, so the work is linear in the candidates. A window whose length is a power
of two needs no padding; those transitions are looked up beside the queue.

The stream is worked off in buffers; the last windows of a buffer stay open and are decided with the next one. Nothing
is shuffled: sequences never cross partitions, and their ids carry the partition's number.

Null text is empty. Every document, empty ones too, has its end token, so each gives at least one piece. Repeated rows
are packed as often as they come. An empty table gives no pieces. Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import batches
from tickframe.llm.tokens import vocabulary_path, word_ids

LIMIT = 4096
END_ID = 2
SENTENCE_PENALTY = 2
CUT_PENALTY = 24
#: A stretch without a candidate longer than this gets places to cut anywhere.
LONGEST_GAP = 256
LEAST_GAP = 6
#: Tokens worked off at once.
BUFFER = 96 * LIMIT
#: Shortest and longest exponent of windows that need no padding, inside the stream and at its end.
POWERS = range(8, 12)
LAST_POWERS = range(0, 12)


def candidates(tokens: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, last: bool, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, 0 first, and their penalties. Positions count tokens before the cut."""
    n = len(tokens)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[1:][ends_sentence[tokens]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    # of sentences that end in one cell of LEAST_GAP tokens, the first will do, also in a list of very short ones
    at = at[(penalty[at] == 0) | (np.diff(at // LEAST_GAP, prepend=-1) > 0)]
    penalty[:] = np.where(np.isin(np.arange(n + 1), at, kind="table"), penalty, -1)
    if at[-1] != n:
        at = np.append(at, n)
    gap = min(LONGEST_GAP, max(1, limit // 16))
    for start in np.flatnonzero(np.diff(at) > gap):
        inner = np.arange(at[start] + gap, at[start + 1], gap)
        penalty[inner] = CUT_PENALTY
    if last:
        # where the last windows could have lengths that need no padding
        tail = n - np.array([m for m in range(1, limit) if m.bit_count() <= 3])
        tail = tail[tail > 0]
        penalty[tail] = np.where(penalty[tail] < 0, CUT_PENALTY, penalty[tail])
    if penalty[n] < 0:
        penalty[n] = CUT_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, limit: int, powers: range) -> list[int]:
    """The positions where the windows end at least cost, the last candidate included."""
    n = len(at)
    free: list[list[int] | None] = [None] * n
    for k in (k for k in powers if 1 << k <= limit):
        found = np.searchsorted(at, at - (1 << k))
        hits = np.flatnonzero((at[np.minimum(found, n - 1)] == at - (1 << k)) & (at >= (1 << k)))
        for j, i in zip(hits.tolist(), found[hits].tolist()):
            if free[j] is None:
                free[j] = [i]
            else:
                free[j].append(i)
    place = at.tolist()
    cost, back = [0] * n, [0] * n
    lows, whose, head = [0], [0], 0  # the queue: g ascending, and the candidate of each; what lies before head has left it
    for j, p, extra, others in zip(range(1, n), place[1:], penalty[1:].tolist(), free[1:]):
        while place[whose[head]] < p - limit:
            head += 1
        best, i = lows[head] + limit - p, whose[head]
        if others is not None:
            for other in others:
                if cost[other] < best:
                    best, i = cost[other], other
        best += extra
        cost[j], back[j] = best, i
        best += p
        while len(lows) > head and lows[-1] >= best:
            lows.pop()
            whose.pop()
        lows.append(best)
        whose.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(place[j])
        j = back[j]
    return cuts[::-1]


class _Stream:
    """The tokens not yet packed of one partition."""

    def __init__(self, ends_sentence: np.ndarray, limit: int, with_ids: bool, names: list[str], schema: pa.Schema):
        self.ends_sentence, self.limit, self.with_ids, self.names, self.schema = ends_sentence, limit, with_ids, names, schema
        self.parts: list[bytes] = []
        self.docs: list[tuple] = []  # what is kept of a row, tokens in all, tokens already packed
        self.size = 0
        self.sequence = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0

    def add(self, kept: tuple, ids: bytes) -> None:
        self.parts.append(ids)
        self.docs.append((kept, len(ids) // 4, 0))
        self.size += len(ids) // 4

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        raw = b"".join(self.parts)
        tokens = np.frombuffer(raw, "<u4")
        left = np.array([n - done for _, n, done in self.docs])
        doc_ends = np.cumsum(left)
        at, penalty = candidates(tokens, doc_ends, self.ends_sentence, last, self.limit)
        cuts = best_cuts(at, penalty, self.limit, LAST_POWERS if last else POWERS)
        if not last:
            cuts = cuts[:max(0, len(cuts) - 4)]
        if not cuts:
            self.parts = [raw]
            return
        cuts = np.array(cuts)
        doc_starts = doc_ends - left
        places = np.unique(np.concatenate((doc_starts[doc_starts < cuts[-1]], [0], cuts)))
        starts, ends = places[:-1], places[1:]
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        opened = np.concatenate(([0], cuts))[window]
        view = memoryview(raw)
        done = np.array([d[2] for d in self.docs])
        out = [pa.array([self.docs[i][0][c] for i in doc], self.schema.field(c).type) for c in range(len(self.names))]
        out += [
            pa.array(starts - doc_starts[doc] + done[doc], pa.int64()), pa.array(ends - starts, pa.int64()),
            pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
            pa.array([self.docs[i][1] for i in doc], pa.int64()), pa.array(self.sequence + window, pa.int64()),
            pa.array(starts - opened, pa.int64()),
        ]
        names = self.names + ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            offsets = np.concatenate((starts, ends[-1:])).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[:ends[-1]].astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names=names)
        self.sequence += len(cuts)
        end = int(cuts[-1])
        first = int(np.searchsorted(doc_ends, end, side="right"))
        rest = self.docs[first:]
        if rest and doc_starts[first] < end:
            kept, n, packed = rest[0]
            rest[0] = (kept, n, packed + end - int(doc_starts[first]))
        self.docs, self.parts, self.size = rest, [raw[4 * end:]], self.size - end


def pack(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None, limit: int = LIMIT,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns ``keep`` of its document, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, its ids."""
    path = vocabulary or vocabulary_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stream = word_ids(path), None
        for batch in batches(source):
            if stream is None:
                stream = _Stream(words.ends_sentence, limit, with_ids, keep, batch.schema)
            kept = zip(*[batch.column(i).to_pylist() for i in range(len(keep))]) if keep else iter([()] * batch.num_rows)
            for row, ids in zip(kept, words.encode(batch.column(len(keep)).to_pylist())):
                stream.add(row, ids + end)
                if stream.size >= BUFFER:
                    yield from stream.pack(False)
        if stream is not None:
            yield from stream.pack(True)

    narrow = docs.select(*keep, F.col(text).cast("binary").alias("_llm_text"))
    schema = ", ".join([f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep] + [
        "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"]
        + ["ids array<int>"] * with_ids)
    return narrow.mapInArrow(run, schema)
