"""Ranked lexical search: Block-Max MaxScore over a sharded inverted index.

The index is made of shards, each a bounded number of neighbouring documents, built where the documents are read. A shard
has one row per term: its postings in blocks of at most ``BLOCK`` documents, packed, and beside each block the pairs (tf, n)
that no other pair of the block beats in both, so that a block's highest score follows for any corpus statistics. Shards
need no shuffle; a query reads the rows of its terms only.

In a shard an item's lists are ordered by their highest score. Lists whose bounds add up to no more than the shard's tenth
score so far are not essential: they cannot bring a document in alone, so only the others name candidates. A candidate is
given up when its score and the maxima of the blocks it would fall into do not exceed the tenth score, before any such block
is unpacked. Each shard yields a heap of ``k`` documents an item; the heaps are merged by a window whose limit Spark applies
before the shuffle.

Results: a null or wordless text is no document; repeated rows are documents of their own (equal ids keep their ranks apart);
a null id sorts after all others; item rows with equal ids are one item with the terms of all; an item without terms or
without a matching document has no row; empty tables give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from tickframe.llm.common import batches, saved

#: Postings of one block; terms of the documents of one shard (one long document may exceed it); items searched together.
BLOCK, SHARD_TERMS, ITEMS = 128, 4_000_000, 256
#: Documents of the first window of a shard and of the later ones; the first ones set the line.
FIRST_WINDOW, WINDOW = 256, 2048
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_META = np.dtype([("last", "<i4"), ("body_end", "<i4"), ("pairs_end", "<i4"), ("gap_bytes", "u1"), ("tf_bytes", "u1")])


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.array_distinct(F.split(lowered, _SEPARATORS)), "")


# --- building ------------------------------------------------------------------------------------

def _segment_ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each segment and the end of the last, as Arrow's offsets, from segment sizes."""
    ends = np.cumsum(counts)
    return ends - counts, ends


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per row; ``ends`` are the bytes up to the end of each."""
    offsets = np.concatenate(([0], ends)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Little-endian numbers of their own width at byte positions."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = (values[some] >> (8 * k)) & 255


def _best_pairs(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the postings whose (tf, n) no posting of their block beats, in block order."""
    order = np.lexsort((n, -tf, block))
    falling = n[order] - block[order] * (int(n.max()) + 1)  # each block lies below all blocks before it
    least = np.minimum.accumulate(falling)
    return order[np.concatenate(([True], falling[1:] < least[:-1]))]


def pack_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray, n_terms: int) -> dict[str, pa.Array]:
    """Posting lists of terms 0..n_terms-1 from postings sorted by (term, doc); n is the length of the posting's document."""
    df = np.bincount(term, minlength=n_terms)
    starts, _ = _segment_ends(df)
    place = np.arange(len(term)) - starts[term]
    blocks_of = (df + BLOCK - 1) // BLOCK
    first_block, blocks_end = _segment_ends(blocks_of)
    block = first_block[term] + place // BLOCK
    head = np.flatnonzero(place % BLOCK == 0)
    size = np.bincount(block)
    gap = np.diff(doc, prepend=-1)
    gap[place == 0] = doc[place == 0] + 1
    gap_bytes = _width(np.maximum.reduceat(gap, head))
    tf_bytes = _width(np.maximum.reduceat(tf, head))
    body_start, body_end = _segment_ends(size * (gap_bytes + tf_bytes))
    body = np.zeros(int(body_end[-1]), np.uint8)
    inside = place % BLOCK
    _put(body, body_start[block] + inside * gap_bytes[block], gap, gap_bytes[block])
    _put(body, body_start[block] + size[block] * gap_bytes[block] + inside * tf_bytes[block], tf, tf_bytes[block])
    best = _best_pairs(block, tf, n)
    pairs = np.column_stack((tf[best], n[best])).astype("<i4")
    pairs_start, pairs_end = _segment_ends(np.bincount(block[best], minlength=len(size)))
    meta = np.zeros(len(size), _META)
    home = np.repeat(first_block, blocks_of)
    meta["last"] = doc[np.concatenate((head[1:], [len(doc)])) - 1]
    meta["body_end"], meta["pairs_end"] = body_end - body_start[home], pairs_end - pairs_start[home]
    meta["gap_bytes"], meta["tf_bytes"] = gap_bytes, tf_bytes
    return {
        "df": pa.array(df, pa.int64()),
        "blocks": _binary(meta.view(np.uint8), blocks_end * _META.itemsize),
        "pairs": _binary(pairs.view(np.uint8), pairs_end[blocks_end - 1] * 8),
        "body": _binary(body, body_end[blocks_end - 1]),
    }


class _Shard:
    """Documents of one shard while they are read."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.ids, self.sizes, self.numbers, self.n_terms = [], [], [], 0
        self.vocabulary = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__

    def add(self, key, words: list[bytes]) -> None:
        self.ids.append(key)
        self.sizes.append(len(words))
        self.numbers.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
        self.n_terms += len(words)

    def rows(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The head row (ids in ascending order and lengths), then one row per term."""
        ids = pa.array(self.ids, self.id_type)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.array(self.sizes, np.int64)
        lengths = sizes[order]
        words = sorted(self.vocabulary)
        sorted_place = np.empty(len(words), np.int64)
        sorted_place[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        key = sorted_place[np.concatenate(self.numbers)] * len(order) + np.repeat(rank, sizes)
        key, tf = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, len(order))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield _batch(schema, 1, shard=pa.array([name]), df=pa.array([self.n_terms]), ids=listed, lengths=pa.array([lengths.astype("<i8").tobytes()], pa.binary()))
        yield _batch(schema, len(words), shard=pa.array([name]).take(pa.array(np.zeros(len(words), np.int32))),
                     term=pa.array(words, pa.binary()).cast(pa.string()),
                     **pack_lists(term, doc, tf.astype(np.int64), lengths[doc], len(words)))


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The inverted index of every document, written to the shared folder: rows (shard, term, df, blocks, pairs, body),
    and one head row per shard with null term, the number of its terms, its ids in order and their lengths."""
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = f"shard string, term string, df long, blocks binary, pairs binary, body binary, ids array<{id_type}>, lengths binary"

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, shard, schema = TaskContext.get().partitionId(), 0, None, None
        for batch in batches(source):
            kind = batch.schema.field(0).type
            if schema is None:
                schema = pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("blocks", pa.binary()),
                                    ("pairs", pa.binary()), ("body", pa.binary()), ("ids", pa.list_(kind)), ("lengths", pa.binary())])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.translate(_TO_TERMS).split() if text is not None else None
                if not words:
                    continue
                shard = shard or _Shard(kind)
                shard.add(key, words)
                if shard.n_terms >= shard_terms:
                    yield from shard.rows(f"{part}-{made}", schema)
                    made, shard = made + 1, None
        if shard:
            yield from shard.rows(f"{part}-{made}", schema)

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return saved(read.mapInArrow(build, columns), "index")


# --- searching -----------------------------------------------------------------------------------

def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class PostingList:
    """One term's packed list in one shard, with the highest score of each block; blocks are unpacked when asked for."""

    def __init__(self, weight: int, blocks: bytes, pairs: bytes, body: bytes, norm, norms: np.ndarray):
        meta = np.frombuffer(blocks, _META)
        tf, n = np.frombuffer(pairs, "<i4").reshape(-1, 2).astype(np.int64).T
        best = weight * _share(tf, norm(n))
        self.weight, self.body, self.norms = weight, body, norms
        self.ends, self.meta = meta["last"], meta
        self.most = np.append(np.maximum.reduceat(best, np.append(0, meta["pairs_end"][:-1])), 0)
        self.bound = int(self.most.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of block k."""
        if k not in self.open:
            start, base = (int(self.meta["body_end"][k - 1]), int(self.ends[k - 1])) if k else (0, -1)
            gap, wide = int(self.meta["gap_bytes"][k]), int(self.meta["tf_bytes"][k])
            count = (int(self.meta["body_end"][k]) - start) // (gap + wide)
            doc = base + np.cumsum(np.frombuffer(self.body, f"<u{gap}", count, start), dtype=np.int64)
            tf = np.frombuffer(self.body, f"<u{wide}", count, start + count * gap).astype(np.int64)
            self.open[k] = doc, self.weight * _share(tf, self.norms[doc])
        return self.open[k]

    def add_range(self, at: int, stop: int, total: np.ndarray) -> None:
        """Add the scores of documents at..stop-1 to ``total``."""
        k = int(np.searchsorted(self.ends, at))
        while k < len(self.ends) and (k == 0 or self.ends[k - 1] + 1 < stop):
            doc, score = self.block(k)
            i, j = np.searchsorted(doc, (at, stop))
            total[doc[i:j] - at] += score[i:j]
            k += 1

    def scores_of(self, wanted: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Scores of ascending documents, 0 where the term is absent; ``home`` is the block each would be in."""
        found = np.zeros(len(wanted), np.int64)
        edges = np.append(np.flatnonzero(np.diff(home, prepend=-1)), len(home))
        for i, j in zip(edges[:-1], edges[1:]):
            if home[i] < len(self.ends):
                doc, score = self.block(int(home[i]))
                at = np.minimum(np.searchsorted(doc, wanted[i:j]), len(doc) - 1)
                found[i:j] = np.where(doc[at] == wanted[i:j], score[at], 0)
        return found


def best_of(lists: list[PostingList], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest sums above 0, equal sums by ascending document."""
    lists = sorted(lists, key=lambda one: one.bound)
    upto = np.cumsum([one.bound for one in lists])
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    line, at, width = 0, 0, FIRST_WINDOW
    while at < n_docs:
        stop = min(at + width, n_docs)
        essential = int(np.searchsorted(upto, line, side="right"))
        if essential == len(lists):
            break
        total = np.zeros(stop - at, np.int64)
        for one in lists[essential:]:
            one.add_range(at, stop, total)
        doc = np.flatnonzero(total)
        got = total[doc]
        doc += at
        # What each list can still add, by its block maxima; nothing is unpacked yet.
        homes = [np.searchsorted(one.ends, doc) for one in lists[:essential]]
        room = sum((one.most[home] for one, home in zip(lists, homes)), np.zeros(len(doc), np.int64))
        live = np.flatnonzero(got + room > line)
        for one, home in zip(lists[essential - 1::-1] if essential else [], homes[::-1]):
            if not len(live):
                break
            got[live] += one.scores_of(doc[live], home[live])
            room[live] -= one.most[home[live]]
            live = live[got[live] + room[live] > line]
        docs, scores = np.concatenate((docs, doc[live])), np.concatenate((scores, got[live]))
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        line = int(scores[-1]) if len(scores) == k else 0
        at, width = stop, WINDOW
    return docs, scores


def _search_shard(total_docs: int, total_terms: int, k: int, schema: pa.Schema):
    def norm(n):
        return 10 + (90 * n * total_docs) // total_terms

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["lengths"] is not None)
        norms = norm(np.frombuffer(head["lengths"], "<i8"))
        of_item = defaultdict(list)
        for row in rows:
            if row["term"] is not None:
                packed = PostingList(row["weight"], row["blocks"], row["pairs"], row["body"], norm, norms)
                for item in row["items"]:
                    of_item[item].append(packed)
        found = {name: [] for name in ("item_id", "doc_id", "score")}
        for item, lists in of_item.items():
            docs, scores = best_of(lists, len(norms), k)
            found["item_id"] += [item] * len(docs)
            found["doc_id"] += [head["ids"][d] for d in docs]
            found["score"] += scores.tolist()
        return pa.table({f.name: pa.array(found[f.name], f.type) for f in schema}, schema=schema)

    return search


def search(indexed: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item. ``indexed`` comes from :func:`index`.

    Items go in blocks of about ``ITEMS``; a task holds one shard's lists of the terms of one block.
    """
    heads = indexed.filter("term IS NULL")
    n_docs, n_terms = (v or 0 for v in heads.agg(F.sum(F.size("ids")), F.sum("df")).first())
    blocks = items.count() // ITEMS + 1
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(terms_of(F.col(text_col).cast("string"))).alias("term"))
    asked = asked.distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    known = indexed.filter("term IS NOT NULL")
    # Only the two narrow columns are read for the document counts.
    df = known.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    wanted = saved(asked.join(df.select("term", weight.alias("weight")).filter("weight > 0"), "term")
                   .groupBy("block", "term", "weight").agg(F.collect_list(F.struct("item_id")).alias("items"))
                   .withColumn("items", F.col("items.item_id")), "wanted-terms")
    lists = known.drop("df", "ids", "lengths").join(wanted, "term")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    group = lists.unionByName(heads.select("shard", each.alias("block"), "ids", "lengths"), allowMissingColumns=True)
    id_type, item_type = indexed.schema["ids"].dataType.elementType, items.schema[item_col].dataType
    shape = f"item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score long"
    arrow = to_arrow_schema(StructType().add("item_id", item_type).add("doc_id", id_type).add("score", LongType()))
    heaps = group.groupBy("shard", "block").applyInArrow(_search_shard(n_docs, max(n_terms, 1), k, arrow), shape)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
