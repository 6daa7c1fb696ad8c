"""Document fingerprints as Merkle trees: leaves are sentences, which make up paragraphs (lines), which make up sections
of at most SECTION paragraphs; the root is the hash of the sections.

A node's digest covers its children's digests and kinds in order, a leaf's its exact text with the white space after it,
so texts have equal roots if and only if they are equal (up to a collision of SHA-256). Where roots differ, following
the differing branches locates the edits.

The fingerprint as text is the root and, after a colon, 8 hex digits of every leaf in order, so that likeness can be read
off two fingerprints: twice the leaves in common, by count, over all leaves. Two empty texts are alike (1).

Null text is the empty text. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import batches

SECTION = 8
LEAF_DIGITS = 8
#: Longest leaf in characters; longer sentences are cut.
LONGEST_LEAF = 400
_SENTENCE = re.compile(r"(?<=[.!?])[^\S\n]+")


def paragraphs(text: str) -> list[list[str]]:
    """The leaves of every paragraph; joined they give the text back."""
    lines = text.split("\n")
    lines = [line + "\n" for line in lines[:-1]] + [lines[-1]] * bool(lines[-1])
    out = []
    for line in lines:
        leaves, at = [], 0
        for end in [m.end() for m in _SENTENCE.finditer(line)] + [len(line)]:
            while at < end:
                leaves.append(line[at:min(end, at + LONGEST_LEAF)])
                at += len(leaves[-1])
        out.append(leaves)
    return out


def _node(kind: bytes, children: list[bytes]) -> bytes:
    return sha256(kind + b"".join(children)).digest()


class Tree:
    """All digests of a text: leaves by paragraph, paragraphs, sections, root."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.leaves = paragraphs(self.text)
        self.leaf_digests = [[sha256(b"l" + leaf.encode()).digest() for leaf in p] for p in self.leaves]
        self.paragraph_digests = [_node(b"p", d) for d in self.leaf_digests]
        self.section_digests = [_node(b"s", self.paragraph_digests[i:i + SECTION])
                                for i in range(0, len(self.paragraph_digests), SECTION)]
        self.root = _node(b"r", self.section_digests)

    def fingerprint(self) -> str:
        return self.root.hex() + ":" + "".join(d.hex()[:LEAF_DIGITS] for p in self.leaf_digests for d in p)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 1 if and only if the roots are equal or all leaves are in common."""
    if a == b:
        return 1.0
    left, right = (Counter(x[65:][i:i + LEAF_DIGITS] for i in range(0, len(x) - 65, LEAF_DIGITS)) for x in (a, b))
    total = left.total() + right.total()
    return 2 * (left & right).total() / total if total else 1.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Spans (start, end) in code points of a's leaves that b has not at the same place, found by descending only where
    digests differ."""
    out: list[tuple[int, int]] = []
    if a.root == b.root:
        return out
    at = 0
    for i, leaves in enumerate(a.leaves):
        size = sum(map(len, leaves))
        s = i // SECTION
        same = (s < len(b.section_digests) and a.section_digests[s] == b.section_digests[s]) or (
            i < len(b.paragraph_digests) and a.paragraph_digests[i] == b.paragraph_digests[i])
        if not same:
            other = b.leaf_digests[i] if i < len(b.leaf_digests) else []
            place = at
            for j, leaf in enumerate(leaves):
                if j >= len(other) or other[j] != a.leaf_digests[i][j]:
                    out.append((place, place + len(leaf)))
                place += len(leaf)
        at += size
    return out


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


#: Ranges of ids at most, and the rows that a range should hold.
MOST_RANGES = 4096
RANGE_ROWS = 2000


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the id; -1 for null. Bounds are looked up in two steps."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def below(places: Column) -> Column:
        return F.size(F.filter(places, lambda b: b <= doc_id))

    coarse = below(F.array(*[F.lit(g[0]).cast("long") for g in groups]))
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    at = F.transform(F.array(coarse), lambda c: F.when(c == 0, 0).otherwise(
        (c - 1) * step + below(F.get(fine, c - 1))))[0]
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(at)


def dealt(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(range, halo, id, tie, text): the documents by ranges of ids, and in each range, marked as halo, the document that
    follows its last one in descending order of id; the first of all follows the last of all. Also the number of ranges.

    Ids alone are read for the quantiles that part the ranges and for the first document of each, a bounded number of
    rows on the driver. Each text is shuffled once. Equal ids are in order of their text's hash, null ids come last.
    """
    total = docs.count()
    n = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    marks = docs.approxQuantile(doc_id, [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(m) for m in marks})
    keyed = docs.select(_range_of(F.col(doc_id), bounds).alias("range"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    heads = keyed.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head")).collect()  # a row a range
    heads = sorted(((r["range"], r["head"]["id"], r["head"]["tie"]) for r in heads), reverse=True, key=lambda h: h[0])
    if not heads:
        return keyed.withColumn("halo", F.lit(False)), 1
    above = {heads[i][0]: (heads[i - 1][0], heads[i][1], heads[i][2]) for i in range(len(heads))}
    slots = [above.get(r, (None, None, None)) for r in range(-1, len(bounds) + 1)]
    look = lambda i, kind: F.get(F.array(*[F.lit(s[i]).cast(kind) for s in slots]), F.col("range") + 1)
    first = F.col("id").eqNullSafe(look(1, "long")) & (F.col("tie") == look(2, "long"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("halo"))
    sent = F.struct(look(0, "int").alias("range"), F.lit(True).alias("halo"))
    copies = keyed.withColumn("to", F.explode(F.when(first, F.array(own, sent)).otherwise(F.array(own))))
    return copies.select(F.col("to.range").alias("range"), F.col("to.halo").alias("halo"), "id", "tie", "text"), len(slots)


def _pairs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, halo last, to results; one document and its tree are remembered."""
    before: tuple | None = None
    for batch in batches(source):
        rows: list[tuple] = []
        for r, halo, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "halo", "id", "text"))):
            if before is not None and before[0] != r:
                before = None
            if halo and before is None:
                continue  # a second copy of the halo
            print_ = Tree(text).fingerprint()
            if before is not None:
                _, one, old, old_print = before
                changed = edited(old, text)
                new_print = Tree(changed).fingerprint()
                rows.append((one, len(old), sha256(changed.encode()).hexdigest(), old_print, new_print,
                             likeness(old_print, new_print), likeness(old_print, print_)))
            before = None if halo else (r, doc, text, print_)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], names=names)


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    rows, n = dealt(docs, doc_id, text)
    ordered = rows.repartition(n, "range").sortWithinPartitions(
        "range", "halo", F.col("id").desc_nulls_last(), F.col("tie").desc())
    return ordered.mapInArrow(_pairs, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double")
