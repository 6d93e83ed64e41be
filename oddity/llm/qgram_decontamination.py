"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k q of its q-grams with that place, and the hits lie on at most k + 1 neighbouring
diagonals (place in text minus place in item). So hits are counted in bands of 2 (k + 1)
diagonals, each overlapping the next by half; a band that reaches the bound is kept, and a banded
alignment inside it decides and gives the span and the edits.

The benchmark is the query set. It is read in blocks of ``BLOCK_CHARS`` characters, each
broadcast, and every whole document is scanned against every block: no shuffle of texts. The scan
is vectorised over a text, in segments of ``SEGMENT`` characters that overlap by more than an
item's reach, so memory does not grow with the length of a text. Shared q-grams are counted in
slices of ``ENTRIES``, and bands that the text has left behind are settled after each, so repetitive
texts and items take time but no more memory.

Both sides are compared in lower case with blanks squeezed; spans are given in the original text.

Defined results: null and empty texts and items match nothing; a text of any length is scanned
whole; items shorter than ``q`` characters have no q-gram and match nothing; equal items match
separately; repeated documents are scanned separately; overlapping matches of one item count once,
with the fewest edits; other columns are not read by :func:`find_leaks`, whose result names the
document's key first, and pass through :func:`drop_leaks`; empty tables give no match.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, parts, table

Q, EDIT_SHARE = 8, 0.1
BLOCK_CHARS, SEGMENT, SLICE, ENTRIES = 2_000_000, 32_768, 256, 1 << 19
_BITS = 22
_NOTHING = np.uint64(1 << 40)
_NEVER = 1 << 60
_WORD = re.compile(r"\S+")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def original_places(text: str) -> np.ndarray:
    """Where each character of ``normal(text)`` stands in ``text``."""
    out: list[int] = []
    for m in _WORD.finditer(lowered(text)):
        if out:
            out.append(m.start() - 1)
        out.extend(range(m.start(), m.end()))
    return np.array(out, np.int64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit key for each q-gram."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    # keys of runs of 1, 2, 4, ... characters, put together along the binary digits of q
    base, run, length, h, have = np.uint64(0x9E3779B97F4A7C15), c, 1, None, 0
    n = len(c) - q + 1
    while length <= q:
        if q & length:
            piece = run[have:have + n]
            h = piece.copy() if h is None else h * power(base, length) + piece
            have += length
        run = run[:-length] * power(base, length) + run[length:]
        length *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def banded(a: np.ndarray, b: np.ndarray, width: int, most: int, start: int | None = None) -> tuple[int, int]:
    """Fewest edits between all of ``a`` and a part of ``b``, on diagonals 0 to width - 1, and the part's end.

    The part starts at ``start``, or anywhere in the band. Beyond ``most`` edits it gives up.
    """
    ramp, far = np.arange(width), np.int64(1 << 40)
    row = np.zeros(width, np.int64) if start is None else np.where(ramp < start, far, ramp - start)
    for i in range(len(a)):
        below = np.empty(width, np.int64)
        below[:-1] = row[1:] + 1
        below[-1] = far
        new = np.minimum(row + (b[i:i + width] != a[i]), below)
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), len(a) + best


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, share: float = EDIT_SHARE):
        self.q = q
        self.ids, self.codes = [], []
        for key, text in items:
            c = codes(normal(text))
            if len(c) >= q:
                self.ids.append(key)
                self.codes.append(c)
        m = self.sizes = np.array([len(c) for c in self.codes], np.int64)
        # an edit budget whose bound is one shared q-gram at least
        self.edits = np.minimum((m * share).astype(np.int64), np.maximum(0, (m - q) // q))
        self.bound = m - q + 1 - self.edits * q
        self.reach = int(max([0, *(m + 4 * self.edits + 4)]))
        keys = [grams(c, q) for c in self.codes]
        every = np.concatenate([*keys, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        at = np.concatenate([*(np.arange(len(k)) for k in keys), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.first, self.n = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _BITS)] = True

    def bands(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) of the bands that reach the bound, those with most hits first."""
        g = grams(c, self.q)
        place = np.flatnonzero(self.bits[g >> np.uint64(64 - _BITS)])
        k = np.minimum(np.searchsorted(self.keys, g[place]), len(self.keys) - 1)
        same = self.keys[k] == g[place]
        place, k = place[same], k[same]
        if not len(place):
            return []
        open_, hits, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for first, last in parts(self.n[k], ENTRIES):
            both = self.hits(place[first:last], k[first:last])
            if len(open_):
                open_, where = np.unique(np.concatenate([open_, both]), return_inverse=True)
                hits = np.bincount(where, np.concatenate([hits, np.ones(len(both), np.int64)]), len(open_)).astype(np.int64)
            else:
                open_, hits = np.unique(both, return_counts=True)
            # no later place hits a band that lies an item's length and two widths behind
            item = open_ >> 32
            behind = ((open_ & 0xFFFFFFFF) - (1 << 30) + 2) * (self.edits[item] + 1) + self.sizes[item] < (
                place[last] if last < len(place) else _NEVER)
            enough = behind & (hits >= self.bound[item])
            kept.append((open_[enough], hits[enough]))
            open_, hits = open_[~behind], hits[~behind]
        found, hits = (np.concatenate(x) for x in zip(*kept, strict=True))
        found = found[np.lexsort((found, -hits))]
        return [(int(f >> 32), int(f & 0xFFFFFFFF) - (1 << 30)) for f in found]

    def hits(self, place: np.ndarray, k: np.ndarray) -> np.ndarray:
        """(item, band) of every shared q-gram, twice: bands overlap by half."""
        n = self.n[k]
        entry = np.arange(n.sum()) + np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        item = self.item[entry]
        band = np.floor_divide(np.repeat(place, n) - self.at[entry], self.edits[item] + 1) + (1 << 30)
        return np.concatenate([item << 32 | band, item << 32 | band - 1])

    def align(self, c: np.ndarray, item: int, band: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place of an item in the band; None beyond its budget."""
        a, k = self.codes[item], int(self.edits[item])
        start, width = band * (k + 1) - k, 4 * k + 2
        b = np.full(len(a) + width, _NOTHING)
        lo, hi = max(0, start), min(len(c), start + len(b))
        b[lo - start:hi - start] = c[lo:hi]
        edits, end = banded(a, b, width, k)
        if edits > k:
            return None
        if not edits:
            return 0, start + end - len(a), start + end
        # the same alignment from its end: diagonals -k to k, so k places are put before it
        back = np.concatenate([np.full(k, _NOTHING), b[:end][::-1], np.full(k + len(a), _NOTHING)])
        _, reached = banded(a[::-1], back, 2 * k + 1, k, k)
        return edits, max(0, start + end - (reached - k)), min(len(c), start + end)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in a text, with spans in the text as given."""
        t = normal(text)
        best: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(0, max(1, len(t) - self.reach), SEGMENT) if len(t) >= self.q and self.ids else ():
            c = codes(t[s:s + SEGMENT + self.reach])
            done: set[tuple[int, int]] = set()
            for item, band in self.bands(c):
                if (item, band - 1) in done or (item, band + 1) in done:
                    continue  # half of this band is in one that has the item
                if found := self.align(c, item, band):
                    done.add((item, band))
                    best.setdefault(item, []).append((found[0], found[1] + s, found[2] + s))
        if not best:
            return []
        places, out = original_places(text), []
        for item, spans in sorted(best.items()):
            kept: list[tuple[int, int, int]] = []
            for edits, start, end in sorted(spans):
                if all(end <= x or start >= y for _, x, y in kept):
                    kept.append((edits, start, end))
            out += [(item, int(places[start]), int(places[end - 1]) + 1, edits) for edits, start, end in sorted(kept, key=lambda x: x[1])]
        return out


_INDEXES: dict[str, Index] = {}


def index_of(token: str, block: Broadcast) -> Index:
    """The index of a broadcast block, built once a worker; ``token`` names the block."""
    if token not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[token] = Index(block.value)
    return _INDEXES[token]


def blocks_of(items: DataFrame, key: str, text: str, chars: int = BLOCK_CHARS) -> Iterator[tuple[str, Broadcast]]:
    """The query set in named broadcast blocks of bounded size."""
    spark, block, size = items.sparkSession, [], 0
    for row in items.select(col(key).alias("k"), col(text).cast("string").alias("t")).where(F.length("t") >= Q).toLocalIterator():
        if block and size + len(row["t"]) > chars:
            yield uuid.uuid4().hex, spark.sparkContext.broadcast(block)
            block, size = [], 0
        block.append((row["k"], row["t"]))
        size += len(row["t"])
    if block:
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """One row for each place of an item in a document: doc key, item key, start, end, edits."""
    d = docs.select(col(key).alias("doc"), col(text).cast("string").alias("text"))
    doc_type, item_type = d.schema["doc"].dataType, items.schema[item_key].dataType
    schema = f"doc {doc_type.simpleString()}, item {item_type.simpleString()}, start long, end long, edits int"

    def scan(token: str, block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(token, block)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    found = [(r, *m) for r, t in enumerate(part.column(1).to_pylist()) if t for m in index.matches(t)]
                    if found:
                        r, item, start, end, edits = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(r)), pa.array([index.ids[i] for i in item]), pa.array(start, pa.int64()),
                             pa.array(end, pa.int64()), pa.array(edits, pa.int32())], names=["doc", "item", "start", "end", "edits"])
        return run

    parts = [d.mapInArrow(scan(*block), schema) for block in blocks_of(items, item_key, item_text)]
    none = d.sparkSession.createDataFrame([], schema)
    out = reduce(DataFrame.unionByName, parts) if parts else none
    # if both keys have one name, or one that a result column has, the names are made to differ
    names = fresh(d.sparkSession.createDataFrame([], "start long, end long, edits int"), key, item_key)
    return out.select(F.col("doc").alias(names[0]), F.col("item").alias(names[1]), "start", "end", "edits")


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item occurs, with their own columns; nothing is shuffled."""
    at, schema = docs.columns.index(text), docs.schema

    def clean(token: str, block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(token, block)
            for batch in batches:
                for s in range(0, batch.num_rows, SLICE):
                    part = batch.slice(s, SLICE)
                    yield part.filter(pa.array([not (t and index.matches(t)) for t in part.column(at).to_pylist()], pa.bool_()))
        return run

    return reduce(lambda d, block: d.mapInArrow(clean(*block), schema), blocks_of(items, item_key, item_text), docs)


def op5_qgram_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_qgram_decontamination": op5_qgram_decontamination}
