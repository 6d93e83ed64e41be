"""Periodic run detection by block convolution.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(6, 4 q) that no neighbouring word extends. In such a run at least 3 q places i have
word(i) = word(i + q), so for the scale B (a power of two) with B <= q < 2 B an aligned block of B
words lies wholly inside them. At every scale each block is therefore matched against the window
that follows it, at all distances B to 2 B - 1 together: the sum of squared differences is
sum x^2 - 2 sum x y + sum y^2, its middle term is a cyclic convolution of length 2 B, computed by a
number-theoretic transform in whole numbers, and its zeros are the occurrences. The transform of a
window is that of the next block plus the one after it with signs changed, so a block is
transformed once. Word numbers are folded so far that no sum reaches the modulus: zeros are exact
for folded words, and true occurrences are never missed.

The distance of an occurrence seeds an extension: how far the words at that distance go on being
equal is found by bisection over prefix hashes, which never stops too early, and the stretch is
then compared word by word. Occurrences inside a run already found at a smaller scale are left
out: by the theorem of Fine and Wilf their distances are multiples of its period. A stretch found
with several periods keeps the least.

Work grows with n log^2 n for a text of n words, whatever it repeats. Texts are independent and never
shuffled; those of an Arrow batch are joined, longest first and with unique words between, into
slices of ``SLICE`` words, so short texts share the calls and a scale runs only over texts long
enough for it. A worker holds one slice, or one text if that is longer, up to 2^27 words.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated
rows are treated each; all columns pass through under their own names, and the new names clash
with none of them; an empty table gives an empty result; rows without a key are treated as others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, let, parts, table, words

#: A prime 7 * 2^26 + 1 and its least primitive root: transforms up to 2^26 numbers.
MODULUS, ROOT = 469762049, 3
#: Least length of a run, in words and in periods.
LEAST, TIMES = 6, 4
#: Words treated together, and numbers in one set of transforms.
SLICE, TILE = 1 << 18, 1 << 15
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... (n of them) in the field."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), MODULUS) % MODULUS])
    return out[:n]


@lru_cache(maxsize=32)
def twiddles(half: int, inverse: bool) -> np.ndarray:
    root = pow(ROOT, (MODULUS - 1) // (2 * half), MODULUS)
    return powers(pow(root, MODULUS - 2, MODULUS) if inverse else root, half)[:, None]


@lru_cache(maxsize=32)
def negated(size: int) -> np.ndarray:
    """For each place of the transform's (bit-reversed) order, the place of the negated frequency."""
    place = np.zeros(1, np.int64)
    while len(place) < size:
        place = np.concatenate([2 * place, 2 * place + 1])
    return place[-place % size]


def transform(x: np.ndarray) -> np.ndarray:
    """Transform of every column, in place; frequencies come out in bit-reversed order."""
    size, n = x.shape
    half = size // 2
    while half:
        v = x.reshape(-1, 2, half, n)
        low, high = v[:, 0], v[:, 1]
        turned = (low - high) * twiddles(half, False) % MODULUS
        low += high
        low %= MODULUS
        v[:, 1] = turned
        half //= 2
    return x


def restore(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`transform`, from its order."""
    size, n = x.shape
    half = 1
    while half < size:
        v = x.reshape(-1, 2, half, n)
        turned = v[:, 1] * twiddles(half, True) % MODULUS
        v[:, 1] = (v[:, 0] - turned) % MODULUS
        v[:, 0] += turned
        v[:, 0] %= MODULUS
        half *= 2
    return x * pow(size, MODULUS - 2, MODULUS) % MODULUS


def occurrences(w: np.ndarray, block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) where an aligned block recurs at a distance of ``block`` to 2 ``block`` - 1.

    Needs two blocks of words beyond the last; words are compared folded to fewer numbers.
    """
    fold = max(2, int((MODULUS / block) ** 0.5))
    x = (w[:(blocks + 2) * block] * 2654435761 & 0xFFFFFFFF) % fold
    squares = np.concatenate([[0], np.cumsum(x * x)])
    step = max(8, TILE // (2 * block))
    places, distances = [], []
    for first in range(0, blocks, step):
        n = min(step, blocks - first)
        part = np.zeros((2 * block, n + 2), np.int64)
        part[:block] = x[first * block:(first + n + 2) * block].reshape(n + 2, block).T
        f = transform(part)
        window = f[:, 1:-1].copy()
        window[:block] += f[:block, 2:]
        window[block:] += MODULUS - f[block:, 2:]
        window %= MODULUS
        products = restore(window * f[negated(2 * block), :-2] % MODULUS)[:block]
        at = (first + np.arange(n)) * block
        shifted = at + block + np.arange(block)[:, None]
        differ = squares[at + block] - squares[at] - 2 * products + squares[shifted + block] - squares[shifted]
        s, j = np.nonzero(differ == 0)
        places.append(at[j])
        distances.append(block + s)
    return np.concatenate(places), np.concatenate(distances)


class Prefixes:
    """Hashes of all prefixes of a sequence, for the length of equal stretches at a distance."""

    def __init__(self, w: np.ndarray):
        self.n = len(w)
        self.powers = powers(40692, self.n + 1)
        self.sums = np.concatenate([[0], np.cumsum((w * 48271 + 11) % MODULUS * self.powers[:-1] % MODULUS)])

    def equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        here = (self.sums[i + length] - self.sums[i]) % MODULUS
        there = (self.sums[i + q + length] - self.sums[i + q]) % MODULUS
        return here * self.powers[q] % MODULUS == there

    def reach(self, i: np.ndarray, q: np.ndarray, right: bool) -> np.ndarray:
        """How many words from i on (or before i) equal those q later: never too few."""
        room = self.n - q - i if right else i
        length = np.zeros_like(i)
        for bit in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
            more = length + (1 << bit)
            ok = more <= room
            a, m, d = i[ok], more[ok], q[ok]
            ok[ok] = self.equal(a if right else a - m, d, m)
            length = np.where(ok, more, length)
        return length


def stretches(w: np.ndarray, start: int, length: int, q: int) -> Iterator[tuple[int, int, int]]:
    """The runs of distance q inside a candidate, compared word by word."""
    least = max(LEAST, TIMES * q)
    same = w[start:start + length - q] == w[start + q:start + length]
    if same.all():
        if length >= least:
            yield start, length, q
        return
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a + q >= least:
            yield start + a, b - a + q, q


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of texts laid end to end: rows (text, start, length, period) by text, start, period.

    ``codes`` numbers equal words equally, from 0; ``sizes`` are the texts' numbers of words.
    """
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    if not len(order):
        return np.zeros((0, 4), np.int64)
    begins = np.cumsum(sizes) - sizes
    n = sizes[order]
    starts = np.cumsum(n + 1) - n - 1
    # unique words between texts, and after the last for the windows of the largest scale
    w = -1 - np.arange(int(starts[-1] + n[-1] + n[0] + 4), dtype=np.int64)
    for t, at in zip(order, starts, strict=True):
        w[at:at + sizes[t]] = codes[begins[t]:begins[t] + sizes[t]]
    prefixes, found, block = Prefixes(w), {}, 1
    while (long := n >= max(LEAST, TIMES * block)).any():
        end = int((starts + n)[long][-1])
        place, q = occurrences(w, block, -(-end // block))
        if found and len(place):
            done = np.array(sorted((s, s + length) for s, length in found), np.int64)
            k = np.searchsorted(done[:, 0], place, "right") - 1
            last = np.maximum.accumulate(done[:, 1])
            fresh_ = (k < 0) | (last[k] < place + q + block)
            place, q = place[fresh_], q[fresh_]
        left = prefixes.reach(place, q, False)
        length = left + prefixes.reach(place, q, True) + q
        ok = length >= np.maximum(LEAST, TIMES * q)
        for s, size, d in np.unique(np.stack([place - left, length, q], 1)[ok], axis=0).tolist():
            for a, b, p in stretches(w, s, size, d):
                found[a, b] = min(p, found.get((a, b), p))
        block *= 2
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.array([(s, length, p) for (s, length), p in found.items()], np.int64)
    k = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = np.column_stack([order[k], rows[:, 0] - starts[k], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def treat(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of every list of words."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = runs_of(codes, sizes)
    begins = np.cumsum(sizes) - sizes
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, begins[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(step, begins[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    keep = np.cumsum(step)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    offsets = pa.array(kept[np.concatenate([begins, [len(codes)]])], pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(pa.array(keep))), " ")
    ends = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1))
    runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(ARROW_RUN))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), text


def periodic_runs(docs: DataFrame, text: str | Column = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` plus its runs and its text without repeated periods.

    ``text`` is a column of texts, or an expression that gives their words as an array. Runs are
    structs (start, length, period) in words, by start, then period. A word is left out of the
    collapsed text if a run holds it after the run's first period. The second value maps ``runs``
    and ``collapsed`` to the names used, which clash with no column of ``docs``.
    """
    names = dict(zip(("runs", "collapsed"), fresh(docs, "runs", "collapsed"), strict=True))
    (given,) = fresh(docs, "words_")
    listed = docs.withColumn(given, words(col(text)) if isinstance(text, str) else text)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["runs"], RUN), T.StructField(names["collapsed"], T.StringType())])

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in parts(sizes, SLICE):
                rest = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], *treat(rest.column(rest.num_columns - 1))], names=schema.names)

    return listed.mapInArrow(handle, schema), names


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; ties: least start, then period."""
    none = F.lit(None).cast(RUN.elementType)
    return F.aggregate(runs, none, lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def planted(text: Column, key: Column) -> Column:
    """The words of a text; for one key in ten by checksum, a tail of them is made periodic."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.concat(
            F.slice(w, F.lit(1), s["a"].cast("int")),
            F.transform(F.sequence(F.lit(0).cast("long"), n - s["a"] - 1),
                        lambda i: F.get(w, (s["a"] + i % s["p"]).cast("int")))))

    return let(words(text), lambda w: F.when((h % 10 == 0) & (F.size(w) > 0), repeat(w)).otherwise(w))


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found, names = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("listed")), F.col("listed"))
    runs = col(names["runs"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = found.select("doc_id", runs.alias("runs"), col(names["collapsed"]).alias("collapsed"), strongest(runs).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
