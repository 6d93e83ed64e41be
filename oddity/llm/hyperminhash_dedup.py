"""Near-duplicate detection by HyperMinHash.

Each document becomes the set of its word shingles (64-bit hashes). The set is split over
``REGISTERS`` buckets, and each bucket stores its least hash in 16 bits: the number of leading
zeros and ten bits of mantissa. Documents with equal sets form one class and are linked without
any pair being made. Classes meet if a band of registers is equal; the number of registers in a
band is the largest that misses a pair at the threshold with a probability of at most ``MISS``.
The Jaccard similarity estimated from the registers, corrected for chance collisions, drops pairs
that are five standard errors below the threshold, and full sets decide on the others.

Bands that many classes share (a common line in short texts) are left out where that is safe. Each
differing shingle changes one band at most, and two classes at the threshold differ in at most
d = n (100 - percent) / percent shingles, so by the prefix-filter lemma they meet in one of the
d + 1 rarest bands of each; a class drops its more frequent ones.

Groups never become all their pairs. Each band compares its members with a central one, and links are
joined to components in the cluster. Where members of a band are left in several components, they are
compared with a second central one for their exact differences from it. Two of them that are not both
linked with it can only be linked if they share differences, so a join on the rarest differences finds
every pair still possible (:func:`alike`), and these are confirmed on full sets.

Only what is compared needs full sets: these are computed again from the texts of one document a
class. Digests, links and labels are written to the shared folder, which cuts lineage.

Defined results: null and empty texts have an empty set and are linked with nothing; a text with
fewer words than a shingle has its whole sequence as the only one; repeated rows are linked as
copies; documents without a key are linked like others, and their component is null if none of its
documents has a key; an empty table gives an empty result; any number of words per text works, as hashing is
done on bytes of one text at a time; :func:`near_duplicates` reads key and text only, and
:func:`keep_one` passes all columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, hash_part, stored, table
from .components import connected

#: Words in a shingle, and least similarity in percent, where no contract says otherwise.
WORDS, PERCENT = 5, 80
REGISTERS, MANTISSA, MISS, ERRORS = 128, 10, 1e-6, 5.0
SLICE = 256
_EMPTY = 0xFFFF
_BASE = 0x5851F42D4C957F2D
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))])
                      for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_GAP[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    h = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(h):
        return h.astype(np.uint64)
    k = min(words, len(h))
    n, out = len(h) - k + 1, np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash of a sorted set: 16 bits for each bucket, all ones where it is empty."""
    out = np.full(REGISTERS, _EMPTY, np.uint16)
    bits = 64 - (REGISTERS.bit_length() - 1)
    bucket = (hashes >> np.uint64(bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(hashes) else np.empty(0, np.int64)
    least = hashes[first] & np.uint64((1 << bits) - 1)
    length = np.frexp((least >> np.uint64(8)).astype(np.float64))[1] + 8  # leading zeros up to the last eight bits
    zeros = np.minimum(bits - length, 48).astype(np.uint64)
    tail = (least << (zeros + np.uint64(65 - bits))) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | tail).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of registers, and how many buckets it rests on."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = ((a == b) & used).sum(axis=1)
    level = np.arange(50)

    def chance(n: np.ndarray) -> np.ndarray:
        reach = 1 - (1 - 0.5 ** level[None, :]) ** (n[:, None] / REGISTERS)  # least hash has that many leading zeros
        return reach - np.concatenate([reach[:, 1:], np.zeros((len(n), 1))], axis=1)

    by_chance = REGISTERS * (chance(na) * chance(nb)).sum(axis=1) * 0.5 ** MANTISSA
    total = used.sum(axis=1)
    return np.clip((same - by_chance) / np.maximum(total - by_chance, 1e-9), 0, 1), total


def band_rows(percent: int) -> int:
    """Most registers in a band for which a pair at the threshold is missed with probability MISS at most."""
    fits = [r for r in range(1, 9) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def named_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, h): h is a hash of the text where the key is null, so that the text can be found again; else null."""
    d = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"))
    return d.withColumn("h", F.when(F.col("key").isNull(), F.xxhash64("text")))


def digests(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, h, n, cls, registers): set size, 128-bit name of the set, HyperMinHash; both null without a set."""
    d = named_texts(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(at, SLICE), []
                for t in part.column(1).to_pylist():
                    s = shingles(t, words)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s) else (0, None, None))
                n, cls, regs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                                                  pa.array(regs, pa.binary())], names=["key", "h", "n", "cls", "registers"])

    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, h long, n long, cls binary, registers binary")


def bands(classes: DataFrame, rows: int) -> DataFrame:
    """(band, node, n, bands): a hash of each band that is not wholly empty, set size, number of such bands."""
    empty = F.lit(b"\xff" * (2 * rows))
    cut = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1)), lambda i: F.struct(
        i.alias("i"), F.substring(F.col("registers"), i * (2 * rows) + 1, F.lit(2 * rows)).alias("r")))
    filled = F.filter(cut, lambda x: x["r"] != empty)
    return (classes.select(F.col("cls").alias("node"), "n", filled.alias("x"))
            .select("node", "n", F.size("x").alias("bands"), F.explode("x").alias("x"))
            .select(F.xxhash64("x.i", "x.r").alias("band"), "node", "n", "bands"))


def shared_bands(classes: DataFrame, percent: int) -> DataFrame:
    """(band, node): bands of two classes or more, less those that a class need not keep."""
    members = bands(classes, band_rows(percent))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("m"))
    busy = members.join(sizes.where(F.col("m") > 1), "band")
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("m", "band")) + F.col("bands") - F.count(F.lit(1)).over(own)
    kept = busy.withColumn("rank", rank).where(
        F.col("rank") <= F.floor(F.col("n") * (100 - percent) / percent) + 1).select("band", "node")
    return several(stored(kept, "bands"))


def several(members: DataFrame) -> DataFrame:
    """The members (band, node) of bands with two or more."""
    many = members.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where(F.col("lo") != F.col("hi"))
    return members.join(many.select("band"), "band")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is not clearly below the threshold."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                p = batch.slice(at, 4096)
                regs = [np.frombuffer(b"".join(p.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)]
                j, total = estimate(*regs, *(p.column(k).to_numpy().astype(float) for k in (2, 3)))
                keep = j >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(total, 1)) - 1.0 / np.maximum(total, 1)
                yield p.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("set").alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                p = batch.slice(at, SLICE)
                keep = []
                for x, y in zip(p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def full_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the classes ``wanted`` (cls, key, h), from the text of one document each."""
    d, w = named_texts(docs, key, text), wanted.select("cls", F.col("key").alias("of_key"), F.col("h").alias("of_h"))
    d = d.join(w, F.col("key").eqNullSafe(F.col("of_key")) & F.col("h").eqNullSafe(F.col("of_h"))).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                p = batch.slice(at, SLICE)
                sets = [shingles(t, words).tobytes() for t in p.column(1).to_pylist()]
                keep = [xxhash.xxh3_128_digest(s) == c for s, c in zip(sets, p.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(sets, pa.binary())], names=["cls", "set"]).filter(
                    pa.array(keep, pa.bool_()))

    return d.mapInArrow(run, "cls binary, set binary").dropDuplicates(["cls"])


def star(live: DataFrame) -> DataFrame:
    """(band, leader): for each band the member that is in most live bands, so the one nearest to the others."""
    central = live.groupBy("node").agg(F.count(F.lit(1)).alias("bands"))
    best = F.max(F.struct("bands", hash_part(1, F.col("node")).alias("h"), F.col("node").alias("x")))
    return live.join(central, "node").groupBy("band").agg(best.alias("l")).select("band", F.col("l.x").alias("leader"))


def link_classes(docs: DataFrame, key: str, text: str, words: int, percent: int, classes: DataFrame) -> DataFrame | None:
    """(node, label) of the classes linked with others; None if there are none."""
    live = stored(shared_bands(classes, percent), "bands")
    # first each band's members are compared with one of them
    chosen = stored(star(live), "bands")
    pairs = live.join(chosen, "band").where(F.col("node") != F.col("leader"))
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    labels = merged(None, compared(docs, key, text, words, percent, classes, pairs))
    # then, in bands whose members are not all linked, with another, now for their exact differences from it
    live = live.join(chosen.withColumnRenamed("leader", "node"), ["band", "node"], "left_anti")
    if labels is not None:
        name = labelled(live, labels, "node")
        spread = name.groupBy("band").agg(F.min("of_node").alias("lo"), F.max("of_node").alias("hi"))
        live = live.join(spread.where(F.col("lo") != F.col("hi")).select("band"), "band")
    live = stored(several(live), "bands")
    if live.isEmpty():
        return labels
    pairs = live.join(star(live), "band").where(F.col("node") != F.col("leader")).select("leader", "node").distinct()
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("leader").alias("cls")).union(pairs.select("node")).distinct()
    sets = stored(full_sets(docs, key, text, words, classes.select("cls", "key", "h").join(nodes, "cls")), "sets")
    spokes = stored(differences(pairs, sets, percent), "spokes")
    labels = merged(labels, spokes.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    # and with each other only if they differ from it in the same way
    pairs = alike(spokes, percent)
    if labels is not None:
        pairs = labelled(labelled(pairs, labels, "a"), labels, "b").where(F.col("of_a") != F.col("of_b")).select("a", "b")
    close = stored(likely(pairs, classes, percent), "pairs")
    return merged(labels, stored(verified(close, sets, percent), "links"))


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(leader, node, linked, n, prefix, tokens) of the pairs (leader, node); n is the size of the node's set.

    A token names a shingle that only one of the two has, and which of them. ``prefix`` is how many
    of its tokens, rarest first, a node needs so as to meet every node that it could be linked with
    (see :func:`alike`).
    """
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("set").alias(f"s_{s}"))
    both = pairs.join(side("leader"), "leader").join(side("node"), "node").select("leader", "node", "s_leader", "s_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                p = batch.slice(at, SLICE)
                rows = []
                for x, y in zip(p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    gone, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                    d, n = len(gone) + len(new), len(x) + len(y)
                    linked = 100 * (len(x) - len(gone)) >= percent * (len(y) + len(gone))
                    need = -(-d * percent // (100 + percent)) if linked else -(-(d * (100 + percent) - n * (100 - percent)) // (2 * (100 + percent)))
                    tokens = np.concatenate([mixed(gone), mixed(new ^ np.uint64(0xA5A5A5A5A5A5A5A5))]).view(np.int64)
                    rows.append((linked, len(y), d - max(1, need) + 1, tokens.tolist()))
                linked, size, prefix, tokens = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), p.column(1), pa.array(linked), pa.array(size, pa.int64()), pa.array(prefix, pa.int64()),
                     pa.array(tokens, pa.list_(pa.int64()))], names=["leader", "node", "linked", "n", "prefix", "tokens"])

    return both.mapInArrow(run, "leader binary, node binary, linked boolean, n long, prefix long, tokens array<long>")


def alike(spokes: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of nodes of a leader that could be linked though not both are linked with it.

    Let d(x) be the number of shingles in which x and its leader differ, n(x) the size of its set, and
    c = (100 - percent) / (100 + percent). Two nodes x and y differ in d(x) + d(y) - 2 s shingles, where
    s is the number of tokens they share, and are linked if that is at most c (n(x) + n(y)). If x is
    not linked with the leader, d(x) is above c (n(x) + n(leader)); as d(y) is at least the difference
    of n(y) and n(leader), s must be at least (d(x) - c (n(x) + n(leader))) / 2, and at least
    d(y) (1 - c) / 2, so never 0. By the prefix-filter lemma such nodes share one of the d - s + 1
    tokens of each that are rarest among the leader's nodes; and from the first token that they
    share on, either must have s tokens left.
    """
    tokens = spokes.select("leader", "node", "linked", "n", "prefix", F.size("tokens").alias("d"), F.explode("tokens").alias("token"))
    found = tokens.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("m"), F.bool_and("linked").alias("settled"))
    of_node = Window.partitionBy("leader", "node").orderBy("m", "token")
    rare = (tokens.join(found, ["leader", "token"]).withColumn("rest", F.col("d") - F.row_number().over(of_node) + 1)
            .where((F.col("d") - F.col("rest") < F.col("prefix")) & (F.col("m") > 1) & ~F.col("settled"))
            .select("leader", "token", "node", "linked", "n", "d", "rest"))
    rare = stored(rare, "tokens")
    x, y = rare.where(~F.col("linked")).alias("x"), rare.alias("y")
    most = F.least("x.rest", "y.rest")  # if this is the first token that they share
    need = (100 + percent) * (F.col("x.d") + F.col("y.d")) - (100 - percent) * (F.col("x.n") + F.col("y.n"))
    return (x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.token") == F.col("y.token"))
                   & (F.col("y.linked") | (F.col("x.node") < F.col("y.node"))) & (2 * (100 + percent) * most >= need))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def labelled(rows: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """``rows`` with the label of a node, or the node itself where it has none."""
    of = labels.select(F.col("node").alias("labelled"), "label")
    return (rows.join(of, F.col(node) == F.col("labelled"), "left")
            .withColumn(f"of_{node}", F.coalesce("label", node)).drop("labelled", "label"))


def compared(docs: DataFrame, key: str, text: str, words: int, percent: int, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are links: estimated first, then confirmed on full sets."""
    close = stored(likely(pairs, classes, percent), "pairs")
    nodes = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct()
    sets = stored(full_sets(docs, key, text, words, classes.select("cls", "key", "h").join(nodes, "cls")), "sets")
    return stored(verified(close, sets, percent), "links")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after new links: only links between different labels are joined to components."""
    if links.isEmpty():
        return labels
    if labels is None:
        return connected(links)
    new = labelled(labelled(links, labels, "a"), labels, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    nodes = labels.union(links.select("a", "a").union(links.select("b", "b"))).groupBy("node").agg(F.min("label").alias("label"))
    joined = connected(new).withColumnsRenamed({"node": "old", "label": "new"})
    return stored(nodes.join(joined, F.col("label") == F.col("old"), "left")
                  .select("node", F.coalesce("new", "label").alias("label")), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """(key, n, component) for every row: size of its shingle set, least key of its component."""
    d = stored(digests(docs, key, text, words), "digests")
    full = d.where(F.col("n") > 0)
    classes = stored(full.groupBy("cls").agg(F.min("key").alias("key"), F.when(F.min("key").isNull(), F.min("h")).alias("h"),
                                             F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")
    labels = link_classes(docs, key, text, words, percent, classes)
    named = classes.select("cls", F.col("key").alias("least"))
    if labels is not None:
        named = named.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        least = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("of_label"))
        named = named.join(least, "label", "left").select("cls", F.coalesce("of_label", "least").alias("least"))
    return d.select("key", "n", "cls").join(named, "cls", "left").select(
        "key", "n", F.coalesce("least", "key").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component (and every document without words), with their own columns."""
    (row,) = fresh(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "dedup")
    gone = near_duplicates(numbered, row, text, words, percent).where(F.col("key") != F.col("component")).select(F.col("key").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[col(c) for c in docs.columns])


def op4_hyperminhash_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def jaccard_sql(words: int, percent: int) -> str:
    """DuckDB SQL of the exact result: sets, all pairs that share a shingle, components."""
    return rf"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {words - 1}], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {words - 2}))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


QUERIES = {"op4_hyperminhash_dedup": op4_hyperminhash_dedup}
SQL = {"op4_hyperminhash_dedup": jaccard_sql(3, 85)}
