"""Prefix trie of conversations by range minima over sorted common prefixes.

Equal conversations are first counted as one class. Classes are sorted by their turns, and between
neighbours stands the length of their common prefix (LCP). Every position gives a candidate
prefix: its own LCP with the position before. The members of a candidate are the positions around
it up to the first smaller LCP on each side; the left and the right end are found independently,
by bisection over a sparse table of range minima, so nothing is kept on a stack and candidates of
all depths run side by side. Ends that lie outside a block of ``BLOCK`` positions are looked up in
the sparse table of block minima, and then among the running minima of the block they fall in.
A candidate and its interval are a branching node; a class longer than both of its LCPs is a leaf;
and the depths between a node and its parent's depth are nodes with the same members. Counts are
differences of prefix sums at the two ends of the interval; the smallest member is a range minimum
by the same tables.

Texts are read once, for a 128-bit digest and a word count of each turn. Turns are numbered by a
distributed sort, so a conversation with a third of all turns is spread over tasks; its digests
are kept in chunks of ``CHUNK`` turns. Sorting compares one chunk at a time: only classes that
share a whole chunk with another go on to the next round. What reaches the driver, and what is
broadcast, is one row for each block of 16,384 classes (70 bytes, so 5 MB for a billion).
The digest of a node's ends is by definition sequential: ids of a class are joined in pieces of at
most 512, sorted, and streamed through one digest with bounded memory.

Defined results: rows without a conversation id belong to none and are left out; null roles and
texts are empty; turns are ordered by turn (null first), equal turns by the digest of role and
text, so repeated rows are turns of their own; a conversation without any turn ends at the root;
texts of any length only pass through the digest; an empty table has no root and no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import row_number_global
from .common import col, hash_part, let, stored, table, word_count, zero

#: Turns of a conversation kept in one row, positions in a block, width of a piece of ids (as a power of two).
CHUNK, BLOCK, PIECE_BITS = 32, 1 << 14, 9
NOTHING = hashlib.sha256(b"").hexdigest()
END = np.iinfo(np.int64).max


def numbered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """(conv, at, id, words): the turns of every conversation from 0, with digest and words of the text."""
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    framed = F.concat(F.length(said(role)).cast("string"), F.lit(":"), said(role), said(text))
    rows = stored(conversations.where(col(key).isNotNull()).select(
        col(key).cast("long").alias("conv"), col(turn).alias("turn"), F.unhex(F.md5(framed.cast("binary"))).alias("id"),
        word_count(said(text)).alias("words")), "trie-turns")
    # equal rows are told apart only so that the sort can split them
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("tie")]
    placed = stored(row_number_global(rows.withColumn("tie", F.monotonically_increasing_id()), order, "at")
                    .select("conv", "at", "id", "words"), "trie-turns")
    first = placed.groupBy(F.col("conv").alias("c")).agg(F.min("at").alias("first"))
    return placed.join(first, F.col("conv") == F.col("c")).select("conv", (F.col("at") - F.col("first")).alias("at"), "id", "words")


def chunks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, chunk, ids, words): at most ``CHUNK`` turns a row; (conv, n) of ``lengths`` adds those without turns."""
    each = (turns.groupBy("conv", F.floor(F.col("at") / CHUNK).alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "id", "words"))).alias("t"))
            .select("conv", "chunk", F.col("t.id").alias("ids"), F.col("t.words").alias("words")))
    silent = lengths.where(F.col("n") == 0).select("conv", zero().alias("chunk"), F.array().cast("array<binary>").alias("ids"),
                                                   F.array().cast("array<bigint>").alias("words"))
    return each.union(silent)


def signatures(parts: DataFrame) -> DataFrame:
    """(conv, a, b, n): 128 bits and the length of every whole conversation."""
    return parts.groupBy("conv").agg(*[F.bit_xor(hash_part(seed, F.col("chunk"), F.col("ids"))).alias(c)
                                       for seed, c in ((21, "a"), (22, "b"))], F.sum(F.size("ids")).cast("long").alias("n"))


def with_previous(rows: DataFrame, position: str, names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of the row before as prev_*, in blocks that also hold the last of the block before."""
    at = F.col(position)
    own = rows.withColumn("own", F.lit(True)).withColumn("block", F.floor(at / BLOCK))
    lent = rows.where(at % BLOCK == BLOCK - 1).withColumn("own", F.lit(False)).withColumn("block", F.floor(at / BLOCK) + 1)
    w = Window.partitionBy("block").orderBy(position)
    before = own.union(lent).select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in names])
    return before.where("own").drop("own", "block")


def sorted_classes(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """(pos, conv, lcp): classes in the order of their turns and the common prefix with the one before (-1 for the first)."""
    parts = parts.join(classes.select(F.col("conv").alias("c")), F.col("conv") == F.col("c"), "left_semi")
    open_ = classes.select("conv", zero().alias("g"))
    places, lcps, t = [], [], 0
    while True:
        ids = parts.where(F.col("chunk") == t).select(F.col("conv").alias("c"), "ids")
        ids = open_.join(ids, F.col("conv") == F.col("c"), "left").select(
            "conv", "g", F.coalesce("ids", F.array().cast("array<binary>")).alias("ids"))
        ranked = row_number_global(ids, [F.col("g"), F.col("ids"), F.col("conv")], "rn").withColumn("rn", F.col("rn") - 1)
        if t == 0:
            ranked = ranked.withColumn("pos", F.col("rn"))
        else:
            starts = ranked.groupBy(F.col("g").alias("group")).agg(F.min("rn").alias("first"))
            ranked = (ranked.join(starts, F.col("g") == F.col("group"))
                      .withColumn("pos", F.col("g") + F.col("rn") - F.col("first")).drop("group", "first"))
        same = F.col("prev_g").eqNullSafe(F.col("g"))
        alike = F.array_position(F.zip_with("ids", "prev_ids", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        shared = F.when(same, F.when(alike == 0, F.least(F.size("ids"), F.size("prev_ids"))).otherwise(alike - 1).cast("long"))
        here = (with_previous(ranked, "rn", ["g", "ids"]).withColumn("shared", shared)
                .withColumn("tied", F.coalesce(F.col("shared") == CHUNK, F.lit(False)))
                .select("conv", "g", "pos", "shared", "tied", "ids"))
        here = stored(here, "trie-order")
        # the first of a group knows its LCP from the round before
        lcps.append(here.where(~F.col("tied") & (F.col("shared").isNotNull() | F.lit(t == 0)))
                    .select("pos", F.coalesce(F.col("shared") + t * CHUNK, F.lit(-1)).alias("lcp")))
        ties = here.where("tied").select("g", "ids").distinct()
        if ties.isEmpty():
            places.append(here.select("pos", "conv"))
            break
        tied = stored(here.join(ties, ["g", "ids"], "left_semi").groupBy("g", "ids").agg(F.min("pos").alias("to")), "trie-ties")
        moved = here.join(tied, ["g", "ids"], "left")
        places.append(moved.where(F.col("to").isNull()).select("pos", "conv"))
        open_ = stored(moved.where(F.col("to").isNotNull()).select("conv", F.col("to").alias("g")), "trie-open")
        t += 1
    every = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(every(frames[1:]))
    return every(places).join(every(lcps), "pos")


class Minima:
    """Sparse table: level k holds the minima of all stretches of 2^k numbers."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << len(self.levels) - 1) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
        self.n = len(values)

    def left(self, before: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place before ``before`` with a number below ``least``; -1 if there is none."""
        end = before.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            at = end - (1 << k)
            ok = at >= 0
            ok[ok] = self.levels[k][at[ok]] >= least[ok]
            end = np.where(ok, at, end)
        return end - 1

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from ``start`` on with a number below ``least``; n if there is none."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at + (1 << k) <= self.n
            ok[ok] = self.levels[k][at[ok]] >= least[ok]
            at = np.where(ok, at + (1 << k), at)
        return at

    def between(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The minimum from first to end - 1; ``END`` for an empty range."""
        out = np.full(len(first), END)
        size = end - first
        for k, level in enumerate(self.levels):
            now = (size >= 1 << k) & (size < 2 << k)
            out[now] = np.minimum(level[first[now]], level[end[now] - (1 << k)])
        return out


SIDES = {"l": ("pos", "lcp", "count", "leaves", "tally", "low", "conv", "n", "block", "up", "up_to"),
         "r": ("pos", "lcp", "count", "leaves", "tally", "low", "block")}
COLUMNS = ["kind", "c", "low", "l_to", "r_to", *[f"{s}_{x}" for s, names in SIDES.items() for x in names]]


class Blocks:
    """What a block needs to know of the others: one row a block, known to all."""

    def __init__(self, rows: list):
        get = lambda c: np.array([r[c] for r in rows], np.int64)
        self.n = len(rows)
        self.first = np.append(get("first_lcp"), -1)
        self.lcp, self.low = Minima(get("min_lcp")), Minima(get("low"))
        leaves = get("leaves") + (get("last_n") > self.first[1:])
        self.before = {name: np.concatenate([[0], np.cumsum(x)]) for name, x in (
            ("size", get("size")), ("count", get("count")), ("leaves", leaves), ("all", get("all")), ("new", get("new")))}

    def end(self) -> dict[str, int]:
        """The place after the last class, as the right end of an interval."""
        t = {k: int(v[-1]) for k, v in self.before.items()}
        return {"pos": t["size"], "lcp": -1, "count": t["count"], "leaves": t["leaves"], "tally": t["all"] - t["new"], "low": END,
                "block": self.n}


def candidates(block: pa.Table, blocks: Blocks) -> pa.Table:
    """Candidates of one block with their ends as far as it holds them, and its running minima for other blocks."""
    rows = block.to_pandas().sort_values("pos")
    b, m = int(rows["block"].iloc[0]), len(rows)
    f = {c: rows[c].to_numpy(np.int64) for c in ("pos", "conv", "lcp", "n", "count", "all", "upto")}
    v = np.append(f["lcp"], blocks.first[b + 1])
    new = f["all"] - f["upto"]
    sums = {c: blocks.before[c][b] + np.concatenate([[0], np.cumsum(x)]) for c, x in (
        ("count", f["count"]), ("leaves", f["n"] > v[1:]), ("all", f["count"] * f["all"]), ("new", new))}
    minima, lows = Minima(v), Minima(f["conv"])
    i = np.arange(m)
    left, right = minima.left(i, v[:-1]), minima.right(i + 1, v[:-1])
    first = f["pos"] == 0
    left_to = np.where((left >= 0) | first, -1, blocks.lcp.left(np.full(m, b), v[:-1]))
    right_to = np.where((right <= m) | first, -1, blocks.lcp.right(np.full(m, b + 1), v[:-1]))
    up = np.where(left >= 0, f["pos"][0] + left, -1)

    def left_side(at: np.ndarray) -> dict[str, np.ndarray]:
        return {"pos": f["pos"][at], "lcp": v[at], "count": sums["count"][at], "leaves": sums["leaves"][at],
                "tally": sums["all"][at] - sums["new"][at] - new[at] + f["all"][at], "conv": f["conv"][at], "n": f["n"][at],
                "low": lows.between(at, np.full(len(at), m)), "block": np.full(len(at), b), "up": up[at], "up_to": left_to[at]}

    def right_side(at: np.ndarray) -> dict[str, np.ndarray]:
        return {"pos": f["pos"][0] + at, "lcp": v[at], "count": sums["count"][at], "leaves": sums["leaves"][at],
                "tally": sums["all"][at] - sums["new"][at], "low": lows.between(np.zeros_like(at), at), "block": np.full(len(at), b)}

    def frame(kind: str, c: np.ndarray, l_at=None, r_at=None, low=None, l_to=None, r_to=None) -> pd.DataFrame:
        out = pd.DataFrame(0, index=np.arange(len(c)), columns=COLUMNS)
        for side, at, make in (("l", l_at, left_side), ("r", r_at, right_side)):
            if at is not None:
                known = at >= 0
                for name, x in make(np.where(known, at, 0)).items():
                    out[f"{side}_{name}"] = np.where(known, x, -1)
        for name, x in (("low", low), ("l_to", l_to), ("r_to", r_to)):
            out[name] = -1 if x is None else x
        return out.assign(kind=kind, c=c)

    leaf = np.flatnonzero(f["n"] > np.maximum(v[:-1], v[1:]))
    inner = np.flatnonzero(~first)
    l_in, r_in = left[inner], np.where(right[inner] <= m, right[inner], -1)
    both = (l_in >= 0) & (r_in >= 0)
    suffix = np.flatnonzero(v[:m] < np.append(np.minimum.accumulate(v[m - 1::-1])[::-1][1:], END))
    prefix = np.flatnonzero(v[:m] < np.append(END, np.minimum.accumulate(v[:m - 1])) if m > 1 else np.ones(1, bool))
    out = [frame("leaf", f["n"][leaf], leaf, leaf + 1, f["conv"][leaf]),
           frame("inner", v[inner], l_in, r_in, np.where(both, lows.between(np.maximum(l_in, 0), np.maximum(r_in, 0)), -1),
                 left_to[inner], right_to[inner])]
    if blocks.n > 1:
        out += [frame("l", v[suffix], l_at=suffix), frame("r", v[prefix], r_at=prefix)]
    return pa.Table.from_pandas(pd.concat(out, ignore_index=True), preserve_index=False)


def side(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in SIDES[prefix]])


def intervals(order: DataFrame) -> DataFrame:
    """Branching nodes and leaves: (c, l, r, low, children, parent): depth, both ends, smallest member, parent's place and depth.

    ``order`` holds pos, conv, lcp, n (turns), count (members), all (words) and upto (words up to the LCP) of every class.
    """
    spark = order.sparkSession
    order = stored(order.withColumn("block", F.floor(F.col("pos") / BLOCK)), "trie-order")
    after = F.lead("lcp").over(Window.partitionBy("block").orderBy("pos"))
    rows = (order.withColumn("leaf", F.col("n") > after).groupBy("block").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("lcp", "pos").alias("first_lcp"), F.min("lcp").alias("min_lcp"),
        F.min("conv").alias("low"), F.sum("count").alias("count"), F.count(F.when(F.col("leaf"), 1)).alias("leaves"),
        F.max_by("n", "pos").alias("last_n"), F.sum(F.col("count") * F.col("all")).alias("all"),
        F.sum(F.col("all") - F.col("upto")).alias("new")).orderBy("block").collect())
    shared = spark.sparkContext.broadcast(Blocks(rows))
    schema = ", ".join(f"{c} {'string' if c == 'kind' else 'long'}" for c in COLUMNS)
    found = stored(order.groupBy("block").applyInArrow(lambda t: candidates(t, shared.value), schema), "trie-candidates")
    nodes = found.where(F.col("kind").isin("leaf", "inner")).select(
        "c", "low", "l_to", "r_to", side("l").alias("l"), side("r").alias("r"))
    if len(rows) > 1:
        nodes, ups = across(nodes, found, shared)
    else:
        ups = None
    nodes = stored(nodes.groupBy(F.col("l.pos").alias("l_pos"), "c").agg(
        F.any_value("l").alias("l"), F.any_value("r").alias("r"), F.min("low").alias("low"), F.count(F.lit(1)).alias("branches")), "trie-nodes")
    above = F.greatest("l.lcp", "r.lcp")
    nodes = nodes.withColumn("above", above)
    if ups is not None:
        nodes = nodes.join(ups, (F.col("l.up_to") == F.col("q_to")) & (F.col("l.lcp") == F.col("q_c")), "left")
        up = F.when(F.col("l.up") >= 0, F.col("l.up")).otherwise(F.col("q_pos"))
    else:
        up = F.col("l.up")
    nodes = nodes.withColumn("parent", F.when(F.col("l.lcp") < F.col("above"), F.col("l.pos")).otherwise(up))
    lows = nodes.select(F.col("l_pos").alias("p_pos"), F.col("c").alias("p_c"), F.col("low").alias("parent_low"))
    return nodes.join(lows, (F.col("parent") == F.col("p_pos")) & (F.col("above") == F.col("p_c")), "left")


def across(nodes: DataFrame, found: DataFrame, shared) -> tuple[DataFrame, DataFrame]:
    """Ends that lie in other blocks, and for left ends the table (q_to, q_c, q_pos) of those lookups."""
    ends = shared.value.end()
    n_blocks = shared.value.n
    # every position is a candidate, so the left ends of parents are among these lookups
    asked_left = nodes.where("l_to >= 0").select(F.col("l_to").alias("to"), "c").distinct()
    asked_right = nodes.where(f"r_to >= 0 AND r_to < {n_blocks}").select(F.col("r_to").alias("to"), "c").distinct()

    def looked_up(asked: DataFrame, kind: str, best) -> DataFrame:
        minima = found.where(F.col("kind") == kind).select(side(kind).alias("at"))
        hit = asked.join(minima, (F.col("to") == F.col("at.block")) & (F.col("at.lcp") < F.col("c")))
        return hit.groupBy("to", "c").agg(best("at", "at.pos").alias(f"far_{kind}"))

    lefts = stored(looked_up(asked_left, "l", F.max_by), "trie-ends")
    rights = stored(looked_up(asked_right, "r", F.min_by), "trie-ends")
    last = F.struct(*[F.lit(ends[c]).cast("long").alias(c) for c in SIDES["r"]])
    nodes = (nodes.withColumnRenamed("c", "depth")
             .join(lefts, (F.col("l_to") == lefts["to"]) & (F.col("depth") == lefts["c"]), "left")
             .join(rights, (F.col("r_to") == rights["to"]) & (F.col("depth") == rights["c"]), "left")
             .withColumn("l", F.when(F.col("l_to") >= 0, F.col("far_l")).otherwise(F.col("l")))
             .withColumn("r", F.when(F.col("r_to") >= n_blocks, last).when(F.col("r_to") >= 0, F.col("far_r")).otherwise(F.col("r"))))

    @F.pandas_udf("long")
    def lowest(first: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series(shared.value.low.between(first.to_numpy(np.int64), np.minimum(end.to_numpy(np.int64), n_blocks)))

    wide = F.least("l.low", "r.low", lowest(F.col("l.block") + 1, F.col("r.block")))
    here = (F.col("l_to") < 0) & (F.col("r_to") < 0)
    nodes = nodes.select(F.col("depth").alias("c"), F.when(here, F.col("low")).otherwise(wide).alias("low"), "l", "r")
    return nodes, lefts.select(F.col("to").alias("q_to"), F.col("c").alias("q_c"), F.col("far_l.pos").alias("q_pos"))


def end_digests(members: DataFrame) -> DataFrame:
    """(conv, ends): for every class (a, b, n) its smallest id and the SHA-256 of its ids, ascending, joined by commas.

    Ids differ, so a piece of ids that agree but for their last bits is bounded; pieces are streamed in order.
    """
    key = ["a", "b", "n"]
    pieces = (members.groupBy(*key, F.shiftright("conv", PIECE_BITS).alias("piece"))
              .agg(F.array_sort(F.collect_list("conv")).alias("ids"))
              .select(*key, "piece", F.get("ids", F.lit(0)).alias("conv"),
                      F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, h = None, None, None
        for batch in batches:
            done = []
            for a, b, n, c, text in zip(*[batch.column(x).to_pylist() for x in (*key, "conv", "text")], strict=True):
                if (a, b, n) == now:
                    h.update(b",")
                else:
                    if now is not None:
                        done.append((conv, h.hexdigest()))
                    now, conv, h = (a, b, n), c, hashlib.sha256()
                h.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.string()))],
                                             names=["conv", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], names=["conv", "ends"])

    ordered = pieces.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, "piece").select(*key, "conv", "text")
    return ordered.mapInArrow(digest, "conv long, ends string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations.

    ``turns``: (conv, at, id, words), numbered from 0 in each conversation; ``lengths``: (conv, n) of
    all conversations, those without turns included. Returns conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    parts = stored(chunks(turns, lengths), "trie-chunks")
    members = stored(signatures(parts), "trie-members")
    classes = stored(members.groupBy("a", "b", "n").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("count")), "trie-classes")
    total = lambda x: F.aggregate(x, zero(), lambda s, w: s + w)
    order = stored(sorted_classes(classes, parts), "trie-sorted")
    head = F.least(F.greatest(F.col("lcp") - F.col("chunk") * CHUNK, F.lit(0)), F.size("words").cast("long")).cast("int")
    summed = (order.join(parts, "conv").groupBy("conv", "pos", "lcp")
              .agg(F.sum(total(F.col("words"))).alias("all"), F.sum(total(F.slice("words", F.lit(1), head))).alias("upto")))
    nodes = intervals(summed.join(classes.select("conv", "n", "count"), "conv"))

    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    words = (parts.join(classes.select("conv"), "conv", "left_semi")
             .select(F.col("conv").alias("of"), "chunk", "words", F.coalesce(F.sum(total(F.col("words"))).over(before), zero()).alias("start")))
    count = F.col("r.count") - F.col("l.count")
    nodes = nodes.join(end_digests(members).withColumnRenamed("conv", "ended"),
                       (F.col("l.conv") == F.col("ended")) & (F.col("l.n") == F.col("c")), "left").select(
        F.col("low").alias("conv_id"), "parent_low", "above", "c", F.col("l.conv").alias("conv"), count.alias("n_convs"),
        # a leaf is its own only candidate; the first class goes on below a node unless it ends there
        F.when(F.col("l.n") > F.col("c"), F.col("branches") + 1).otherwise(F.when(F.col("r.pos") - F.col("l.pos") == 1, zero())
                                                                          .otherwise(F.col("branches"))).alias("n_children"),
        (F.col("r.leaves") - F.col("l.leaves")).alias("n_leaves"), (F.col("r.tally") - F.col("l.tally")).alias("tally"),
        F.when(F.col("l.n") == F.col("c"), F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    # depth d is held by the chunk of turn d - 1; the root goes with the first chunk
    lowest = F.greatest(F.col("above"), F.lit(0))
    spread = nodes.withColumn("chunk", F.explode(F.sequence(
        F.floor(lowest / CHUNK), F.greatest(F.floor((F.col("c") - 1) / CHUNK), F.floor(lowest / CHUNK)))))
    joined = spread.join(words, (F.col("conv") == F.col("of")) & (spread["chunk"] == words["chunk"])).drop(words["chunk"])
    base = F.col("chunk") * CHUNK
    first = F.when(F.col("above") < 0, zero()).otherwise(F.greatest(F.col("above"), base) + 1)
    first = F.when(F.col("chunk") == 0, first).otherwise(F.greatest(F.col("above"), base) + 1)
    depths = F.filter(F.sequence(first, F.greatest(F.least(F.col("c"), base + CHUNK), first)), lambda d: d <= F.col("c"))
    each = joined.withColumn("depth", F.explode(depths))
    said = F.col("start") + total(F.slice("words", F.lit(1), F.greatest(F.col("depth") - 1 - base, zero()).cast("int")))
    bottom = F.col("depth") == F.col("c")
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.when(F.col("depth") - 1 > F.col("above"), F.col("conv_id"))
                                   .otherwise(F.col("parent_low"))).alias("parent_conv_id"),
        "n_convs", F.when(bottom, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("tally") - (F.col("n_convs") - 1) * said).alias("saved_tokens"),
        F.when(bottom, F.col("ends_sha256")).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with h turns of the conversation c - c % 20 in place of their own first h; h = crc32(c) % 4."""
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    own = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4).withColumn("base", F.col("conv") - F.col("conv") % 20)
    of = own.select(F.col("conv").alias("b"), F.col("turns").alias("base_turns"))
    info = stored(own.join(of, F.col("base") == F.col("b"), "left").select(
        "conv", "base", "h", "turns", F.least("h", F.coalesce("base_turns", zero())).alias("taken")), "trie-rebuilt")
    later = turns.join(info.select(F.col("conv").alias("c"), "h", "taken"), (F.col("conv") == F.col("c")) & (F.col("at") >= F.col("h")))
    later = later.select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "id", "words")
    heads = turns.where((F.col("at") < 3) & (F.col("conv") % 20 == 0)).withColumnRenamed("conv", "b")
    early = info.join(heads, (F.col("base") == F.col("b")) & (F.col("at") < F.col("taken"))).select("conv", "at", "id", "words")
    return later.union(early), info.select("conv", (F.greatest(F.col("turns") - F.col("h"), zero()) + F.col("taken")).alias("n"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered_turns(table(spark, sf_dir, "conversations")), "trie-numbered")
    return prefix_trie(*rebuilt(turns))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
