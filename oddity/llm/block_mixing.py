"""Mixing sources to target weights, in DataFrame functions only.

Every source's words, document after document, are packed into blocks of a fixed number of words.
A source's target decides how many slots of the mix it fills. How many of them fall on each output
shard is drawn first: the slots of all sources, laid end to end, are dealt to shards of
``SHARD_BLOCKS`` by one pseudorandom permutation, which is a multinomial draw conditioned on the
total of each source and on the size of each shard. The counts then say which slots a shard has:
those of a source are numbered shard after shard. Slot i of a source takes block p(i mod n), where n
is its number of blocks and p a pseudorandom permutation (swap-or-not, one for each pass over the
source), and blocks are joined by (source, index).

Each pass uses a block once, so no block, and no document, is used more often than passes are
begun: three at most, as targets stop at three times a source.

A source with a third of all rows is split by hash into buckets of rows; places within a source
come from a running sum inside buckets plus one over bucket totals. Only the table with a row a
source and that with a row a bucket pass through small windows; texts are read once for their
sizes, and shuffled once if pieces are asked for.

The order of documents within a source is that of seeded hashes of their columns, so the mix
depends on the rows alone, not on files or partitions; only rows equal in every column may change
places. A table with a row a source passes through windows in one task, one with a row for each
source and shard (8,192 blocks) through a window by source.

Defined results: a null or empty text has size 0 and is taken 0 times; a text of any length is cut
into blocks whole; null is a source of its own, ordered last; equal rows are separate documents; an
empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import GAP, NOT_GAP, buckets_for, col, fresh, hash_part, let, stored, table, word_count, zero

SEED, WEIGHTS, MOST = 6, (5, 2, 1), 3
#: Words in a block, blocks in an output shard, rows in a bucket of a source, slots made by one row.
BLOCK_WORDS, SHARD_BLOCKS, BUCKET_ROWS, CHUNK = 128, 8192, 4096, 4096
ROUNDS = 24


def permuted(x: Column, n: Column, rounds: int, *key: Column) -> Column:
    """Image of x in 0..n-1 under the permutation that ``key`` names.

    Swap-or-not: in each round x is paired with (k - x) mod n, and a hashed bit of the pair
    decides whether the two change places. That is a bijection for every n.
    """
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(hash_part(SEED, *key, r), n) - x, n)
        return let(other, lambda y: F.when(
            F.pmod(hash_part(SEED + 1, *key, r, F.greatest(x, y)), F.lit(2)) == 1, y).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) plus s (its rank by code point, null last), weight and target.

    Targets share the total by weight, and stop at ``most`` times the source's size. With the
    sources ordered by size for each unit of weight, the first of them that the share of what is
    left does not exceed fixes the level of all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = (sizes.withColumn("s", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.get(cycle, F.col("s") % len(weights)))
         .withColumn("ratio", most * F.col("source_size") / F.col("weight")))
    up = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = (s.withColumn("capped", most * F.coalesce(F.sum("source_size").over(up), zero()))
         .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), zero()))
         .withColumn("share", (F.sum("source_size").over(every) - F.col("capped")) / F.col("rest"))
         .withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "s", "share"))).over(every)["share"]))
    return s.select("source", "source_size", "s", "weight", F.least(
        (most * F.col("source_size")).cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, text: str = "text", source: str = "source", block: int = BLOCK_WORDS,
         weights: tuple[int, ...] = WEIGHTS, most: int = MOST, keep: tuple[str, ...] = (),
         order: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The mix as tables: rows, sources, draw, slots and pieces.

    rows: the columns ``keep`` of the documents plus row, s, size; sources: see :func:`targets`;
    draw: (s, shard, blocks, first) with the blocks of a source in a shard and the first of their slots;
    slots: (s, block, shard) once for every use; pieces: (row, s, block, first, n) with the words
    of a document that lie in a block. Documents are ordered by hashes of the columns ``order``
    (default: all but maps).
    """
    hashable = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    named = [col(c) for c in (hashable if order is None else [c for c in order if c in hashable])]
    base = stored(docs.select(*[col(c).alias(f"kept_{k}") for k, c in enumerate(keep)], col(source).alias("source"),
                              word_count(col(text)).alias("size"), F.monotonically_increasing_id().alias("row"),
                              *[hash_part(SEED + k, *named).alias(f"h{k}") for k in (3, 4)]), "mix")
    sources = stored(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
                     .withColumn("blocks", F.ceil(F.col("source_size") / block))
                     .withColumn("slots", F.when(F.col("source_size") > 0, F.least(
                         most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")))
                         .otherwise(zero())), "mix")
    rows = base.join(sources.select(F.col("source").alias("name"), "s"), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    n_buckets = buckets_for(base.count(), BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.col("h3"), F.lit(n_buckets)))
    in_bucket = Window.partitionBy("s", "bucket").orderBy("h3", "h4", "row").rowsBetween(Window.unboundedPreceding, -1)
    of_source = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
              .select("s", "bucket", F.coalesce(F.sum("n").over(of_source), zero()).alias("start")))
    placed = (rows.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), zero())).join(starts, ["s", "bucket"])
              .withColumn("from", F.col("start") + F.col("before")).withColumn("to", F.col("from") + F.col("size")))
    pieces = (placed.where(F.col("size") > 0)
              .select("row", "s", "from", "to", F.explode(F.sequence(
                  F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("block"))
              .select("row", "s", "block", (F.greatest("from", F.col("block") * block) - F.col("from")).alias("first"),
                      (F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)).alias("n")))

    drawn = stored(draw(sources), "mix")
    slots = (drawn.select("s", "shard", "of", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("i"))
             .select("s", permuted(F.col("i") % F.col("of"), F.col("of"), ROUNDS, F.col("s"), F.floor(F.col("i") / F.col("of")))
                     .alias("block"), "shard"))
    # written, as the planner takes exploded rows for as small as what they came from, and would broadcast them
    return {"rows": rows.drop("bucket", "h3", "h4"), "sources": sources, "draw": drawn.drop("of"), "slots": stored(slots, "mix"),
            "pieces": pieces}


def draw(sources: DataFrame, shard_blocks: int | None = None) -> DataFrame:
    """(s, shard, blocks, first, of): blocks of each source in each output shard, their first slot, and the source's blocks.

    ``sources`` has s, slots and blocks. Slots are dealt in chunks, and counted where they are dealt.
    """
    per_shard = shard_blocks or SHARD_BLOCKS
    total = sources.agg(F.sum("slots")).first()[0] or 0
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    laid = sources.withColumn("from", F.coalesce(F.sum("slots").over(before), zero())).where(F.col("slots") > 0)
    chunks = (laid.select("s", F.col("blocks").alias("of"), "slots", "from", F.explode(F.sequence(
        zero(), F.col("slots") - 1, F.lit(CHUNK).cast("long"))).alias("c")).repartition(buckets_for(total, 16 * CHUNK), F.col("s"), F.col("c")))
    each = chunks.select("s", "of", F.explode(F.sequence(F.col("from") + F.col("c"), F.col("from") + F.least(
        F.col("c") + CHUNK, F.col("slots")) - 1)).alias("ticket"))
    place = permuted(F.col("ticket"), F.lit(total).cast("long"), ROUNDS, F.lit(-1))
    counts = each.select("s", "of", F.floor(place / per_shard).alias("shard")).groupBy("s", "of", "shard").agg(F.count(F.lit(1)).alias("blocks"))
    earlier = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("s", "shard", "blocks", F.coalesce(F.sum("blocks").over(earlier), zero()).alias("first"), "of")


def used(tables: dict[str, DataFrame]) -> DataFrame:
    """pieces with the number of slots that use their block."""
    times = tables["slots"].groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    return tables["pieces"].join(times, ["s", "block"])


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix as rows with the columns of ``docs``: the piece of a document in each block, once for each use.

    The text is cut at word starts and keeps its blanks inside; a column ``n_chars`` is set anew.
    """
    row, parts = fresh(docs, "row_", "parts_")
    whole = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    tables = plan(whole, text, source, keep=(row,), order=tuple(docs.columns))
    names = tables["rows"].select(F.col("row"), F.col("kept_0").alias(row))
    taken = (used(tables).join(names, "row").groupBy(row)
             .agg(F.array_sort(F.collect_list(F.struct("first", "n", "times"))).alias(parts)))
    body = F.regexp_replace(col(text), "^" + GAP, "")
    pieces = F.split(body, "(?<=[\\x20\\x09-\\x0D])(?=" + NOT_GAP + ")")
    cut = let(pieces, lambda w: F.transform(col(parts), lambda p: F.struct(
        F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p["n"].cast("int")), "").alias("t"), p["times"].alias("k"))))
    out = (whole.join(taken, row).withColumn(parts, F.explode(cut))
           .withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), col(parts)["k"])))
           .withColumn(text, col(parts)["t"]))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(col(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*[col(c) for c in docs.columns])


def op6_block_mixing(spark, sf_dir):
    tables = plan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    taken = used(tables).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return (tables["rows"].join(taken, "row", "left").join(tables["sources"].drop("source"), "s")
            .select(F.col("kept_0").alias("doc_id"), "size", "source_size", "target",
                    F.coalesce("taken", zero()).alias("taken")))


QUERIES = {"op6_block_mixing": op6_block_mixing}
