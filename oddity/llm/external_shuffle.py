"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records by seeded hashes: the shard is the one with the highest hash of
(id, shard) (rendezvous hashing, law ``key``), and within a shard a second hash deals records
uniformly to buckets of a set number of bytes. Pass two shuffles each bucket: its records get
ordinals, a Fisher-Yates permutation of the ordinals (``shuffle``, an array of one number a record
of the bucket) gives their places, and the buckets of a shard are laid end to end, so slots run
from 0 without a gap. Records move once.

With one shard more, a record moves only if the new shard has the highest hash, so rows go to the
new shard alone. Permutations are drawn over a fixed range of buckets, so that the draw depends on
the seed and the buckets' counts only: reruns and retried tasks agree. What is broadcast is one
row a bucket; with ``bucket_bytes`` each, a terabyte has 16,000 of them. A task draws for
``DRAWN`` buckets, always the same ones, in their order.

Defined results: a text of any length is one record; a null text counts 16 bytes and has the checksum of the empty text; rows without
id are dealt by their text; repeated rows share a bucket and get slots of their own; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, col, fresh, hash_part, table

SEED, SHARDS, BUCKET_BYTES, DRAWN = 7, 40, 64 << 20, 64


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """Struct (w, s): the highest seeded hash of the key over all shards, and its shard."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                                   lambda s: F.struct(hash_part(seed, key, s).alias("w"), s.alias("s"))))


def external_shuffle(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
                     seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` plus size, shard, slot, bucket and grown shard.

    The second value maps those five to the names used, which clash with no column of ``docs``.
    """
    names = dict(zip(("size", "shard", "slot", "bucket", "grown"),
                     fresh(docs, "size", "shard", "slot", "bucket", "grown_shard"), strict=True))
    work = dict(zip(("key", "best", "order", "ordinal", "place", "b"),
                    fresh(docs, "key_", "best_", "order_", "ordinal_", "place_", "b_"), strict=True))
    total = docs.agg(F.sum(record_size(col(text)))).first()[0]
    subs = buckets_for(buckets_for(total, shards), bucket_bytes)
    named = F.coalesce(col(key).cast("string"), F.concat(F.lit("text "), F.coalesce(col(text), F.lit(""))))
    scattered = (
        docs.withColumn(work["key"], F.xxhash64(named))
        .withColumn(names["size"], record_size(col(text)))
        .withColumn(work["order"], hash_part(seed + 2, col(work["key"]), col(text)))
        .withColumn(work["best"], rendezvous(col(work["key"]), shards, seed))
        .withColumn(names["shard"], col(work["best"])["s"])
        .withColumn(names["grown"], F.when(hash_part(seed, col(work["key"]), F.lit(shards)) > col(work["best"])["w"],
                                           F.lit(shards)).otherwise(col(names["shard"])))
        .withColumn(names["bucket"], (col(names["shard"]) * subs + F.pmod(
            hash_part(seed + 1, col(work["key"]), col(text)), F.lit(subs))).cast("long"))
        .drop(work["best"])
    )
    counts = scattered.groupBy(col(names["bucket"]).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.floor(F.col("b") / subs)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spark, n_buckets = docs.sparkSession, shards * subs
    # a row a bucket, joined where the window below has its records already
    places = (spark.range(0, n_buckets, 1, -(-n_buckets // DRAWN)).withColumnRenamed("id", "b").join(F.broadcast(counts), "b")
              .select(F.col("b").alias(work["b"]), F.col("start").alias(work["place"]),
                      F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), seed).alias(work["order"])).hint("merge"))
    by = Window.partitionBy(col(names["bucket"])).orderBy(col(work["order"]), col(work["key"]))
    numbered = scattered.withColumn(work["ordinal"], F.row_number().over(by))
    placed = numbered.join(places, numbered[names["bucket"]] == places[work["b"]])
    slot = places[work["place"]] + F.get(places[work["order"]], numbered[work["ordinal"]] - 1)
    return placed.select(*[numbered[c] for c in docs.columns], numbered[names["size"]], numbered[names["shard"]],
                         slot.alias(names["slot"]), numbered[names["bucket"]],
                         numbered[names["grown"]]), names


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the records into a folder for each shard, in slot order, a file for each bucket."""
    placed, n = external_shuffle(docs, **options)
    buckets = placed.repartition(col(n["bucket"])).sortWithinPartitions(n["bucket"], n["slot"])
    buckets.drop(n["bucket"], n["grown"], n["size"]).write.partitionBy(n["shard"]).parquet(path)


def op7_external_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    placed, _ = external_shuffle(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
                         "slot", F.col("grown_shard").cast("int"))


QUERIES = {"op7_external_shuffle": op7_external_shuffle}
