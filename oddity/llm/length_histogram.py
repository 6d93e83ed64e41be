"""Token counts by an exact length histogram.

Each text is encoded by a public byte-level BPE vocabulary (Arrow batches, small slices, the
encoder built once a worker), documents are counted by encoded length, and suffix sums over the
histogram answer, for every context limit: how many documents and tokens are at least that long,
how many tokens remain if texts are truncated there, and which quantile it is.

The histogram has a row for each distinct length, so it is bounded by the longest text. Sums over
it run in two levels, inside buckets of lengths and over bucket totals, so no task gets more than
``SPAN`` lengths.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table
gives an empty histogram; text that looks like a special token is ordinary text; a text of any
length is encoded whole; null is a group of its own; a group column whose name a result column has
gets another name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, table, zero

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPAN, SLICE = 1024, 256
RESULTS = ("length", "docs", "docs_from", "tokens_from", "truncated_tokens", "share_to")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", by: tuple[str, ...] = (), vocabulary: str = VOCABULARY,
                  pattern: str = PATTERN) -> DataFrame:
    """The columns ``by`` (as by_0, by_1, ...) and the encoded length of every text."""
    d = docs.select(*[col(c).alias(f"by_{k}") for k, c in enumerate(by)], col(text).cast("string").alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                n = [len(encode(t)) if t else 0 for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())],
                                                 names=[*part.schema.names[:-1], "length"])

    fields = [f"by_{k} {d.schema[f'by_{k}'].dataType.simpleString()}" for k in range(len(by))]
    return d.mapInArrow(lengths, ", ".join([*fields, "length long"]))


def length_histogram(docs: DataFrame, text: str = "text", by: tuple[str, ...] = (), **options) -> DataFrame:
    """One row for each length (and group): documents, suffix sums, truncated total and rank.

    docs_from and tokens_from: documents of at least this length, and their tokens;
    truncated_tokens: all tokens left when texts are cut at this length; share_to: share of
    documents up to this length.
    """
    keys = [f"by_{k}" for k in range(len(by))]
    h = (token_lengths(docs, text, by, **options).groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("docs"))
         .withColumn("bucket", F.floor(F.col("length") / SPAN)))
    sums = (h.groupBy(*keys, "bucket").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
            .withColumnRenamed("bucket", "b"))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    later = Window.partitionBy(*group).orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    sums = sums.select(*[F.col(k).alias(f"s_{k}") for k in keys], "b",
                       F.coalesce(F.sum("d").over(later), zero()).alias("d_later"),
                       F.coalesce(F.sum("t").over(later), zero()).alias("t_later"),
                       F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    same = F.col("bucket") == F.col("b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"s_{k}"))
    within = Window.partitionBy(*keys, "bucket").orderBy(F.col("length").desc())
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (h.withColumn("d_in", F.sum("docs").over(upto))
           .withColumn("t_in", F.sum(F.col("docs") * F.col("length")).over(upto)).join(sums, same)
           .withColumn("docs_from", F.col("d_in") + F.col("d_later"))
           .withColumn("tokens_from", F.col("t_in") + F.col("t_later")))
    results = docs.sparkSession.createDataFrame([], ", ".join(f"{c} int" for c in RESULTS))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, fresh(results, *by), strict=True)], "length", "docs", "docs_from", "tokens_from",
                      (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
                      F.round((F.col("d_all") - F.col("docs_from") + F.col("docs")) / F.col("d_all"), 9).alias("share_to"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_cut, truncated_tokens) for any context limits, one pass over the histogram."""
    spread = histogram.select("length", "docs", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    return spread.groupBy("limit").agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("docs")).otherwise(zero())).alias("docs_cut"),
        F.sum(F.least("length", "limit") * F.col("docs")).alias("truncated_tokens"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least ``share`` of the documents do not exceed."""
    spread = histogram.select("length", "share_to", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return spread.where(F.col("share_to") >= F.col("share") - 1e-9).groupBy("share").agg(F.min("length").alias("length"))


def op9_length_histogram(spark, sf_dir):
    return length_histogram(table(spark, sf_dir, "documents"))


QUERIES = {"op9_length_histogram": op9_length_histogram}
