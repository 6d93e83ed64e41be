"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Separators between words: space and the control characters tab to carriage return.
GAP = "[\\x20\\x09-\\x0D]+"
NOT_GAP = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made from ``names`` that clash with no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def zero() -> Column:
    return F.lit(0).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """Number of words (long), without building the words of a text one by one.

    Each word is turned into one character and the rest removed.
    """
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_GAP + "+", "x"),
                                     "[^x]+", "")).cast("long")


def hash_part(seed: int, *cols: Column) -> Column:
    """Seeded 64-bit hash."""
    return F.xxhash64(F.lit(seed), *cols)


def buckets_for(total: int | None, per_bucket: int) -> int:
    """Number of buckets that hold ``per_bucket`` units each, one at least."""
    return max(1, -(-int(total or 0) // per_bucket))


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes are at most ``most`` together, one row at least."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last
        first = last


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    Cuts lineage so that a lost executor costs a re-read and not a recomputation; the table stays
    until the folder is cleared.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
