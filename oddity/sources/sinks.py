"""Result sink (S5) and the append-only feedback table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import FEEDBACK_SCHEMA, insert
from ..session import checkpoint


def highlight(results: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Mark rows at or above the threshold."""
    return results.withColumn("is_highlighted", F.col(score) >= F.lit(threshold))


def write_results(results: DataFrame, path: str, threshold: float, score: str = "score",
                  rank: str = "rank", fmt: str = "parquet", top_n: int | None = None) -> None:
    """Write all results (or the top-N) with the highlight flag, ordered by rank."""
    out = highlight(results, threshold, score)
    if top_n is not None:
        out = out.filter(F.col(rank) <= top_n)
    out = out.repartitionByRange(F.col(rank)).sortWithinPartitions(rank)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


class FeedbackTable:
    """Feedback stored as an append-only parquet table in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def read(self, signature: str | None = None) -> DataFrame:
        try:
            df = self.spark.read.schema(FEEDBACK_SCHEMA).parquet(self.path)
        except AnalysisException as e:  # nothing stored yet; any other failure is the caller's to see
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], FEEDBACK_SCHEMA)
        return df if signature is None else df.filter(F.col("signature") == signature)

    def save(self, batch: DataFrame) -> DataFrame:
        """Append the batch rows not stored yet (B2) and return them."""
        existing = self.read()
        # materialised (reliably) before the table it was compared with changes, so a
        # recomputed task cannot see its own appended rows
        new = checkpoint(insert(existing, batch.select(*[f.name for f in existing.schema.fields])))
        new.write.mode("append").parquet(self.path)
        return new
