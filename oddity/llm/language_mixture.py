"""Language identification by mixture inference.

Letters are lower-cased and everything else becomes one blank; byte trigrams are hashed to
``BUCKETS`` cells. Training counts cells by language over all given rows. A document is a mixture:
expectation-maximisation estimates the share of each language from its trigrams' likelihoods, and
the set of languages is the one with the best likelihood less a penalty for every language
(Bayesian information criterion; overlapping trigrams count a third each). The prediction is the
language with the largest share in that set, the score its share.

Counting sums in each task and shuffles one row for each (language, cell), so the model has at
most ``BUCKETS`` counts a language: 256 kB each in memory, the only thing broadcast. Languages are
label values, whose number does not grow with the rows.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if nothing was
learned; a text of any length counts whole; repeated rows are predicted alike; languages of equal
share are ordered by name; an empty table gives an empty result; rows with a null language are not
learned from; columns that are kept pass through, and the new ones take names that clash with none
of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, table

BUCKETS, SMOOTHING, STEPS, LEAST_SHARE = 1 << 16, 0.5, 15, 0.02
SLICE, LANGUAGES_HELD = 256, 64
_LETTERS = re.compile(r"[^\W\d_]+")


def cells(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of a text; None without a letter."""
    if not text or not any(c.isalpha() for c in text[:64]) and not any(c.isalpha() for c in text):
        return None
    b = np.frombuffer(f" {' '.join(_LETTERS.findall(text.lower()))} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def count_cells(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, cell, n) over all rows."""
    d = rows.select(col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text")).where(F.col("lang").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                                  pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                p = batch.slice(at, SLICE)
                for lang, text in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                    if (c := cells(text)) is not None:
                        if lang not in held:
                            held[lang] = np.zeros(BUCKETS, np.int64)
                        held[lang] += np.bincount(c, minlength=BUCKETS)
                if len(held) > LANGUAGES_HELD:
                    yield from flush()
        yield from flush()

    return d.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Mixture:
    """Languages in order of name and the log likelihood of every cell under each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        logs = np.empty((BUCKETS, len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            n = np.full(BUCKETS, SMOOTHING)
            at, c = counts[lang]
            n[at] += c
            logs[:, k] = np.log(n / n.sum())
        self.logs = logs

    def shares(self, logs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages by expectation-maximisation, and the log likelihood."""
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        pi = np.full(logs.shape[1], 1 / logs.shape[1])
        for _ in range(STEPS):
            r = p * pi
            pi = (n / r.sum(axis=1)) @ r / n.sum()
        return pi, float(n @ (np.log(p @ pi + 1e-300) + top[:, 0]))

    def infer(self, c: np.ndarray) -> list[tuple[str, float]]:
        """The chosen languages with their shares, largest first."""
        count = np.bincount(c, minlength=BUCKETS)
        at = np.flatnonzero(count)
        logs, n = self.logs[at].astype(np.float64), count[at].astype(np.float64)
        pi, _ = self.shares(logs, n)
        order = [int(k) for k in np.argsort(-pi, kind="stable") if pi[k] >= LEAST_SHARE] or [int(pi.argmax())]
        total, best = n.sum(), None
        for size in range(1, len(order) + 1):
            chosen = order[:size]
            share, fit = (np.ones(1), float(n @ logs[:, chosen[0]])) if size == 1 else self.shares(logs[:, chosen], n)
            value = fit / 3 - 0.5 * (2 * size - 1) * np.log(max(total / 3, 2))
            if best is not None and value <= best[0]:
                break
            best = (value, chosen, share)
        _, chosen, share = best
        return sorted(((self.langs[k], float(s)) for k, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Mixture | None:
    """The model; it has at most BUCKETS counts for each language. None if no row can be learned from."""
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in count_cells(rows, text, lang).toLocalIterator():
        counts.setdefault(r["lang"], []).append((r["cell"], r["n"]))
    return Mixture({k: (np.array([x for x, _ in v]), np.array([y for _, y in v])) for k, v in counts.items()}) if counts else None


def predict(docs: DataFrame, model: Mixture | None, keep: tuple[str, ...],
            text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` plus lang_pred, score and languages (all of the mixture, with shares).

    The second value maps those three to the names used, which clash with no column kept.
    """
    d = docs.select(*[col(c) for c in keep])
    given = ("lang_pred", "score", "languages")
    names = dict(zip(given, fresh(d, *given), strict=True))
    d = docs.select(*[col(c) for c in keep], col(text).cast("string").alias(fresh(d, "text_")[0]))
    schema = T.StructType([*d.schema.fields[:-1], *[T.StructField(names[c], t) for c, t in zip(
        given, (T.StringType(), T.DoubleType(), T.StringType()), strict=True)]])
    shared = d.sparkSession.sparkContext.broadcast(model)

    def one(text: str | None) -> list[tuple[str, float]]:
        c = cells(text) if shared.value is not None else None
        return shared.value.infer(c) if c is not None else [("und", 0.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                p = batch.slice(at, SLICE)
                found = [one(t) for t in p.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*p.columns[:-1], pa.array([f[0][0] for f in found]), pa.array([min(1.0, f[0][1]) for f in found], pa.float64()),
                     pa.array([" ".join(f"{k}:{s:.2f}" for k, s in f) for f in found])], names=schema.names)

    return d.mapInArrow(run, schema), names


def op2_language_mixture(spark, sf_dir):
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (part == 2).alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return predict(docs.drop("lang"), model, ("doc_id", "held_out"))[0]


QUERIES = {"op2_language_mixture": op2_language_mixture}
