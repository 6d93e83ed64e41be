"""Periodic runs against brute force over every period and place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from oddity.llm import periodic_runs as R
from oddity.llm.common import table

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Runs as (start, length, period), by start and period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_words(rnd):
    n, kinds = rnd.choice([0, 1, 5, 6, 7, 20, 60, 200]), rnd.choice([1, 2, 3, 50])
    w = [rnd.randrange(kinds) for _ in range(n)]
    if n and rnd.random() < 0.5:
        s, p = rnd.randrange(n), rnd.randrange(1, n // 3 + 2)
        w[s:] = [w[s + i % p] for i in range(n - s)]
    return w


def test_runs_of_many_texts_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        texts = [some_words(rnd) for _ in range(rnd.randrange(1, 6))]
        got = R.runs_of(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts], np.int64))
        assert list(map(tuple, got.tolist())) == [(k, *r) for k, t in enumerate(texts) for r in brute(t)]


def test_zeros_of_the_convolution_are_the_occurrences():
    w = np.random.default_rng(5).integers(0, 2, 400)
    for block in (1, 2, 8, 32):
        blocks = len(w) // block - 2
        place, q = R.occurrences(w, block, blocks)
        want = {(b, d) for b in range(0, blocks * block, block) for d in range(block, 2 * block)
                if (w[b:b + block] == w[b + d:b + d + block]).all()}
        assert set(zip(place.tolist(), q.tolist(), strict=True)) == want


def test_false_hash_matches_are_cut_by_comparison(monkeypatch):
    monkeypatch.setattr(R.Prefixes, "equal", lambda self, i, q, length: np.ones(len(i), bool))
    w = [1, 2, 1, 2, 1, 2, 1, 2, 1, 9, 5, 5, 5, 5, 5, 5, 5, 8]
    got = R.runs_of(np.array(w), np.array([len(w)]))
    assert [tuple(r[1:]) for r in got.tolist()] == brute(w)


def test_long_repetitive_texts():
    for w, runs in ((np.zeros(200_000, np.int64), [(0, 200_000, 1)]),
                    (np.arange(200_000) % 7, [(0, 200_000, 7)]),
                    (np.arange(100_000) % 24_999, [(0, 100_000, 24_999)]),
                    (np.where(np.arange(50_000) % 5_000 == 0, np.arange(50_000) + 1, 0), [(5_000 * k + 1, 4_999, 1) for k in range(10)])):
        assert [tuple(r[1:]) for r in R.runs_of(w, np.array([len(w)])).tolist()] == runs


def test_odd_rows_and_names(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 50)
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \n\t ", "c", 3), (4, "x " * 3000, "d", 4), (5, "a b a b a b a b end", "e", 5),
            (5, "a b a b a b a b end", "e", 5), (None, "z\tz\nz z z  z", None, None), (7, "once only", "f", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, Runs string, collapsed int")
    out, names = R.periodic_runs(d)
    assert names == {"runs": "_runs", "collapsed": "_collapsed"} and out.columns == [*d.columns, "_runs", "_collapsed"]
    got = sorted(((r["doc_id"] or 0, r["text"], r["Runs"], r["collapsed"], [tuple(x) for x in r["_runs"]], r["_collapsed"])
                  for r in out.collect()), key=str)
    want = []
    for i, t, a, b in rows:
        w = WORD.findall(t or "")
        want.append((i or 0, t, a, b, brute(w), collapse(w, brute(w))))
    assert got == sorted(want, key=str)
    empty, _ = R.periodic_runs(d.limit(0))
    assert empty.count() == 0


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").collect()}
    rows = R.op11_periodic_runs(spark, SF001).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    some = 0
    for r in rows:
        w = WORD.findall(docs[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r["collapsed_sha256"] == sha(collapse(w, runs))
        some += bool(runs)
    assert some > 10


def test_a_missing_key_plants_nothing(spark):
    d = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert d.select(R.planted(F.col("text"), F.col("doc_id")).alias("w")).first()["w"] == list("abcdef")
