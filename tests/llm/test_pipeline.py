"""The pipeline on the smallest tables: every stage against brute force on its own input."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from oddity.llm import qgram_decontamination as D
from oddity.llm.common import stored, table

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def five(text):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def close(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_stages(spark):
    docs = table(spark, SF001, "documents")
    columns, inputs = docs.columns, {}
    for name, stage in P.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, SF001), "test")
        assert docs.columns[:len(columns)] == columns
    rows = {name: {r["doc_id"]: r["text"] for r in d.collect()} for name, d in inputs.items()}

    kept, was = rows["near-duplicates"], rows["quality rules"]
    assert set(kept) < set(was) and len(kept) > 0.8 * len(was)
    kept, was = rows["decontamination"], rows["near-duplicates"]
    sets = {i: five(t) for i, t in was.items()}
    ids = sorted(kept)
    assert not any(close(sets[a], sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    assert all(any(close(sets[i], sets[j]) for j in was if j != i) for i in set(was) - set(kept))
    kept, was = rows["mixing"], rows["decontamination"]
    items = [D.normal(r["text"]) for r in table(spark, SF001, "benchmark").collect()]
    leaks = {i for i, t in was.items() if any(x in D.normal(t) for x in items)}
    assert leaks and set(was) - set(kept) >= leaks and len(set(was) - set(kept)) <= len(leaks) + 2

    pieces = inputs["sharding"].collect()
    assert all(r["text"] in kept[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in pieces)
    total = sum(len(WORD.findall(t)) for t in kept.values())
    assert abs(sum(len(WORD.findall(r["text"])) for r in pieces) - total) < 0.05 * total
    out = docs.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in pieces)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_stages_with_odd_rows(spark, tmp_path):
    docs = table(spark, SF001, "documents")
    good = docs.orderBy(F.length("text").desc()).limit(12).collect()
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "xx", None, None), (3, " \n\t ", "en", "s", 4),
           (None, good[0]["text"], "en", None, 1), (4, good[1]["text"], None, "s", 2), (4, good[1]["text"], None, "s", 2),
           (5, " ".join(good[2]["text"].split() * 20 + good[3]["text"].split() * 20), "en", "t", 3)]
    rows = [tuple(r[c] for c in docs.columns) for r in good] + odd
    given = spark.createDataFrame([(*r, "x", 7.0) for r in rows], docs.schema.simpleString()[7:-1].replace(":", " ") + ", Row_ string, quality double")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF001, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = table(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES:
        before = now
        now = stored(stage(spark, now, str(tmp_path)), "test")
        assert now.columns[:len(given.columns)] == given.columns, name
        assert {r["text"] for r in now.collect()} <= {r["text"] for r in before.collect()} or name in ("mixing", "sharding")
        assert {(r["Row_"], r["quality"]) for r in now.collect()} == {("x", 7.0)}
    kept = {r["text"] for r in stored(P.near_duplicates(spark, P.quality(spark, given, str(tmp_path)), str(tmp_path)), "test").collect()}
    assert good[0]["text"] in kept and None not in kept and "" not in kept
    assert P.run(spark, str(tmp_path)).count() == now.count()


def test_run_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF001, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
