"""Quality rules and language mixture: brute force, defined results on odd rows, held-out accuracy."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from oddity.llm import language_mixture as L
from oddity.llm import quality_divergence as Q
from oddity.llm.common import table

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    seen, lines = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered)


def odd_rows():
    rnd = random.Random(3)
    long = " ".join(rnd.choice("the of and to in a that is was it".split()) + str(rnd.randrange(9)) for _ in range(60_000))
    repeat = "one two three four five six seven eight nine " * 3
    return [(1, None, None), (2, "", "en"), (3, " \t\n\x0b\x0c\r ", "en"), (4, repeat, "en"), (5, repeat, "en"), (5, repeat, "en"),
            (6, long, "en"), (7, "a a a a a a a a a a a a a a a a a a a a a a", None), (8, "x\nx\n \nx y\nx y\n", "xx"),
            (9, "%%% ### &&&" * 40, "en"), (None, "ünïcödé " * 30, "de"), (10, " wide blank " * 12, "fr")]


def test_base_metrics_equal_brute_force_on_odd_rows(spark):
    d = spark.createDataFrame([(i, t, lang, 0) for i, t, lang in odd_rows()], "doc_id long, text string, lang string, quality int")
    judged, name = Q.judge(d)
    assert name.lower() != "quality" and set(d.columns) < set(judged.columns)
    rows = judged.select("text", "doc_id", f"{name}.*").collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        want = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_keeps_prose_and_drops_symbols(spark):
    docs = table(spark, SF001, "documents")
    kept = {r["doc_id"] for r in Q.keep_good(docs).select("doc_id").collect()}
    bad = symbols = good = 0
    for r in docs.collect():
        m = base(r["text"])
        if m[0] < 20 or 100 * m[4] > 30 * m[0]:
            bad += r["doc_id"] in kept
        elif m[2] > 0.03 * len(r["text"]) and m[0] > 60:
            symbols += r["doc_id"] in kept
        elif m[2] == 0 and m[4] == 0 and m[0] > 60:
            good += r["doc_id"] not in kept
    assert bad == 0 and symbols == 0 and good <= 2


def test_texts_are_measured_once_in_the_plan(spark):
    docs = table(spark, SF001, "documents")
    plan = Q.keep_good(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3 and plan.count("regexp_replace(") <= len(Q.CLASSES)


def test_a_language_without_a_word_list_is_judged_by_its_own_classes(spark):
    rnd = random.Random(2)
    prose = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(150)) + "."
    rows = [(k, prose("абвгдежзиклмнопрстуя"), "ru", 1) for k in range(20)] + [(k, prose("etaoinshrdlu"), "en", 2) for k in range(20, 40)]
    d = spark.createDataFrame([*rows, (40, "%&# $* " * 150, "ru", 3)], "doc_id long, text string, lang string, label_ int")
    kept = {r["doc_id"] for r in Q.keep_good(d).collect()}
    judged, name = Q.judge(d)
    assert set(range(20)) <= kept and 40 not in kept and judged.columns == [*d.columns, name]
    assert {r["doc_id"] for r in judged.where(f"{name}.kept").collect()} == kept


def test_quality_of_an_empty_table_and_without_languages(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.keep_good(d).count() == 0
    d = spark.createDataFrame([(1, "some words " * 30 + "and more of them", None)], "doc_id long, text string, lang string")
    judged, name = Q.judge(d)
    assert judged.select(f"{name}.class_distance").first()[0] is None


def test_distance_is_zero_for_the_reference_and_one_for_another(spark):
    one = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (3, 1, 0)]).alias("c"))
    assert abs(one.select(Q.js_distance(F.col("c"), [30, 10, 0])).first()[0]) < 1e-7
    assert abs(one.select(Q.js_distance(F.col("c"), [0, 0, 5])).first()[0] - 1) < 1e-9


def test_language_of_rows_held_out(spark):
    out = {r["doc_id"]: r for r in L.op2_language_mixture(spark, SF001).collect()}
    true = {r["doc_id"]: r["lang"] for r in table(spark, SF001, "documents").collect()}
    held = [i for i, r in out.items() if r["held_out"]]
    assert set(out) == set(true) and held
    assert sum(out[i]["lang_pred"] == true[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_mixture_and_odd_rows(spark):
    docs = table(spark, SF001, "documents")
    model = L.learn(docs)
    by = {k: " ".join(r["text"] for r in docs.where(F.col("lang") == k).limit(6).collect())[:3000] for k in ("en", "de")}
    d = spark.createDataFrame([(1, by["en"] + " " + by["de"]), (2, None), (3, ""), (4, "12 34 !"), (5, by["de"]), (5, by["de"]),
                               (6, by["en"] * 100)], "score long, text string")
    out, names = L.predict(d, model, ("score",))
    assert out.columns == ["score", "lang_pred", "_score", "languages"] and names["score"] == "_score"
    rows = out.toDF("id", "lang_pred", "score", "languages").collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == 7 and {x.split(":")[0] for x in got[1]["languages"].split()} == {"en", "de"} and 0.3 < got[1]["score"] < 0.7
    assert [got[k]["lang_pred"] for k in (2, 3, 4)] == ["und"] * 3 and got[2]["score"] == 0
    assert got[5]["lang_pred"] == "de" and got[6]["lang_pred"] == "en"


def test_inference_equals_a_plain_computation():
    rnd = random.Random(4)
    letters = {"aa": "etaoin", "bb": "xyzwqk", "cc": "etxyao"}
    word = lambda k: "".join(rnd.choice(letters[k]) for _ in range(rnd.randrange(2, 8)))
    texts = {k: " ".join(word(k) for _ in range(400)) for k in letters}
    counts = {k: Counter(L.cells(t).tolist()) for k, t in texts.items()}
    model = L.Mixture({k: (np.array(list(c)), np.array(list(c.values()))) for k, c in counts.items()})
    logs = {k: [math.log((c.get(x, 0) + L.SMOOTHING) / (sum(c.values()) + L.SMOOTHING * L.BUCKETS)) for x in range(L.BUCKETS)]
            for k, c in counts.items()}

    def em(n, langs):
        pi = {k: 1 / len(langs) for k in langs}
        for _ in range(L.STEPS):
            new = dict.fromkeys(langs, 0.0)
            for x, c in n.items():
                p = {k: pi[k] * math.exp(logs[k][x]) for k in langs}
                for k in langs:
                    new[k] += c * p[k] / sum(p.values())
            pi = {k: v / sum(n.values()) for k, v in new.items()}
        return pi, sum(c * math.log(sum(pi[k] * math.exp(logs[k][x]) for k in langs)) for x, c in n.items())

    for langs in (("aa",), ("bb",), ("aa", "bb"), ("aa", "cc"), ("aa", "bb", "cc")):
        text = " ".join(word(rnd.choice(langs)) for _ in range(60))
        n = Counter(L.cells(text).tolist())
        order = [k for k in sorted(letters, key=lambda k: -em(n, sorted(letters))[0][k]) if em(n, sorted(letters))[0][k] >= L.LEAST_SHARE]
        values = [em(n, order[:size])[1] / 3 - 0.5 * (2 * size - 1) * math.log(max(sum(n.values()) / 3, 2)) for size in range(1, len(order) + 1)]
        size = next((k for k in range(1, len(values)) if values[k] <= values[k - 1]), len(values))
        want, got = em(n, order[:size])[0], model.infer(L.cells(text))
        assert {k for k, _ in got} == set(want) and all(abs(s - want[k]) < 1e-4 for k, s in got)


def test_language_without_training_rows(spark):
    d = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert L.learn(d) is None
    assert L.predict(d, None, ("doc_id",))[0].first()["lang_pred"] == "und"
    assert L.predict(d.limit(0), None, ("doc_id",))[0].count() == 0
