"""Near-duplicates and benchmark passages against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np

from oddity.llm import hyperminhash_dedup as H
from oddity.llm import qgram_decontamination as D
from oddity.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def components(rows, k, percent):
    sets, parent = {i: sets_of(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioubcdst") for _ in range(rnd.randrange(2, 7)))
    rows, n = [], 0
    for family in range(14):
        body = [word() for _ in range(rnd.choice([2, 6, 12, 40, 200, 900]))]
        for copy in range(rnd.choice([1, 3, 8, 30])):
            w = list(body)
            for _ in range(rnd.randrange(0, max(1, len(w) // 25) + 1)):
                w[rnd.randrange(len(w))] = word()
            text = (" " if copy % 2 else "\n").join(w)
            rows.append((n, text.upper() if copy == 1 else text))
            n += 1
    line = " all rights reserved by the owner of this page"
    rows += [(n + k, " ".join(word() for _ in range(rnd.randrange(3, 25))) + line) for k in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "two words"), (5006, "two words")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, cls long, registers string")
    for k, percent in ((3, 85), (5, 80)):
        got = {r["key"]: (r["n"], r["component"]) for r in H.near_duplicates(d, words=k, percent=percent).collect()}
        assert got == components(rows, k, percent)


def test_keep_one_of_each_group_with_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", None), (1, "a b c d e f g", None), (None, "A B C D E F G", "x"), (2, None, "x"),
                               (3, None, "x"), (4, "h i j k l m n", "x")], "doc_id long, text string, row_ string")
    out = H.keep_one(d)
    assert out.columns == d.columns
    texts = [r["text"] for r in out.collect()]
    assert len(texts) == 4 and texts.count(None) == 2
    assert H.keep_one(d.limit(0)).count() == 0
    assert H.near_duplicates(d.limit(0)).count() == 0


def test_estimate_follows_the_true_similarity():
    rnd = np.random.default_rng(1)
    for true in (0.3, 0.6, 0.85, 0.95):
        n, found = 1500, []
        common = int(2 * n * true / (1 + true))
        for _ in range(30):
            h = np.unique(rnd.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64))
            rnd.shuffle(h)
            a, b = np.sort(h[:n]), np.sort(h[len(h) - n:])
            j, total = H.estimate(H.registers(a)[None], H.registers(b)[None], np.array([float(n)]), np.array([float(n)]))
            found.append(j[0])
        assert abs(np.mean(found) - true) < 0.04


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)] + [("s0", f"s{k}") for k in range(1, 50)]
    got = dict(connected(spark.createDataFrame(pairs, "a string, b string")).collect())
    assert {got[f"c{k:03}"] for k in range(41)} == {"c000"} and {got[f"s{k}"] for k in range(50)} == {"s0"}


def edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def passage(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def spoiled(rnd, text, n):
    s = list(text)
    for _ in range(n):
        p = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        s[p:p + 1] = [] if kind == 0 else [rnd.choice("xyz")] if kind == 1 else [s[p], rnd.choice("xyz")]
    return "".join(s)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    items = [(k, passage(rnd, rnd.randrange(12, 50))) for k in range(12)] + [(90, None), (91, ""), (92, "tiny"), (93, passage(rnd, 20).upper())]
    docs = [(0, None), (1, ""), (2, passage(rnd, 300))]
    for k, t in items:
        for share in (0, 0.05, 0.09, 0.2, 0.4) if t and len(t) > 20 else ():
            body = spoiled(rnd, t, int(share * len(t)))
            docs.append((len(docs), f"{passage(rnd, 40)} \n {body}  {passage(rnd, 40)}"))
        if t and len(t) > 20:
            docs.append((len(docs), passage(rnd, 30) + " " + t[:len(t) // 2]))
    docs.append((len(docs), passage(rnd, 9000) + " " + items[0][1] + " " + passage(rnd, 9000)))
    want = set()
    for i, x in docs:
        for k, t in items:
            a, b = D.normal(t or ""), D.normal(x or "")
            if len(a) >= D.Q and b:
                most = min(int(len(a) * D.EDIT_SHARE), (len(a) - D.Q) // D.Q)
                near = b if len(b) < 5000 else b[b.find(a) - 50:b.find(a) + len(a) + 50] if a in b else ""
                if near and edits(a, near) <= most:
                    want.add((i, k))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, edits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    text, item = dict(docs), dict(items)
    for r in found:
        a, span = D.normal(item[r["item_id"]]), D.normal(text[r["doc_id"]][r["start"]:r["end"]])
        assert abs(len(a) - len(span)) <= r["edits"] and edits(a, span) <= r["edits"]
    kept = D.drop_leaks(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_counting_in_slices_finds_the_same_bands(monkeypatch):
    rnd = random.Random(4)
    items = [(k, "".join(rnd.choice("ab ") for _ in range(rnd.randrange(20, 300)))) for k in range(12)] + [(50, "ab" * 90), (51, "a" * 200)]
    texts = ["".join(rnd.choice("ab ") for _ in range(900)) + items[3][1] + "ab" * 200, "a" * 900, items[5][1] * 3, "no"]
    index = D.Index(items)
    whole = [(index.bands(D.codes(D.normal(t))), index.matches(t)) for t in texts]
    assert sum(len(b) for b, _ in whole) > 20 and any(m for _, m in whole)
    for entries in (1, 300):
        monkeypatch.setattr(D, "ENTRIES", entries)
        assert [(index.bands(D.codes(D.normal(t))), index.matches(t)) for t in texts] == whole


def test_repetitive_texts_and_items_need_little_memory():
    index = D.Index([(1, "ab" * 500), (2, "ab" * 400 + "c")])
    tracemalloc.start()
    found = index.matches("ab" * 30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {k for k, *_ in found} == {0, 1} and peak < 300e6


def test_names_of_both_keys_may_be_equal(spark):
    docs = spark.createDataFrame([(1, "x" * 5 + "the quick brown fox jumps over"), (2, None)], "start long, text string")
    out = D.find_leaks(docs, spark.createDataFrame([(7, "the quick brown fox jumps over")], "start long, text string"),
                       key="start", item_key="start").collect()
    assert [tuple(r) for r in out] == [(1, 7, 5, 35, 0)] and out[0].__fields__ == ["_start", "__start", "start", "end", "edits"]


def test_leaks_in_blocks_and_empty_tables(spark):
    rnd = random.Random(2)
    items = [(k, passage(rnd, 20)) for k in range(6)]
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert sum(1 for _ in D.blocks_of(b, "item_id", "text", chars=250)) > 1
    d = spark.createDataFrame([(1, items[3][1]), (1, items[3][1])], "doc_id long, text string")
    assert D.find_leaks(d, b).count() == 2
    assert D.find_leaks(d.limit(0), b).count() == 0 and D.find_leaks(d, b.limit(0)).count() == 0
    assert D.drop_leaks(d, b.limit(0)).count() == 2


def test_near_copies_without_keys_are_linked(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words, x]) for x in ("a", "b")]
    other = " ".join(f"x{k}" for k in range(60))
    d = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (5, texts[1]), (None, other), (None, other + " y")], "doc_id long, text string")
    rows = H.near_duplicates(d).collect()
    assert sorted((r["key"] or 0, r["component"] or 0) for r in rows) == [(0, 0), (0, 0), (0, 5), (0, 5), (5, 5)]
