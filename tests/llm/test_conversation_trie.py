"""The prefix trie of conversations against brute force over all prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from oddity.llm import conversation_trie as C
from oddity.llm.common import table

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """Rows of all nodes, from conv -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) if children[p] else 1
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = own + sum(saved[c] for c in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], digest(p))
                  for p, m in members.items())


def rows(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NAMES) for r in df.collect())


def rebuild(turns):
    """conv -> turns, by the rule of the query; ``turns`` are (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), (r or "", x or "")))
    own = {c: [x for *_, x in sorted(v)] for c, v in own.items() if c is not None}
    out = {}
    for c, p in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + p[h:]
    return out


def trie(spark, turns):
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return rows(C.prefix_trie(*C.rebuilt(C.numbered_turns(d))))


def test_sparse_table():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        v = rnd.integers(-1, 6, n)
        m = C.Minima(v)
        i, c = np.repeat(np.arange(n), 8), np.tile(np.arange(-1, 7), n)
        left = [max([j for j in range(a) if v[j] < x], default=-1) for a, x in zip(i, c, strict=True)]
        right = [min([j for j in range(a, n) if v[j] < x], default=n) for a, x in zip(i, c, strict=True)]
        assert m.left(i, c).tolist() == left and m.right(i, c).tolist() == right
        a, b = np.meshgrid(np.arange(n + 1), np.arange(n + 1))
        a, b = a[a <= b], b[a <= b]
        assert m.between(a, b).tolist() == [int(min(v[x:y], default=C.END)) for x, y in zip(a, b, strict=True)]


def some_turns(rnd, n, base=0):
    out = []
    for c in range(base, base + n):
        for t in range(rnd.choice([0, 1, 2, 3, 4, 9])):
            out.append((c, t, rnd.choice(["u", "u", "a"]), rnd.choice(["x", "x", "y y", "z z z"])))
    return out


def test_nodes_equal_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 2)
    rnd = random.Random(8)
    for block in (1, 16, 1 << 14):
        monkeypatch.setattr(C, "BLOCK", block)
        turns = some_turns(rnd, 70, -25)
        assert trie(spark, turns) == brute(rebuild(turns))


def test_hot_turns_and_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    monkeypatch.setattr(C, "BLOCK", 8)
    monkeypatch.setattr(C, "PIECE_BITS", 3)
    turns = [(c, t, "u", f"same {t}") for c in range(300) for t in range(6)]
    turns += [(c, t, "u", "first" if t < 9 else f"{c % 7} {t}") for c in range(300, 340) for t in range(12)]
    turns += [(900, t, "a", f"long {t}") for t in range(70)]
    turns += [(901, t, "a", f"long {t if t < 60 else -t}") for t in range(70)]
    assert trie(spark, turns) == brute(rebuild(turns))


def test_odd_rows(spark):
    turns = [(None, 0, "u", "nobody"), (1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (2, 5, None, "a " * 5000), (2, 5, "a", "tie"),
             (3, 1, "u", "w"), (3, 1, "u", "w"), (3, 1, "v", "w"), (20, 1, "u", "base"), (21, 1, "u", "x"), (21, 2, None, "\n"), (-21, 1, "é", "ü")]
    assert trie(spark, turns) == brute(rebuild(turns))
    assert trie(spark, [(7, 0, "u", "alone")]) == brute(rebuild([(7, 0, "u", "alone")]))
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    named = d.select("*", F.lit(1).alias("at"), F.lit("x").alias("Words"), F.lit(2).alias("id"), F.lit(3).alias("conv"))
    assert rows(C.prefix_trie(*C.rebuilt(C.numbered_turns(named)))) == brute(rebuild(turns))


def test_empty_table(spark):
    assert trie(spark, []) == []


def test_query_equals_brute_force(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, SF001, "conversations").collect()]
    out = C.op12_conversation_trie(spark, SF001)
    assert out.columns == NAMES and rows(out) == brute(rebuild(turns))
