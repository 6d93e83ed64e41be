"""Mixing, sharding, token counts, URL templates, WARC and toxicity against brute force."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from oddity.llm import block_mixing as M
from oddity.llm import external_shuffle as S
from oddity.llm import length_histogram as H
from oddity.llm import toxicity_automata as T
from oddity.llm import url_templates as U
from oddity.llm import warc_source as W
from oddity.llm.common import shared_path, table

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None, 5), (2, "", "b", 5), (3, " \n\t", "a", 5), (4, "w " * 3000, "a", 5), (5, "x y z", "a", 5), (5, "x y z", "a", 5),
       (6, "é à " * 700, "b", 5), (None, "no id here", None, 5), (7, " lead and trail \n", "ä", 5)]
SCHEMA = "doc_id long, text string, source string, size int"


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_targets_equal_brute_force(spark):
    rnd = random.Random(4)
    for _ in range(6):
        sizes = {k: rnd.choice([0, 3, 50, 900, 20000]) for k in ["a", "b", "B", "é", "z", "src10", "src2", None][:rnd.randrange(1, 9)]}
        d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in M.targets(d).collect()}
        want = water(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 64, 1000):
        d = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), M.ROUNDS, F.lit(3), F.lit(0)).alias("p"))
        assert sorted(r["p"] for r in d.collect()) == list(range(n))


def test_mix_meets_targets_and_reruns_agree(spark):
    first = M.op6_block_mixing(spark, SF001).collect()
    docs = {r["doc_id"]: r for r in table(spark, SF001, "documents").collect()}
    assert sorted(r["doc_id"] for r in first) == sorted(docs)
    taken, sizes = Counter(), Counter()
    for r in first:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
        sizes[d["source"]] += r["size"]
    want = water(dict(sizes))
    assert all(abs(r["target"] - want[docs[r["doc_id"]]["source"]]) < 1e-6 * r["target"] + 1e-6 for r in first)
    assert all(abs(taken[s] - want[s]) <= max(2 * M.BLOCK_WORDS, 0.03 * want[s]) for s in want)
    assert sorted(map(tuple, first)) == sorted(map(tuple, M.op6_block_mixing(spark, SF001).collect()))


def hashed(*values):
    """Spark's xxhash64 of whole numbers: int if given as (int,), else long."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def image(x, n, *key):
    for r in range(1, M.ROUNDS + 1):
        y = (hashed((M.SEED,), *key, (r,)) % n - x) % n
        if hashed((M.SEED + 1,), *key, (r,), max(x, y)) % 2 == 1:
            x = y
    return x


def test_draw_and_slots_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BLOCKS", 16)
    rnd = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join("w" for _ in range(rnd.randrange(900))), rnd.choice("aab") if k % 9 else None) for k in range(60)],
                                 "doc_id long, text string, source string")
    tables = M.plan(docs, keep=("doc_id",))
    sources = sorted(tables["sources"].collect(), key=lambda r: r["s"])
    total, counts, start = sum(r["slots"] for r in sources), Counter(), 0
    for r in sources:
        counts.update((r["s"], image(start + i, total, (-1,)) // 16) for i in range(r["slots"]))
        start += r["slots"]
    got = {(r["s"], r["shard"]): (r["blocks"], r["first"]) for r in tables["draw"].collect()}
    assert {k: b for k, (b, _) in got.items()} == counts and len({j for _, j in counts}) == -(-total // 16) > 5
    assert all(sum(b for (_, x), b in counts.items() if x == j) == min(16, total - 16 * j) for _, j in counts)
    slots = Counter()
    for r in sources:
        i = 0
        for j in sorted(j for s, j in counts if s == r["s"]):
            assert got[r["s"], j][1] == i
            for _ in range(counts[r["s"], j]):
                slots[r["s"], image(i % r["blocks"], r["blocks"], (r["s"],), i // r["blocks"]), j] += 1
                i += 1
    assert Counter((r["s"], r["block"], r["shard"]) for r in tables["slots"].collect()) == slots
    # pieces: documents in the order of their hashes, cut every BLOCK_WORDS words
    words, times = Counter(), Counter()
    for (s, block, _), k in slots.items():
        times[s, block] += k
    for r in tables["pieces"].collect():
        assert 0 < r["n"] <= M.BLOCK_WORDS
        words[r["s"], r["block"]] += r["n"]
    assert all(n == M.BLOCK_WORDS or (s, b + 1) not in words for (s, b), n in words.items()) and set(times) <= set(words)


def test_mix_depends_on_the_rows_alone(spark, tmp_path):
    docs = table(spark, SF001, "documents")
    results = []
    for parts in (1, 3, 11):
        docs.repartition(parts, F.xxhash64(F.lit(parts), "doc_id")).sortWithinPartitions(F.xxhash64(F.lit(parts), "doc_id")).write.parquet(
            f"{tmp_path}/{parts}/documents.parquet")
        results.append(sorted(map(tuple, M.op6_block_mixing(spark, f"{tmp_path}/{parts}").collect())))
    assert results[0] == results[1] == results[2]
    mixes = [Counter((r["doc_id"], r["text"]) for r in M.mixed_documents(table(spark, f"{tmp_path}/{parts}", "documents")).collect())
             for parts in (1, 11)]
    assert mixes[0] == mixes[1]


def test_mixed_documents_are_pieces_of_texts(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    rows = M.mixed_documents(d).collect()
    texts = {}
    for i, t, _, _ in ODD:
        texts.setdefault(i, t)
    assert rows and all(r["text"] in texts[r["doc_id"]] and r["size"] == 5 for r in rows)
    tables = M.plan(d, keep=("doc_id",))
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    planned = M.used(tables).join(tables["rows"], "row").groupBy("kept_0").agg(F.sum(F.col("n") * F.col("times")).alias("k")).collect()
    assert words == Counter({r["kept_0"]: r["k"] for r in planned})
    counts = tables["draw"].agg(F.sum("blocks")).first()[0]
    assert counts == tables["slots"].count() and M.mixed_documents(d.limit(0)).count() == 0


def shards_hold(rows, n):
    slots = {}
    for r in rows:
        slots.setdefault(r["s"], []).append(r["p"])
        assert 0 <= r["s"] < n and r["g"] in (r["s"], n)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_gapless_and_grow_into_the_new_one(spark):
    rows = S.op7_external_shuffle(spark, SF001).select(F.col("shard").alias("s"), F.col("slot").alias("p"), F.col("grown_shard").alias("g"),
                                                       "doc_id", "size", "text_crc32", "law").collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").collect()}
    shards_hold(rows, 40)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 16 for r in rows)
    d = spark.createDataFrame(ODD, SCHEMA)
    small, n = S.external_shuffle(d, shards=5, bucket_bytes=1000)
    one = small.select(F.col(n["shard"]).alias("s"), F.col(n["slot"]).alias("p"), F.col(n["grown"]).alias("g"), "doc_id", "text").collect()
    shards_hold(one, 5)
    more, m = S.external_shuffle(d, shards=6, bucket_bytes=1000)
    grown = {(r["doc_id"], r["text"]): r["s"] for r in more.select("doc_id", "text", F.col(m["shard"]).alias("s")).collect()}
    assert len(one) == len(ODD) and all(grown[r["doc_id"], r["text"]] == r["g"] for r in one)
    again = small.select(F.col(n["shard"]).alias("s"), F.col(n["slot"]).alias("p"), "doc_id").collect()
    assert sorted((r["s"], r["p"], str(r["doc_id"])) for r in again) == sorted((r["s"], r["p"], str(r["doc_id"])) for r in one)
    assert S.external_shuffle(d.limit(0))[0].count() == 0


def test_shards_equal_brute_force(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    placed, n = S.external_shuffle(d, shards=7)
    key = lambda i: xxhash.xxh64_intdigest(str(i).encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for r in placed.collect():
        best = lambda most, k=signed(key(r["doc_id"])): max(range(most), key=lambda s: hashed((S.SEED,), k, (s,)))
        assert (r[n["shard"]], r[n["grown"]]) == (best(7), best(8))


def test_permutations_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWN", 2)
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    of = lambda x: {r["doc_id"]: (r["shard"], r["slot"], r["bucket"]) for r in S.external_shuffle(x, shards=5, bucket_bytes=400)[0].collect()}
    first = of(d)
    assert first == of(d.repartition(7)) and len({b for _, _, b in first.values()}) > 10
    by_bucket = {}
    for i, (s, slot, b) in first.items():
        by_bucket.setdefault((s, b), []).append((slot, i))
    # the records of a bucket lie together, and not in the order of their ids
    assert all([x for x, _ in sorted(v)] == list(range(min(v)[0], min(v)[0] + len(v))) for v in by_bucket.values())
    assert sum([i for _, i in sorted(v)] == sorted(i for _, i in v) for v in by_bucket.values()) < len(by_bucket) / 2


def test_written_shards_hold_every_record(spark):
    path = shared_path(spark, "shards")
    S.write_shards(spark.createDataFrame(ODD, SCHEMA), path, shards=3)
    assert spark.read.parquet(path).count() == len(ODD)


def test_length_histogram_equals_brute_force(spark):
    d = spark.createDataFrame([*ODD, (9, "<|endoftext|> it's 100% naïve\n\n  ok", "b", 1)], SCHEMA)
    encode = H.encoder(H.VOCABULARY, H.PATTERN).encode_ordinary
    texts = [r["text"] for r in d.collect()]
    n = [len(encode(t)) if t else 0 for t in texts]
    h = H.length_histogram(d).cache()
    rows = {r["length"]: r for r in h.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert (r["docs"], r["docs_from"], r["tokens_from"], r["truncated_tokens"]) == (
            n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(min(y, x) for y in n))
    for r in H.at_limits(h, [1, 4, 100, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(y, r["limit"]) for y in n) and r["docs_cut"] == sum(y > r["limit"] for y in n)
    q = {r["share"]: r["length"] for r in H.quantiles(h, [0.5, 1.0]).collect()}
    assert q[1.0] == max(n) and q[0.5] == sorted(n)[(len(n) + 1) // 2 - 1]
    by = H.length_histogram(d, by=("source",)).where("source is null").agg(F.sum("docs")).first()[0]
    assert by == 2 and H.length_histogram(d.limit(0)).count() == 0


URLS = [None, "", "no scheme/net/", "http://", "HTTP://A.Example.NET/en/1", "http://net", "http://net/", "http://xnet/a", "ftp://b.net?x=/en/",
        "http://example.net/en", "http://example.net/en/#/de/", "https://www.example.com/de/7.html?a#b", "https://example.com/DE/",
        "http://a.org/fr/", "http://example.org#/fr/", "x://y://z.net/", "http://Ä.net/ä/1", "http://a.net\n/b"]


def judged_by_rules(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), v, r) for v, r in U.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1:] if fits else None


def test_histogram_groups_with_names_of_results(spark):
    d = spark.createDataFrame([("x", "a b"), ("x", None), (None, "a b c")], "length string, text string")
    out = H.length_histogram(d, by=("length",))
    assert out.columns == ["_length", *H.RESULTS] and {(r["_length"], r["docs"]) for r in out.collect()} == {("x", 1), (None, 1)}


def test_url_rules_equal_brute_force(spark):
    d = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, url_ string")
    judged, name = U.judge(d)
    rows = judged.select("url", "url_", f"{name}.*").collect()
    assert len(rows) == len(URLS) + 1 and U.judge(d.limit(0))[0].count() == 0
    for r in rows:
        host, path, rule = judged_by_rules(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] == (rule[0] if rule else "allow")


def level_by_level(leaves, prior):
    """The template of every (host, path), one level of the tree at a time; leaves map them to (pages, labelled, blocked)."""
    template, depth = {k: "" for k in leaves}, 0
    bin_of = lambda b, n: -1 if n < U.LEAST_LABELLED else math.floor(
        math.asin(math.sqrt((b + U.PRIOR_PAGES * prior) / (n + U.PRIOR_PAGES))) * 2 * U.BIN_PAGES ** 0.5)
    while any(len(p) > depth for _, p in leaves):
        nodes = {}
        for (host, p), counts in leaves.items():
            if len(p) > depth:
                node = nodes.setdefault((host, template[host, p], p[depth]), [0, 0, 0, False])
                for k in range(3):
                    node[k] += counts[k]
                node[3] |= len(p) > depth + 1
        named = {}
        for host, parent in {k[:2] for k in nodes}:
            below = {k[2]: v for k, v in nodes.items() if k[:2] == (host, parent)}
            wide = len(below) > U.CHILDREN and sum(v[0] for v in below.values()) < U.PAGES_EACH * len(below)
            classes = {}
            for segment, (_, n, b, inner) in below.items():
                classes.setdefault("*" if wide else (bin_of(b, n), inner), []).append(segment)
            for c, members in classes.items():
                name = "*" if c == "*" else min(members) + "~" if len(members) > 1 else members[0]
                named.update({(host, parent, x): f"{parent}/{name}" for x in members})
        template = {(h, p): named[h, t, p[depth]] if len(p) > depth else t for (h, p), t in template.items()}
        depth += 1
    return template


def test_templates_equal_brute_force_level_by_level(spark):
    rnd = random.Random(11)
    leaves = {}
    for _ in range(500):
        path = tuple(rnd.choice("abcdef"[:rnd.choice([1, 2, 6])]) for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])))
        n = rnd.choice([0, 0, 1, 7, 40])
        leaves[rnd.choice(["x.com", "y.net"]), path] = (max(1, n) + rnd.randrange(3), n, round(n * rnd.choice([0, 0.5, 1])))
    leaves |= {("wide.org", ("s", f"p{k}", "end")): (1, 0, 0) for k in range(50)}
    d = spark.createDataFrame([(h, list(p), *c) for (h, p), c in leaves.items()],
                              "host string, first array<string>, pages long, labelled long, blocked long")
    got = {(r["host"], tuple(r["first"])): r["template"] for r in U.template_tree(d, 0.3).collect()}
    assert got == level_by_level(leaves, 0.3)


def test_paths_of_thousands_of_segments_take_few_rounds(spark, monkeypatch):
    deep = [str(k) for k in range(2000)]
    paths = [("h", p) for p in (["a"], deep, [*deep, "x"], [*deep, "y", "z"], deep[:900])] + [("i", ["c"] * k) for k in range(40)]
    d = spark.createDataFrame([(h, p, 1, 0, 0) for h, p in paths], "host string, first array<string>, pages long, labelled long, blocked long")
    rounds, was = [], U.stored
    monkeypatch.setattr(U, "stored", lambda df, name: rounds.append(name) or was(df, name))
    got = {(r["host"], tuple(r["first"])): r["template"] for r in U.template_tree(d, 0.5).collect()}
    assert len(rounds) <= 4 and got == level_by_level({(h, tuple(p)): (1, 0, 0) for h, p in paths}, 0.5)


def test_templates_generalise_and_are_rejected_by_purity(spark):
    urls = [f"http://s.com/p/{w}-{k}/x{k}.html" for k in range(60) for w in ("aa", "bb")]  # many unlike names: one wildcard
    urls += [f"http://s.com/ads/{k}" for k in range(40)] + [f"http://s.com/news/{k}" for k in range(40)]
    d = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rules = [("block", "s.com/ads/1"), ("allow", "s.com/news/1")]
    judged, name = U.judge(d, rules=rules)
    rows = [r for r in judged.select("url", f"{name}.*").collect()]
    of = lambda part: [r for r in rows if part in r["url"]]
    assert len({r["template"] for r in of("/p/")}) <= 2 and all("*" in r["template"] for r in of("/p/"))
    assert {r["verdict"] for r in of("/ads/")} == {"block"} and any(r["rule"] is None for r in of("/ads/"))
    assert {r["verdict"] for r in of("/news/")} == {"allow"} and {r["verdict"] for r in of("/p/")} == {"allow"}


def test_archives_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    pages = [(1, "http://a/1", "same"), (9, "http://a/9", "same"), (4, "http://a/4", "same"), (2, None, None), (3, "http://ü/\r\nx", tricky),
             (5, "http://b", "é" * 70_000), (6, "u", ""), (7, "u", "x\n\r"), (7, "u", "x\n\r")]
    d = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, key string")
    for least in (0, 5):
        path = shared_path(spark, "warc")
        W.write_archives(d, path, least_bytes=least)
        rows = W.read_archives(spark, path, payload="text").collect()
        assert len(rows) == len(pages)
        for r in rows:
            k = int(r["page_id"])
            body = next((h or "") for i, _, h in pages if i == k)
            top = max(i for i, _, h in pages if (h or "") == body)
            again = top != k and len(body.encode()) >= least
            assert r["record_type"] == ("revisit" if again else "response")
            assert r["refers_to"] == (f"<urn:x-page:{top}>" if again else None)
            assert r["payload"] == ("" if again else body) and r["payload_bytes"] == len(body.encode())
            assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    path = shared_path(spark, "warc")
    W.write_archives(d, path)
    found = W.read_archives(spark, path, payload="none").where("record_type = 'revisit' and page_id in ('1', '2', '4')")
    assert sorted(r["page_id"] for r in found.collect()) == ["1", "2", "4"] and found.where("payload is not null").count() == 0
    assert W.read_archives(spark, path, types="revisit").count() == 3
    W.write_archives(d.limit(0), path := shared_path(spark, "warc"))
    assert W.read_archives(spark, path).count() == 0


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    rnd = random.Random(6)
    terms = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(2, 11))): 1.0 for _ in range(25)} | {"dcba*": 2.0}
    machine = T.Automaton(terms)
    for _ in range(3000):
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 11)))
        fits = [edits(t, w) for t in terms if not t.endswith("*") and edits(t, w) <= T.allowed(t)] + [0] * w.startswith("dcba")
        found = machine.match(w)
        assert (found is None) == (not fits) and (not fits or found[1] == min(fits))


def test_quotation_and_address_change_the_features():
    s = T.Scorer({"grobnik": 3.0})
    of = lambda *texts: s.features(pa.array(texts, pa.string())).tolist()
    kinds = [f[:3] for f in of("you are a grobnik", 'he wrote "grobnik" there', "a gr0bnik, sure", "all is well", "", None)]
    assert [[x > 0 for x in k] for k in kinds] == [[1, 0, 0], [1, 0, 1], [1, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert kinds[0][0] > kinds[2][0] > kinds[1][0]
    assert [f[6] for f in of("you are a grobnik", "a grobnik", None)] == [1, 0, 0]


def test_sieve_lets_every_fitting_word_pass():
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(n)))
    terms = {w: 1.0 for w in (word(12) for _ in range(40)) if w} | {"dcba*": 2.0, "ab*": 1.0}
    sieve, words = T.Sieve(terms), [word(14) for _ in range(3000)]
    passed = {words[k] for k in sieve.passing(pa.array(words)).tolist()}
    fits = {w for w in words if w.startswith(("dcba", "ab")) or any(
        not t.endswith("*") and abs(len(t) - len(w)) < 3 and edits(t, w) <= T.allowed(t) for t in terms)}
    assert fits <= passed
    others = ["".join(rnd.choice("vwxyz") for _ in range(rnd.randrange(3, 12))) for _ in range(5000)]
    assert len(sieve.passing(pa.array(others))) < 500
    assert len(T.Sieve({}).passing(pa.array(words))) == 0 and len(sieve.passing(pa.array([], pa.string()))) == 0


def test_features_do_not_depend_on_slices(monkeypatch):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice(["you", "gr0bnik", '"grobnik"', "zwackel,", "all", "well"]) for _ in range(rnd.randrange(20))) for _ in range(60)]
    whole = T.Scorer({"grobnik": 3.0, "zwackel": 2.0}).features(pa.array(texts))
    monkeypatch.setattr(T, "PART", 50)
    assert (T.Scorer({"grobnik": 3.0, "zwackel": 2.0}).features(pa.array(texts)) == whole).all() and whole[:, 0].max() > 0


def test_toxicity_is_learned_and_found_when_misspelled(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(3, 8)))
    rows, labels = [], []
    for k in range(600):
        w = [word() for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            w.insert(rnd.randrange(30), rnd.choice(["grobnik", "zwackel"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    test = [(1, " ".join(word() for _ in range(20)) + " you gr0bnik"), (2, "zwakcel " + " ".join(word() for _ in range(20))),
            (3, " ".join(word() for _ in range(40))), (4, None), (5, ""), (6, "grobnik"), (6, "grobnik"), (7, "aeiou " * 50_000)]
    d = spark.createDataFrame([(i, t, 3.0) for i, t in test], "doc_id long, text string, features double")
    got = {r["doc_id"]: r for r in T.score(d, model, ("doc_id",))[0].collect()}
    assert {i for i, r in got.items() if r["predicted"]} == {1, 2, 6} and all(0 <= r["score"] <= 1 for r in got.values())
    none = T.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(d, none, ("doc_id",))[0].agg(F.max("score")).first()[0] < 0.01
    assert T.score(d.limit(0), model, ("doc_id",))[0].count() == 0
    clash = d.withColumn("Score", F.lit("x")).withColumn("predicted", F.lit(7))
    out, names = T.score(clash, model, ("doc_id", "features", "Score", "predicted"))
    assert out.columns == ["doc_id", "features", "Score", "predicted", "_score", "_predicted"] and names["score"] == "_score"
    assert {(r["features"], r["Score"], r["predicted"]) for r in out.collect()} == {(3.0, "x", 7)}


def test_toxicity_of_rows_held_out(spark):
    out = T.op8_toxicity_automata(spark, "/root/testdata/sf0.01").where("held_out").collect()
    label = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    pairs = [(r["score"], label[r["doc_id"]]) for r in out if r["doc_id"] in label]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.8


def test_rare_terms_are_kept_in_large_samples_and_words_of_near_copies_are_not(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(4, 9)))
    base = [word() for _ in range(60)] + ["kopierwort"]
    rows = [(k, " ".join(word() for _ in range(12)) + (" grobnik" if k < 12 else "")) for k in range(800)]
    rows += [(1000 + k, " ".join([*base, f"n{k}"])) for k in range(40)]  # near copies of one text
    rows += [(2000 + k, " ".join(word() for _ in range(12))) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _ in rows], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    assert "grobnik" in model[0] and "kopierwort" not in model[0]
    got = T.score(spark.createDataFrame([(1, "das gr0bnik da"), (2, "das haus da")], "doc_id long, text string"), model, ("doc_id",))[0]
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert score[1] > score[2]


def test_misspelled_members_of_a_learned_family_are_found():
    toxic = {"idiot": 60, "idiots": 60, "idiotic": 60, "idio*": 180, "idiot*": 180, "idioti*": 60}
    terms = T.choose_terms(toxic, {}, 400, 400)
    machine = T.Automaton(terms)
    fits = lambda w: (found := machine.match(w)) and found[1]
    assert "idio*" in terms and [fits(w) for w in ("idiot", "idiocy", "idoit", "ldiot", "idotic")] == [0, 0, 1, 1, 1]
    assert [fits(w) for w in ("audio", "ido", "idol", "iidiocy")] == [None] * 4


def test_automaton_with_words_beside_their_beginnings_equals_edit_distance():
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 11))) for _ in range(20)}
    stems = {w[:4] for w in list(words)[:8]}
    machine = T.Automaton(dict.fromkeys(words, 1.0) | {s + "*": 2.0 for s in stems})
    for _ in range(3000):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12)))
        fits = [edits(t, w) for t in words if edits(t, w) <= T.allowed(t)] + [0] * (w[:4] in stems)
        found = machine.match(w)
        assert (found is None) == (not fits) and (not fits or found[1] == min(fits))


def test_archives_keep_both_payloads_of_a_repeated_page(spark):
    pages = [(1, "u", "first"), (1, "u", "second"), (2, "v", "first"), (3, "w", "third"), (3, "w", "fourth"), (4, "x", "third"), (5, "y", "fourth")]
    W.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path := shared_path(spark, "warc"))
    rows = W.read_archives(spark, path, payload="text").collect()
    got = sorted((int(r["page_id"]), r["record_type"], r["refers_to"] or r["payload"]) for r in rows)
    page = "<urn:x-page:{}>".format
    assert got == [(1, "response", "second"), (1, "revisit", page(2)), (2, "response", "first"), (3, "revisit", page(4)),
                   (3, "revisit", page(5)), (4, "response", "third"), (5, "response", "fourth")]


def test_deep_paths_are_split_by_their_deep_segments(spark):
    urls = [f"http://s.com/a/b/c/d/{w}/{k}" for w in ("ads", "news") for k in range(40)]
    rules = [("block", "s.com/a/b/c/d/ads/1"), ("allow", "s.com/a/b/c/d/news/1")]
    judged, name = U.judge(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), rules=rules)
    rows = judged.select("url", f"{name}.verdict").collect()
    assert {(("ads" in r["url"]), r["verdict"]) for r in rows} == {(True, "block"), (False, "allow")}
