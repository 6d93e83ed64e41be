"""Personal data: strict entities, contexts and the scored graph against brute force."""

from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import regex as re
from pyspark.sql import functions as F

from oddity.llm import contextual_pii as P
from oddity.llm.common import table

SF001 = "/root/testdata/sf0.001"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
AT = r"(?<![^\s<>()\[\],;:\"'])[^\s<>()\[\],;:\"'@]+(?:@| ?[\[(]at[\])] ?)[^\s<>()\[\],;:\"'@]+"
NUMBER = r"(?<![\p{L}0-9_])[+(]{0,2}[0-9](?:[\x20().,-]{0,3}[0-9])*[\p{L}_]*"
QUAD = r"[0-9]{1,3}(?:[\x20.,-]{1,3}[0-9]{1,3}){3}"


def only_digits(t):
    return re.sub("[^0-9]", "", t)


def fits(kind, v):
    d = only_digits(v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(t):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(PLAIN[kind], t) if fits(kind, m[0]))


def contexts(t, found):
    """(start, end, value, patterns) of the matches of one pattern, in order."""
    out = []
    for i, m in enumerate(found):
        left = t[found[i - 1].end() if i else 0:m.start()][-P.CONTEXT_CHARS:]
        right = t[m.end():found[i + 1].start() if i + 1 < len(found) else len(t)][:P.CONTEXT_CHARS]
        a, b = [re.sub("[0-9]+", "0", x.lower()).split() for x in (("0 " if i else "") + left, right)]
        w = ["^", "^", *a]
        out.append((m.start(), m.end(), m[0], {f"{w[-2]} {w[-1]} _", f"{w[-1]} _ {b[0] if b else '$'}", f"{w[-1]} _"}))
    return out


def name(v):
    return v.lower() if "@" in v or re.search(r"[\[(]at[\])]", v) else only_digits(v)


def shapes(v):
    n, at, quad = len(only_digits(v)), "@" in v or bool(re.search(r"[\[(]at[\])]", v)), bool(re.fullmatch(QUAD, v))
    return [at, not at and quad, not at and 12 <= n <= 19, not at and 7 <= n <= 15 and not quad]


def brute(texts):
    """(base, all spans) of every text, the graph scored with dictionaries."""
    bases, loose, known, might, edges = [], [], {}, defaultdict(set), defaultdict(set)
    for t in texts:
        bases.append(base(t))
        for k, kind in enumerate(P.KINDS):
            for _, _, v, ps in [x for x in contexts(t, list(re.finditer(PLAIN[kind], t))) if fits(kind, x[2])]:
                known[name(v)] = min(k, known.get(name(v), k))
                for p in ps:
                    edges[p].add(name(v))
        mine = [x for x in contexts(t, list(re.finditer(AT, t))) if not re.search(PLAIN["email"], x[2])]
        mine += [x for x in contexts(t, list(re.finditer(NUMBER, t))) if re.fullmatch(QUAD, x[2]) or (
            7 <= len(only_digits(x[2])) <= 19 and not re.search(r"[\p{L}_]$", x[2]))]
        loose.append(mine)
        for _, _, v, ps in mine:
            might[name(v)] |= {k for k, ok in enumerate(shapes(v)) if ok}
            for p in ps:
                edges[p].add(name(v))
    belief = {i: (k, 1.0) for i, k in known.items()}
    for _ in range(P.ROUNDS):
        score = {}
        for p, ids in edges.items():
            s, k = max((sum(belief[i][1] for i in ids if i in belief and belief[i][0] == k), -k) for k in range(4))
            against = sum(belief[i][0] != -k if i in belief else -k not in might[i] for i in ids)
            unknown = sum(i not in belief and -k in might[i] for i in ids)
            if s >= P.SUPPORT and s >= P.SHARE * (s + unknown) and s / (s + against + P.PRIOR) >= P.MIN_SCORE:
                score[p] = (-k, s / (s + against + P.PRIOR))
        if not score:
            break
        doubt = defaultdict(lambda: defaultdict(lambda: 1.0))
        for p, (k, s) in score.items():
            for i in edges[p]:
                if i not in known and k in might[i]:
                    doubt[i][k] *= 1 - s
        belief = {i: (k, 1.0) for i, k in known.items()}
        for i, by in doubt.items():
            b, k = max((1 - d, -k) for k, d in by.items())
            if b >= P.MIN_SCORE:
                belief[i] = (-k, b)
    out = []
    for spans, mine in zip(bases, loose, strict=True):
        more = {(s, belief[name(v)][0], e) for s, e, v, _ in mine if name(v) in belief and shapes(v)[belief[name(v)][0]]
                and not any(a < e and s < b for a, _, b in spans)}
        out.append((spans, sorted({*spans, *more})))
    return out


def found(df, name_):
    return [(r["text"], [(s["at"], s["rank"], s["to"]) for s in r[name_] if s["seed"]], [(s["at"], s["rank"], s["to"]) for s in r[name_]])
            for r in df.collect()]


def check(spark, texts):
    want = sorted(((t, *w) for t, w in zip(texts, brute([t or "" for t in texts]), strict=True)), key=str)
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(found(*P.personal_data(d)), key=str) == want
    return want


def filler(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def test_contexts_lead_to_unseen_identifiers(spark):
    rnd = random.Random(9)
    number = lambda: f"{rnd.randrange(200, 999)} 555 {rnd.randrange(1000, 9999)}"
    texts = [f"{filler(rnd, 9)}. Call me at +1 {number()} {filler(rnd, 5)}" for _ in range(14)]
    texts += [f"{filler(rnd, 5)} Call me at 0{number()} {filler(rnd, 3)}; or dial mobile 0{number()}." for _ in range(12)]
    # reached in the second round only, by a context that the mentions found in the first one share
    shared = [number() for _ in range(12)]
    texts += [f"{filler(rnd, 4)} Call me at 0{n} ok" for n in shared]
    texts += [f"{filler(rnd, 4)} fax line 0{n} {filler(rnd, 2)}" for n in shared]
    texts += [f"{filler(rnd, 4)} fax line 0{number()} {filler(rnd, 2)}", f"order number {rnd.randrange(10 ** 15, 10 ** 16)} {filler(rnd, 3)}"]
    texts += [f"write to user{k}@mail{k}.example.org now" for k in range(12)] + ["write to someone(at)mail now", "or write to nobody@localhost now"]
    texts += ["the same text, card 4111 1111 1111 1111 then 5555555555554444 it is"] * 30
    want = check(spark, texts)
    added = {t: set(a) - set(b) for t, b, a in want}
    assert sum(bool(x) for t, x in added.items() if "Call me at 0" in t) == 24
    assert all(added[t] for t in texts if "fax line" in t) and not any(added[t] for t in texts if "order number" in t)
    assert {r for t, x in added.items() if "write to" in t for _, r, _ in x} == {0}
    assert not any(added[t] for t in texts if "the same text" in t)


def test_strict_entities_equal_plain_patterns(spark):
    rnd = random.Random(5)
    pieces = ["a@b.c", "a@b.c_d@e.f", "@", ".", "x.y+z@h-1.org.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "99999999999999999999.1.1.1", "+", "+1",
              "+1 (743) 555-3824", "+1 ) ) ", "4111-1111 1111 1111", "4111  1111", "5555555555554444", "12", "-", " ", "\n", "é", "😀", "x", "0", "(at)",
              "me [at] there", "0743 555 3824", "10, 0, 0, 1", "1234567a", "𝟙"]
    check(spark, ["".join(rnd.choice(pieces) + rnd.choice(["", " ", "  "]) for _ in range(rnd.randrange(1, 25))) for _ in range(300)])


def test_odd_rows_and_names(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "ip 1.2.3.4", "c"), (3, "ip 1.2.3.4", "c"), (None, "me@x.org", None), (4, "no data", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, Spans string")
    out, name_ = P.personal_data(d)
    assert name_ == "_spans" and out.columns == ["doc_id", "text", "Spans", "_spans"]
    got = sorted(((r["doc_id"], r["text"], r["Spans"], [tuple(s) for s in r["_spans"]]) for r in out.collect()), key=str)
    spans = {"ip 1.2.3.4": [(3, 1, 10, True)], "me@x.org": [(0, 0, 8, True)]}
    assert got == sorted([(*r, spans.get(r[1], [])) for r in rows], key=str)
    assert P.personal_data(d.limit(0))[0].count() == 0


def test_very_long_texts_take_linear_time(spark):
    many = " ".join(f"u{k}@h{k}.org" for k in range(5000))
    texts = ["a" * 400_000, "1-" * 200_000 + "a", "a@b" * 100_000, "1.2." * 100_000, "+1" + " " * 200_000, "a@" + "b." * 100_000, "((" * 100_000, many]
    start = time.time()
    out = found(*P.personal_data(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert time.time() - start < 60
    assert {t[:20]: len(b) for t, b, _ in out}[many[:20]] == 5000
    assert all(b == base(t) for t, b, _ in out if t == many)


def test_query_equals_brute_force(spark):
    docs = table(spark, SF001, "documents").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute([r["text"] or "" for r in docs]), strict=True))
    rows = P.op13_contextual_pii(spark, SF001).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    line = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in rows:
        b, every = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[1] == j for x in b) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(line(b).encode()).hexdigest() and r["spans"] == line(every)
    assert sum(bool(want[i][0]) for i in want) >= 5


def test_running_sums_over_portions(spark):
    n = [0, 1, P.PORTION, P.PORTION + 1, 3 * P.PORTION + 7]
    d = spark.createDataFrame([(x,) for x in n], "n int").select(
        "n", F.when(F.col("n") == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("s"))
    for r in d.select("n", P.running(F.col("s")).alias("r")).collect():
        assert r["r"] == [k * (k + 1) // 2 for k in range(r["n"])]
