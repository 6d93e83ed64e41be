"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities that strict patterns and checks find: mail addresses, IP addresses, payment
cards and phone numbers. Loose patterns find further mentions that might be one of these (a phone
number without its plus, a card number with a wrong digit, an address without a domain). Each
occurrence of a seed or mention lies in lexical patterns: the two words before it, the word before
and the word after, the word before alone. Seeds, mentions and patterns form a graph with an edge
for every pattern and distinct identifier, and rounds of scoring go back and forth over it: a
pattern's score for a kind is the sum of its identifiers' confidences, over that sum plus the
identifiers that cannot be of the kind (they are of another, or have not its shape) plus ``PRIOR``;
a mention's confidence is that at least one of its accepted patterns is right. Accepted are
patterns with ``SUPPORT`` distinct identifiers of the kind, ``SHARE`` of all identifiers of its
shape, and a score of ``MIN_SCORE``; a mention with a confidence of ``MIN_SCORE`` is one of the kind, counts in the next
round, and becomes a span wherever it stands. Copies of a text count once, as edges are distinct.

Every text is scanned once; what was found is written to the shared folder without the text.
Groups are only aggregated (map-side first), so a pattern or identifier with a third of all
occurrences is a few rows per task; patterns with fewer than ``SUPPORT`` identifiers can never be
accepted and are dropped from the graph at once. Patterns take time in proportion to the text:
their loops are possessive and start at the beginning of a run only. Nothing reaches the driver.

Defined results: a null text is empty; empty texts have no spans; a text of any length is
searched whole; equal rows get equal spans; spans of a kind do not overlap (mentions that overlap
a seed are left out); rows without a key are treated as others; an empty table gives an empty
result; columns that are kept pass through under their own names, and the new name clashes with
none of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, let, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns: the contract's, with possessive loops that start where a run or the last match ends.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A strict pattern needs one of these characters, and is not tried without.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Loose mentions: tokens around an at-sign or its spelling, and numbers with up to three separators between digits.
LOOSE = {
    "at": r"(?<![^\s<>()\[\],;:\"'])[^\s<>()\[\],;:\"'@]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s<>()\[\],;:\"'@]++",
    "number": r"(?<![\p{L}0-9_])[+(]{0,2}+[0-9](?:[\x20().,-]{0,3}+[0-9])*+[\p{L}_]*+",
}
CONTEXT_CHARS, ROUNDS, SUPPORT, SHARE, PRIOR, MIN_SCORE, PORTION = 64, 3, 8, 0.25, 2.0, 0.8, 256
SPAN = "struct<at:bigint,rank:int,to:bigint,value:string,left:string,right:string>"
MENTION = "struct<at:bigint,to:bigint,value:string,left:string,right:string>"


def running(sizes: Column) -> Column:
    """Exclusive running sums of an array, portion by portion, so that no long array is built one number at a time."""
    none = F.array().cast("array<bigint>")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)

    def within(x: Column, start: Column) -> Column:
        return F.aggregate(x, F.struct(start.alias("now"), none.alias("out")), lambda a, v: F.struct(
            (a["now"] + v).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")), lambda a: a["out"])

    def all_portions(s: Column) -> Column:
        portions = F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(PORTION)), lambda i: F.slice(s, i + 1, F.lit(PORTION)))
        return let(portions, lambda ps: let(F.transform(ps, total), lambda sums: F.flatten(F.transform(
            ps, lambda p, i: within(p, total(F.slice(sums, F.lit(1), i)))))))

    return F.when(F.size(sizes) == 0, none).otherwise(let(sizes, all_portions))


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern as structs of place (code points from 0), end, value and the text on both sides.

    Splitting gives the text between matches, whose lengths place them.
    """
    def place(x: Column) -> Column:
        found, between = x["found"], x["between"]
        before = F.slice(between, F.lit(1), F.size(found))
        steps = F.zip_with(before, found, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        rows = F.arrays_zip(found.alias("value"), before.alias("left"), F.slice(between, F.lit(2), F.size(found)).alias("right"),
                            running(steps).alias("start"))
        return F.transform(rows, lambda r, i: let(r["start"] + F.length(r["left"]), lambda at: F.struct(
            at.alias("at"), (at + F.length(r["value"])).alias("to"), r["value"].alias("value"),
            # an identifier before stands in the context as a number
            F.concat(F.when(i > 0, F.lit("0 ")).otherwise(F.lit("")), F.right(r["left"], F.lit(CONTEXT_CHARS))).alias("left"),
            F.left(r["right"], F.lit(CONTEXT_CHARS)).alias("right"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(f"array<{MENTION}>")).otherwise(
        let(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("between")), place)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    each = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)), part)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: F.when(F.length(short(x)) > 3, F.lit(False)).otherwise(
            F.concat(F.lit("0"), short(x)).cast("int") <= 255))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def seeds(text: Column) -> Column:
    """Strict entities as structs of place, rank of the kind, end, value and context, by place and rank."""
    has_digit = F.regexp_like(text, F.lit("[0-9]"))

    def of(kind: str) -> Column:
        found = F.transform(F.filter(located(text, STRICT[kind]), lambda m: valid(kind, m["value"])), lambda m: F.struct(
            m["at"].alias("at"), F.lit(KINDS.index(kind)).alias("rank"), m["to"].alias("to"), m["value"].alias("value"),
            m["left"].alias("left"), m["right"].alias("right")))
        gate = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        gate = gate if kind == "email" else gate & has_digit
        return F.when(gate, found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.array_sort(F.concat(*[of(k) for k in KINDS]))


def mentions(text: Column) -> Column:
    """Loose mentions that might be personal data and are not strict entities themselves."""
    def of(kind: str, gate: Column, keep: Callable[[Column], Column]) -> Column:
        return F.when(gate, F.filter(located(text, LOOSE[kind]), lambda m: keep(m["value"]))).otherwise(
            F.array().cast(f"array<{MENTION}>"))

    at_sign = F.contains(text, F.lit("@")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)"))
    number = lambda v: (F.length(digits(v)).between(7, 19) & ~F.regexp_like(v, F.lit(r"[\p{L}_]$"))
                        | F.regexp_like(v, F.lit(r"^[0-9]{1,3}(?:[\x20.,-]{1,3}[0-9]{1,3}){3}$")))
    strict = lambda v: F.regexp_like(v, F.lit(STRICT["email"]))
    return F.concat(of("at", at_sign, lambda v: ~strict(v)), of("number", F.regexp_like(text, F.lit("[0-9]")), number))


def kinds_of(value: Column) -> list[Column]:
    """For every kind, whether a mention has its shape."""
    at = F.contains(value, F.lit("@")) | F.regexp_like(value, F.lit(r"[\[(]at[\])]"))
    n = F.length(digits(value))
    quad = F.regexp_like(value, F.lit(r"^[0-9]{1,3}(?:[\x20.,-]{1,3}[0-9]{1,3}){3}$"))
    return [at, ~at & quad, ~at & n.between(12, 19), ~at & n.between(7, 15) & ~quad]


def identifier(value: Column) -> Column:
    """Digest that writings of one identifier share: the digits of a number, else the text in small letters."""
    return F.md5(F.when(F.contains(value, F.lit("@")) | F.regexp_like(value, F.lit(r"[\[(]at[\])]")), F.lower(value))
                 .otherwise(digits(value)).cast("binary"))


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of an occurrence; digits count as 0 and letters as small."""
    plain = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), "[0-9]+", "0"), r"\s+"), lambda w: w != "")

    def of(x: Column) -> Column:
        one = F.coalesce(F.get(x["l"], F.size(x["l"]) - 1), F.lit("^"))
        two = F.coalesce(F.get(x["l"], F.size(x["l"]) - 2), F.lit("^"))
        after = F.coalesce(F.get(x["r"], F.lit(0)), F.lit("$"))
        return F.array(F.concat_ws(" ", two, one, F.lit("_")), F.concat_ws(" ", one, F.lit("_"), after),
                       F.concat_ws(" ", one, F.lit("_")))

    return let(F.struct(plain(left).alias("l"), plain(right).alias("r")), of)


def graph(found: DataFrame, seed: str, loose: str) -> DataFrame:
    """Edges (pattern, id, known, might): known is the identifier's kind as a seed, might the kinds it has the shape of.

    An identifier that is a seed of several kinds takes the first.
    """
    s = found.select(F.explode(seed).alias("o")).select("o.left", "o.right", identifier(F.col("o.value")).alias("id"),
                                                        F.col("o.rank").alias("known"), F.lit(0).alias("might"))
    bits = [F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(kinds_of(F.col("o.value")))]
    m = found.select(F.explode(loose).alias("o")).select("o.left", "o.right", identifier(F.col("o.value")).alias("id"),
                                                         F.lit(None).cast("int").alias("known"), sum(bits[1:], bits[0]).alias("might"))
    seen = s.union(m).select("id", "known", "might", F.explode(patterns(F.col("left"), F.col("right"))).alias("pattern"))
    edges = stored(seen.groupBy("pattern", "id").agg(F.min("known").alias("known"), F.bit_or("might").alias("might")), "pii-edges")
    nodes = edges.groupBy("id").agg(F.min("known").alias("known"), F.bit_or("might").alias("might"))
    often = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).select("pattern")
    return edges.select("pattern", "id").join(nodes, "id").join(often.withColumnRenamed("pattern", "p"), F.col("pattern") == F.col("p"), "left")


def fits_kind(k: int) -> Column:
    return F.col("might").bitwiseAND(F.lit(1 << k)) != 0


def scored(edges: DataFrame, believed: DataFrame) -> DataFrame:
    """(pattern, rank, score): the accepted patterns and their kind, from (id, rank, belief)."""
    count = lambda c: F.count(F.when(c, 1))
    sums = []
    for k in range(len(KINDS)):
        mine, open_ = F.col("rank") == k, F.col("rank").isNull()
        sums += [F.sum(F.when(mine, F.col("belief")).otherwise(F.lit(0.0))).alias(f"s{k}"),
                 count(~mine | (open_ & ~fits_kind(k))).alias(f"against{k}"), count(open_ & fits_kind(k)).alias(f"open{k}")]
    best = F.array_max(F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(-k).alias("k"), F.col(f"against{k}").alias("against"),
                                          F.col(f"open{k}").alias("open")) for k in range(len(KINDS))]))
    b = (edges.join(believed, "id", "left").groupBy("pattern").agg(*sums).withColumn("b", best).select("pattern", "b.*")
         .withColumn("score", F.col("s") / (F.col("s") + F.col("against") + PRIOR)))
    return (b.where((F.col("s") >= SUPPORT) & (F.col("s") >= SHARE * (F.col("s") + F.col("open"))) & (F.col("score") >= MIN_SCORE))
            .select("pattern", (-F.col("k")).alias("rank"), "score"))


def believe(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, rank, belief) of mentions with the shape of a kind whose accepted patterns say so."""
    fits = F.get(F.array(*[fits_kind(k) for k in range(len(KINDS))]), F.col("rank"))
    each = (edges.where(F.col("known").isNull()).join(accepted, "pattern").where(fits)
            .groupBy("id", "rank").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("belief")).where(F.col("belief") >= MIN_SCORE))
    return each.groupBy("id").agg(F.max_by(F.struct("rank", "belief"), F.struct("belief", -F.col("rank"))).alias("b")).select("id", "b.*")


def bootstrapped(found: DataFrame, seed: str, loose: str, rounds: int = ROUNDS) -> DataFrame:
    """(id, rank) of all identifiers that are seeds or that accepted patterns lead to."""
    edges = stored(graph(found, seed, loose), "pii-graph")
    given = edges.where(F.col("known").isNotNull()).groupBy("id").agg(F.min("known").alias("rank")).withColumn("belief", F.lit(1.0))
    given, edges = stored(given, "pii-beliefs"), edges.where(F.col("p").isNotNull()).drop("p")
    believed = given
    for _ in range(rounds):
        accepted = stored(scored(edges, believed), "pii-patterns")
        if accepted.isEmpty():
            break
        believed = stored(given.union(believe(edges, accepted)), "pii-beliefs")
    return believed.select("id", "rank")


def personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                  rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` (default: all) plus an array of spans; its name is returned.

    A span is a struct (at, rank, to, seed): code points from 0, end exclusive, rank of the kind in
    ``KINDS`` and whether a strict pattern found it; spans are ordered by place, then kind.
    """
    kept = docs.columns if keep is None else keep
    name, row, seed, loose, extra = fresh(docs, "spans", "row_", "seeds_", "mentions_", "extra_")
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    found = docs.select(*[col(c) for c in kept], F.monotonically_increasing_id().alias(row), seeds(t).alias(seed), mentions(t).alias(loose))
    found = stored(found, "pii-found")
    known = bootstrapped(found, seed, loose, rounds)
    added = (found.select(col(row).alias("row"), F.explode(loose).alias("m"))
             .select("row", "m", identifier(F.col("m.value")).alias("id"), F.array(*kinds_of(F.col("m.value"))).alias("fits"))
             .join(known, "id").where(F.get("fits", F.col("rank")))
             .groupBy("row").agg(F.collect_set(F.struct("m.at", "rank", "m.to", F.lit(False).alias("seed"))).alias(extra)))
    base = F.transform(col(seed), lambda s: F.struct(s["at"].alias("at"), s["rank"].alias("rank"), s["to"].alias("to"),
                                                     F.lit(True).alias("seed")))
    apart = F.filter(col(extra), lambda x: ~F.exists(col(seed), lambda s: (s["at"] < x["to"]) & (x["at"] < s["to"])))
    spans = F.when(col(extra).isNull(), base).otherwise(F.array_sort(F.concat(base, apart)))
    return found.join(added, found[row] == added["row"], "left").select(*[col(c) for c in kept], spans.alias(name)), name


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kind = lambda r: F.get(F.array(*[F.lit(k) for k in KINDS]), r)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["rank"]), s["at"], s["to"])), ",")


def op13_contextual_pii(spark, sf_dir):
    found, name = personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = col(name)
    base = F.filter(spans, lambda s: s["seed"])
    count = lambda k: F.size(F.filter(base, lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"))


QUERIES = {"op13_contextual_pii": op13_contextual_pii}
