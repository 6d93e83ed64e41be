"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gives two histograms: eight character classes, and the common words of four
languages plus one cell for all other words. The same histograms, summed over all documents of
a language, are that language's references. A document's distance is its Jensen-Shannon
distance (base 2, 0 to 1) to the nearest language. Histograms of few characters or words say
nothing, so minimum lengths guard both tests, and limits widen with 1/n. Every labelled language
has a reference of character classes; only languages with a word list have one of words, and
documents labelled with another language take no test of words.

One pass over the text and no shuffle of it: metrics and histograms are written to the shared
folder, summed there into one row per language (with map-side combine), and judged against those
literals. One row for each language reaches the driver: labels are taken to be languages, whose
number does not grow with the rows.

Defined results: a null or empty text has no words and fails the base rules; a text of any length
is measured whole; a corpus without any labelled language has no references, and then the base
rules alone decide; null, repeated and clashing columns pass through unchanged; equal rows get
equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, let, stored, table, words, zero

#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "that", "is", "was", "it", "for", "on"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist"],
    "fr": ["de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "est", "pour"],
    "es": ["el", "y", "los", "se", "del", "las", "por", "con", "no", "su", "para", "es"],
}
#: All cells of the word histogram but the last, which holds every other word.
CELLS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: One letter for each cell.
MARKS = "".join(chr(c) for c in range(ord("0"), ord("0") + len(CELLS)))
#: Classes of characters, each counted in what the earlier ones leave.
CLASSES = ["[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", "[#*$%&|<>]+", "[^\\x00-\\x7F]+"]
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Guards: shorter documents are not judged by that histogram.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Largest Jensen-Shannon distances of a long document. A histogram of n draws is off by chance, which adds
#: a part in proportion to 1/n to the squared distance: so many characters and words over n.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.2
CHARS_NOISE, WORDS_NOISE = 13.0, 4.0


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in the bound array ``ws``.

    Windows are compared by 64-bit hash. Only texts with a repeated window pay for the sort that
    locates it.
    """
    n = F.size(ws)
    count = F.greatest(n - (window - 1), F.lit(0))
    zipped = lambda h: F.arrays_zip(*[F.slice(h, F.lit(j + 1), count) for j in range(window)])
    hashes = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(zipped(h), lambda x: F.xxhash64(x)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            return F.array_sort(F.filter(
                F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)),
                                                        F.lit(window)).cast("long"))
            return F.aggregate(steps, zero(), lambda a, x: a + x)

        return let(let(ordered, positions), total)

    return F.when(n <= window, zero()).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero()).otherwise(covered(h))))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_counts(joined: Column, blanks: Column) -> Column:
    """Code points by class: a-z, A-Z, digit, punctuation, symbol, beyond ASCII, other ASCII; then blanks.

    ``joined`` is the text without blanks, so runs of small letters are few and long.
    """
    def strip(rest: Column, k: int, counts: list[Column]) -> Column:
        if k == len(CLASSES):
            return F.array(*counts, F.length(rest).cast("long"), blanks.cast("long"))
        return let(F.struct(rest.alias("was"), F.regexp_replace(rest, CLASSES[k], "").alias("now")),
                   lambda s: strip(s["now"], k + 1, [*counts, (F.length(s["was"]) - F.length(s["now"])).cast("long")]))

    return strip(joined, 0, [])


def word_cells(ws: Column) -> Column:
    """Counts of the common words (as written in small letters), then of all other words.

    Each common word becomes one letter, and the letters of the short string that results are
    counted by removing them.
    """
    listed = F.array(*[F.lit(w) for w in CELLS])
    mark = lambda w: F.substring(F.lit(MARKS), F.array_position(listed, w).cast("int"), F.lit(1))
    marks = F.array_join(F.transform(F.filter(ws, lambda w: w.isin(CELLS)), mark), "")
    return let(marks, lambda m: F.array(
        *[(F.length(m) - F.length(F.replace(m, F.lit(MARKS[k]), F.lit("")))).cast("long") for k in range(len(CELLS))],
        (F.size(ws) - F.length(m)).cast("long")))


def js_distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a count array to fixed reference counts; null without counts."""
    total = float(sum(reference))
    q = F.array(*[F.lit(x / total) for x in reference])
    n = F.aggregate(counts, zero(), lambda a, x: a + x)

    def term(p: Column, r: Column) -> Column:
        m = (p + r) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(p) + part(r)) / 2

    total_div = let(n, lambda k: F.when(k > 0, F.aggregate(
        F.zip_with(counts, q, lambda c, r: term(c / k, r)), F.lit(0.0), lambda a, x: a + x)))
    return F.sqrt(F.greatest(total_div, F.lit(0.0)))


def measures(text: Column) -> Column:
    """Struct of base metrics and histograms of a text."""
    t = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        joined = F.array_join(ws, "")
        return let(joined, lambda j: F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(j).cast("long").alias("word_chars"),
            repeated_lines(t).alias("n_dup_lines"), repeated_words(ws).alias("n_repeat_words"),
            class_counts(j, F.length(t) - F.length(j)).alias("classes"), word_cells(ws).alias("words")))

    return let(words(t), of)


def guards(m: Column) -> tuple[Column, Column]:
    """Whether the histogram of characters, and that of words, is large enough to be judged."""
    return m["word_chars"] + m["classes"][7] >= GUARD_CHARS, m["n_words"] >= GUARD_WORDS


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def references(docs: DataFrame, m: Column, lang: str = "lang") -> dict[str, dict[str, list[int]]]:
    """Histograms by language, summed over all documents past base rules and guards.

    ``m`` are the measures of a row. They are bound, so that the optimizer does not repeat them for
    each use. At most one row for each labelled language reaches the driver.
    """
    part = let(m, lambda x: F.when(~base_failed(x) & guards(x)[0] & guards(x)[1], F.struct(x["classes"].alias("classes"),
                                                                                           x["words"].alias("words"))))
    d = docs.where(col(lang).isNotNull()).select(col(lang).cast("string").alias("l"), part.alias("r"))
    sums = lambda part, n: F.array(*[F.sum(F.col(f"r.{part}")[i]) for i in range(n)]).alias(part)
    rows = d.groupBy("l").agg(sums("classes", 8), sums("words", len(CELLS) + 1), F.count("r").alias("n")).where("n > 0").collect()
    return {r["l"]: {"classes": list(r["classes"])} | ({"words": list(r["words"])} if r["l"] in COMMON_WORDS else {})
            for r in sorted(rows, key=lambda r: r["l"])}


def below(distance: Column, most: float, noise: float, n: Column) -> Column:
    """Whether a distance is within its limit for n draws; true without a distance."""
    return F.coalesce(distance * distance <= most * most + noise / n, F.lit(True))


def verdict(m: Column, refs: dict[str, dict[str, list[int]]], lang: Column) -> Column:
    """Struct of base metrics, distances to the nearest language and verdict."""
    def near(part: str, enough: Column) -> Column:
        each = [js_distance(m[part], r[part]) for r in refs.values() if part in r]
        return F.when(enough, F.least(*each) if len(each) > 1 else each[0]) if each else F.lit(None).cast("double")

    by_chars, by_words = guards(m)
    by_words &= lang.isNull() | lang.cast("string").isin(list(COMMON_WORDS))
    return let(F.struct(near("classes", by_chars).alias("class_distance"), near("words", by_words).alias("word_distance")),
               lambda x: F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["classes"][4].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        base_failed(m).alias("base_failed"), x["class_distance"].alias("class_distance"),
        x["word_distance"].alias("word_distance"),
        (~base_failed(m) & below(x["class_distance"], MAX_CLASS_DISTANCE, CHARS_NOISE, m["word_chars"] + m["classes"][7])
         & below(x["word_distance"], MAX_WORD_DISTANCE, WORDS_NOISE, m["n_words"])).alias("kept")))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` (default: all) plus one struct of metrics, distances and verdict.

    The measured rows are written once to the shared folder, so texts are scanned once.
    """
    kept = docs.columns if keep is None else keep
    name, label = fresh(docs, "quality", "label_")
    measured = stored(docs.select(*[col(c) for c in kept], col(lang).alias(label), measures(col(text)).alias(name)), "quality")
    refs = references(measured, col(name), label)
    return measured.withColumn(name, verdict(col(name), refs, col(label))).select(*[col(c) for c in kept], col(name)), name


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are scanned twice, for the references and for the verdicts, so that none is written.
    """
    m = measures(col(text))
    refs = references(docs, m, lang)
    return docs.where(let(m, lambda x: verdict(x, refs, col(lang)))["kept"])


def op1_quality_divergence(spark, sf_dir):
    judged, name = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *[f"{name}.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


QUERIES = {"op1_quality_divergence": op1_quality_divergence}


def oracle() -> str:
    """DuckDB SQL of the query: windows as joined words, histograms cell by cell."""
    rest = "length(j) - length(regexp_replace(j, '{}', '', 'g'))"
    classes = [rest.format(p.replace("'", "''")) for p in CLASSES]
    word = "len(list_filter(ws, lambda x: x = '{}'))"
    listed = f"lang IN ({', '.join(repr(x) for x in COMMON_WORDS)})"
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT *, len(ws) AS n, array_to_string(ws, '') AS j, list_filter(string_split(t, chr(10)),
  lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS c
  FROM (SELECT doc_id, ws, unnest(range(1, n - {WINDOW - 2})) AS i FROM b WHERE n > {WINDOW})),
r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT b.doc_id, lang, n AS n_words, length(j) AS word_chars, {classes[4]} AS n_symbols, len(ls) - len(list_distinct(ls))
  AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS chars,
  [{", ".join(classes)}, length(t) - length(j)] AS cs, [{", ".join(word.format(x) for x in CELLS)}] AS wc FROM b LEFT JOIN r USING (doc_id)),
k AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT doc_id, 0 AS part, unnest(range(1, 9)) AS cell, unnest(list_append(cs, word_chars - list_sum(cs[1:6]))) AS v FROM k
  UNION ALL SELECT doc_id, 1, unnest(range(1, {len(CELLS) + 2})), unnest(list_append(wc, n_words - list_sum(wc))) FROM k),
f AS (SELECT lang, part, cell, sum(v) AS v FROM h JOIN k USING (doc_id) WHERE lang IS NOT NULL AND (part = 0 OR {listed})
  AND NOT base_failed AND chars >= {GUARD_CHARS} AND n_words >= {GUARD_WORDS} GROUP BY ALL),
q AS (SELECT lang, part, cell, v / sum(v) OVER (PARTITION BY lang, part) AS q FROM f),
p AS (SELECT doc_id, part, cell, v / sum(v) OVER (PARTITION BY doc_id, part) AS p FROM h),
d AS (SELECT doc_id, part, lang, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js FROM p JOIN q USING (part, cell) GROUP BY ALL),
s AS (SELECT doc_id, min(js) FILTER (WHERE part = 0) AS c, min(js) FILTER (WHERE part = 1) AS w FROM d GROUP BY doc_id)
SELECT k.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(chars < {GUARD_CHARS} OR c <= {MAX_CLASS_DISTANCE ** 2!r} + {CHARS_NOISE} / chars, true)
  AND coalesce(n_words < {GUARD_WORDS} OR NOT coalesce({listed}, true) OR w <= {MAX_WORD_DISTANCE ** 2!r} + {WORDS_NOISE} / n_words, true) AS kept
FROM k LEFT JOIN s USING (doc_id)"""


SQL = {"op1_quality_divergence": oracle()}
