"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled rows: words, and beginnings of words shared by a family of
words, whose share among toxic documents is far above that among clean ones. Its terms form a
trie. The Levenshtein automaton of all terms is run on the trie as one machine whose states are
sets of (trie node, edits), made when first needed and kept: insertions, deletions, replacements
and swaps of neighbours count one edit each, and long terms may have more edits than short ones.
Most words leave the machine after a few letters.

Texts are cut into words by Arrow, a slice of ``PART`` bytes at a time, and each different word of
a slice is looked at once. A sieve leaves out words that cannot fit any term: a word within k edits
of a term shares with it what is left after taking at most k letters from each. The hashes of
these leftovers are computed for all words of a length together and looked up in a table of bits;
only words that pass run through the machine, in order, and only texts with a hit are walked
through.

Around each hit a window of words tells quotation (quote marks, reporting words) from address
(second person). A hit counts less for each edit and inside a quotation. A logistic regression on
these credits, with corrections for misspelled, quoted and addressed hits as far as the labels
show any, gives the score.

Training uses at most ``SAMPLE`` labelled rows of each class, those with the smallest hash of
their id; the ids are broadcast (16 bytes each), so texts are not shuffled. All else covers all
rows. Terms are counted in two passes, over toxic rows and then, for the terms those have, over
clean rows. A term needs ``LEAST_DOCS`` toxic texts, however large the sample is; a group of near
copies (see ``hyperminhash_dedup``) counts as one text, so that words which only copies of a few
texts have are no terms. What reaches the driver: the lexicon (words that ``LEAST_DOCS`` of the
sampled toxic texts share, all of them) and a row of nine numbers for each sampled row.

Defined results: null and empty texts have no hit and get the score of a document without hits; a
text of any length is scored whole; without labels of both classes the score is the share of toxic
labels (0 without labels); repeated rows are scored alike; among terms that fit equally well the
one of most weight, then the first by name, is the hit; an empty table gives an empty result;
columns that are kept pass through, and the new ones take names that clash with none of them.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, hash_part, parts, stored, table
from .hyperminhash_dedup import near_duplicates

SAMPLE, LEAST_DOCS, LEAST_WEIGHT, SHORTEST, PREFIXES = 20_000, 8, 2.5, 4, (4, 5, 6)
WINDOW, PART, SIEVED, STATES, WORDS_KEPT = 5, 4 << 20, 1 << 16, 100_000, 300_000
_EDGE = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*_~`|/\\"
#: Marks a state in the open end of a term; no letter equals it.
_REST = "**"
_QUOTES = frozenset("\"“”„«»")
#: Words that report what others said, and words that address the reader (fixed values).
REPORTING = frozenset("said says wrote writes quoted quote called calls word term sagte schrieb zitat wort dit écrit mot dijo escribió palabra".split())
ADDRESS = frozenset("you your you're yourself du dich dir dein sie ihr tu toi ton te vous votre usted ustedes tú tus eres".split())
FEATURES = 9
#: What a hit counts for each edit, and inside a quotation, before labels say more.
EDIT_CREDIT, QUOTE_CREDIT = 0.75, 0.3


def allowed(term: str) -> int:
    """Edits that a term may have."""
    return 0 if term.endswith("*") or len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """The Levenshtein automata of all terms, run on their trie. A term may end in ``*``: then any word beginning so fits."""

    def __init__(self, terms: dict[str, float]):
        self.terms = sorted(terms)
        self.weights = [terms[t] for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.most, self.ends, self.open = [0], [-1], [-1]
        for k, term in enumerate(self.terms):
            node, edits = 0, allowed(term)
            self.most[0] = max(self.most[0], edits)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append(-1)
                    self.open.append(-1)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            (self.open if term.endswith("*") else self.ends)[node] = k
        self.reset()

    def reset(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.state(frozenset())
        self.state(self.closed({(0, 0, "")}))

    def closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With every state that skipping letters of terms reaches; only the fewest edits of a node are kept."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, edits, owed = todo.pop()
            if edits > self.most[node] or best.get((node, owed), 99) <= edits:
                continue
            best[node, owed] = edits
            if not owed:
                todo += [(x, edits + 1, "") for x in self.children[node].values()]
                if self.open[node] >= 0 and not edits:
                    todo.append((node, 0, _REST))
        return frozenset((n, e, o) for (n, o), e in best.items())

    def state(self, items: frozenset) -> int:
        if items not in self.names:
            self.names[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            fits = [(e, -self.weights[self.ends[n]], self.ends[n]) for n, e, o in items
                    if not o and self.ends[n] >= 0 and e <= allowed(self.terms[self.ends[n]])]
            fits += [(0, -self.weights[self.open[n]], self.open[n]) for n, e, o in items if o == _REST]
            self.accepts.append((min(fits)[2], min(fits)[0]) if fits else None)
        return self.names[items]

    def step(self, state: int, c: str) -> int:
        out = set()
        for node, edits, owed in self.sets[state]:
            if owed == _REST:
                out.add((node, 0, _REST))
                continue
            if owed:
                if owed == c:
                    out.add((node, edits, ""))
                continue
            below = self.children[node]
            if c in below:
                out.add((below[c], edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
                out |= {(x, edits + 1, "") for x in below.values()}
                out |= {(self.children[x][c], edits + 1, d) for d, x in below.items() if d != c and c in self.children[x]}
        self.steps[state][c] = to = self.state(self.closed(out))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best fit of a word."""
        if len(self.sets) > STATES:
            self.reset()
        state = 1
        for c in word:
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if not state:
                return None
        return self.accepts[state]


class Sieve:
    """Which words may fit a term at all: no word that does is left out, and few others pass."""

    STEP, MIX = np.uint64(0x100000001B3), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, terms: dict[str, float]):
        self.bits, self.sizes, self.stems = {}, {}, {}
        by_edits: dict[int, list[str]] = {}
        for t in terms:
            if t.endswith("*"):
                self.stems.setdefault(len(t) - 1, []).append(t[:-1])
            else:
                by_edits.setdefault(allowed(t), []).append(t)
        self.stems = {n: np.unique(self.prefixes(self.matrix(ts, n))[-1]) for n, ts in self.stems.items()}
        for k, ts in by_edits.items():
            sizes = {len(t) for t in ts}
            self.sizes[k] = {n + d for n in sizes for d in range(-k, k + 1)}
            found = np.unique(np.concatenate([h for n in sizes for h in self.leftovers(self.matrix([t for t in ts if len(t) == n], n), k)]))
            shift = np.uint64(64 - max(16, int(len(found)).bit_length() + 6))
            table = np.zeros(1 << (64 - int(shift)), bool)
            for mix in self.MIX:
                table[found * mix >> shift] = True
            self.bits[k] = (shift, table)

    @staticmethod
    def matrix(words: list[str], n: int) -> np.ndarray:
        """The letters of words of at least n letters, cut there."""
        return np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)

    def prefixes(self, letters: np.ndarray) -> list[np.ndarray]:
        """Hashes of all beginnings of every word, the empty one first."""
        out = [np.zeros(len(letters), np.uint64)]
        for i in range(letters.shape[1]):
            out.append(out[-1] * self.STEP + letters[:, i] + np.uint64(1))
        return out

    def leftovers(self, letters: np.ndarray, edits: int) -> Iterator[np.ndarray]:
        """Hashes of every word without any choice of at most ``edits`` (2 or fewer) of its letters, choice by choice."""
        n, p = letters.shape[1], self.prefixes(letters)
        power = [np.uint64(pow(int(self.STEP), k, 1 << 64)) for k in range(n + 1)]
        between = lambda a, b: p[b] - p[a] * power[b - a]
        yield p[n]
        for i in range(n if edits else 0):
            yield p[i] * power[n - 1 - i] + between(i + 1, n)
            for j in range(i + 1, n if edits > 1 else 0):
                yield (p[i] * power[j - i - 1] + between(i + 1, j)) * power[n - 1 - j] + between(j + 1, n)

    def passing(self, words: pa.Array) -> np.ndarray:
        """The places of the words that pass, in order."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        found = []
        for n, stems in self.stems.items():
            for at in self.groups(np.flatnonzero(size >= n)):
                found.append(at[np.isin(self.prefixes(self.matrix(words.take(pa.array(at)).to_pylist(), n))[-1], stems)])
        for n in set().union(*self.sizes.values()):
            for at in self.groups(np.flatnonzero(size == n)) if n else ():
                letters = self.matrix(words.take(pa.array(at)).to_pylist(), n)
                for k, (shift, table) in self.bits.items():
                    if n in self.sizes[k]:
                        ok = np.zeros(len(at), bool)
                        for h in self.leftovers(letters, k):
                            ok |= table[h * self.MIX[0] >> shift] & table[h * self.MIX[1] >> shift]
                        found.append(at[ok])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    @staticmethod
    def groups(at: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(at), SIEVED):
            yield at[i:i + SIEVED]


def tokens(texts: pa.Array) -> pa.Array:
    """The words of every text in small letters, as lists; null and empty texts give one empty word."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``PART`` bytes together, one text at least."""
    return parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), PART)


class Scorer:
    """Hits and features of texts; keeps what it has learned about words that pass the sieve."""

    def __init__(self, terms: dict[str, float]):
        self.machine, self.sieve, self.known = Automaton(terms), Sieve(terms), {}

    def matches(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(term, edits) of the best fit of every word; term -1 without any."""
        term, edits = np.full(len(words), -1), np.zeros(len(words), np.int64)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        at = self.sieve.passing(words)
        for i, word in sorted(zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True), key=lambda x: x[1]):
            if word not in self.known:
                self.known[word] = self.machine.match(word)
            if self.known[word]:
                term[i], edits[i] = self.known[word]
        return term, edits

    def features(self, texts: pa.Array) -> np.ndarray:
        """The features of every text."""
        f = np.zeros((len(texts), FEATURES))
        f[:, -1] = 1.0
        for first, last in slices(texts):
            lists = tokens(texts.slice(first, last - first))
            flat, starts = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            each = flat.dictionary_encode()
            codes = each.indices.to_numpy(zero_copy_only=False)
            term, edits = self.matches(pc.utf8_trim(each.dictionary, _EDGE))
            places = np.flatnonzero(term[codes] >= 0)
            texts_of = np.searchsorted(starts, places, "right") - 1
            for k in np.unique(texts_of):
                at = places[np.searchsorted(texts_of, k):np.searchsorted(texts_of, k, "right")]
                hits = [(int(p - starts[k]), int(term[codes[p]]), int(edits[codes[p]])) for p in at]
                f[first + k] = self.describe(flat.slice(starts[k], starts[k + 1] - starts[k]).to_pylist(), hits)
        return f

    def describe(self, tokens: list[str], hits: list[tuple[int, int, int]]) -> list[float]:
        """The features of a text from its words and its hits (place, term, edits)."""
        f = [0.0] * FEATURES
        marks, inside = [], False
        for t in tokens:
            n = 0 if t.isalpha() else sum(c in _QUOTES for c in t)
            marks.append(inside or n > 0)
            inside ^= n % 2 == 1
        for at, term, edits in hits:
            w = self.machine.weights[term]
            near = {t.strip(_EDGE) for t in tokens[max(0, at - WINDOW):at + WINDOW + 1]}
            quoted = marks[at] or bool(near & REPORTING)
            credit = EDIT_CREDIT ** edits * (QUOTE_CREDIT if quoted else 1.0)
            for k, on in ((0, True), (1, edits > 0), (2, quoted)):
                if on:
                    f[k] += 1.0 if k else credit
                    f[3 + k] = max(f[3 + k], w if k else w * credit)
            f[6] += bool(near & ADDRESS)
        f[7] = math.log1p(100 * f[0] / len(tokens))
        f[:3] = [math.log1p(x) for x in f[:3]]
        f[8] = 1.0
        return f


_SCORERS: dict[int, Scorer] = {}


def scorer(terms: dict[str, float]) -> Scorer:
    """The scorer of a lexicon, built once a worker, as its states and known words serve all tasks."""
    name = hash(tuple(terms.items()))
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(terms)
    return _SCORERS[name]


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (h, text, y) with ``copies``, the name of the group of near copies that a text is in; null if it has none."""
    near = stored(near_duplicates(rows.dropDuplicates(["h"]), "h", "text").select("key", "component"), "copies")
    groups = near.groupBy("component").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where(F.col("lo") != F.col("hi"))
    near = near.join(groups, "component").select(F.col("key").alias("h"), F.col("component").alias("copies"))
    return rows.join(near, "h", "left")


def term_counts(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(term, docs) over rows (text, copies): texts with each word or beginning of words, of those in ``only`` if given.

    The texts of one group ``copies`` count as one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def terms_of(word: str) -> list[str]:
        own = [word] * (len(word) >= SHORTEST) + [word[:k] + "*" for k in PREFIXES if len(word) >= k]
        return own if shared.value is None else [t for t in own if t in shared.value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in n], pa.string()), pa.array([g for _, g in n], pa.int64()),
                 pa.array([k if g is None else 0 for (_, g), k in n.items()], pa.int64())], names=["term", "copies", "docs"])
            n.clear()
            return out

        for batch in batches:
            texts, copies = batch.column(0), batch.column(1).to_pylist()
            for first, last in slices(texts):
                lists = tokens(texts.slice(first, last - first))
                each = lists.flatten().dictionary_encode()
                words = pc.utf8_trim(each.dictionary, _EDGE).to_pylist()
                counted_as = [terms_of(w) for w in words]
                useful = np.array([bool(t) for t in counted_as], bool)
                codes = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(first, last), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[useful[codes]]
                pairs = np.unique(text * len(words) + codes[useful[codes]])
                for k, group in itertools.groupby(pairs.tolist(), lambda x: x // len(words)):
                    n.update((t, copies[k]) for t in {t for x in group for t in counted_as[x % len(words)]})
                if len(n) > WORDS_KEPT:
                    yield flush()
        yield flush()

    counted = rows.select("text", "copies").mapInArrow(run, "term string, copies long, docs long")
    return counted.groupBy("term").agg((F.sum("docs") + F.count_distinct("copies")).alias("docs"))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms with their log odds: pure words, and pure beginnings that a family of words shares."""
    def weight(t: str) -> float:
        return math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))

    pure = {t: weight(t) for t in toxic if toxic[t] >= LEAST_DOCS and weight(t) >= LEAST_WEIGHT}
    best: dict[str, int] = {}
    for t in pure:
        if not t.endswith("*"):
            for k in PREFIXES:
                best[t[:k]] = max(best.get(t[:k], 0), toxic[t])
    families: dict[str, float] = {}
    for t in sorted((t for t in pure if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = t[:-1]
        if toxic[t] >= 1.5 * max(best.get(stem, 0), 1) and not any(stem[:k] + "*" in families for k in PREFIXES):
            families[t] = pure[t]
    words = {t: w for t, w in pure.items() if not t.endswith("*")}  # also those of a family, as only words may be misspelled
    return dict(sorted((families | words).items(), key=lambda x: (-x[1] * math.log1p(toxic[x[0]]), x[0])))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; the last feature is the constant and not shrunk."""
    b, shrink = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - y) + shrink * b
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        b -= move
        if np.abs(move).max() < 1e-8:
            break
    return b


def sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(key, y): at most ``rows`` labelled ids of each class, those with the smallest hash."""
    all_rows = labels.select(col(key).alias("key"), col(label).cast("int").alias("y")).where(F.col("key").isNotNull()).dropDuplicates(["key"])
    part = lambda y: all_rows.where(F.col("y") == y).orderBy(hash_part(8, F.col("key")), "key").limit(rows)
    return part(0).union(part(1))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the regression's coefficients."""
    chosen = stored(sample(labels, key, label, rows), "labels")
    d = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"))
    d = d.join(F.broadcast(chosen), "key").withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"])  # copies say no more
    d = stored(with_copies(stored(d.select("h", "text", "y"), "labelled")), "labelled")
    n = {r["y"]: r["n"] for r in d.groupBy("y").agg(F.count_distinct(F.coalesce("copies", "h")).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = n.get(1, 0) / max(1, sum(n.values()))
        odds = math.log((share + 1e-9) / (1 - share + 1e-9))
        return {}, np.append(np.zeros(FEATURES - 1), odds)
    toxic = {r["term"]: r["docs"] for r in term_counts(d.where("y = 1")).where(F.col("docs") >= LEAST_DOCS).toLocalIterator()}
    clean = {r["term"]: r["docs"] for r in term_counts(d.where("y = 0"), frozenset(toxic)).toLocalIterator()}
    terms = choose_terms(toxic, clean, n[1], n[0])
    seen, name = features(d, terms, ("y",))
    rows = seen.collect()
    return terms, fit(np.array([r[name] for r in rows]), np.array([r["y"] for r in rows], float))


def features(docs: DataFrame, terms: dict[str, float], keep: tuple[str, ...], text: str = "text") -> tuple[DataFrame, str]:
    """The columns ``keep`` plus the features of every text; their name is returned."""
    kept = docs.select(*[col(c) for c in keep])
    name, given = fresh(kept, "features", "text_")
    d = docs.select(*[col(c) for c in keep], col(text).cast("string").alias(given))
    shared = d.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features_of = scorer(shared.value).features
        for batch in batches:
            f = features_of(batch.column(len(keep)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * FEATURES, pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

    return d.mapInArrow(run, schema), name


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], keep: tuple[str, ...],
          text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` plus score and predicted.

    The second value maps those two to the names used, which clash with no column kept.
    """
    terms, b = model
    f, given = features(docs, terms, keep, text)
    kept = f.drop(given)
    names = dict(zip(("score", "predicted"), fresh(kept, "score", "predicted"), strict=True))
    logit = sum((col(given)[k] * float(x) for k, x in enumerate(b)), F.lit(0.0))
    chance = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    scored = f.select(*[col(c) for c in kept.columns], chance.alias(names["score"]))
    return scored.withColumn(names["predicted"], (col(names["score"]) >= 0.5).cast("int")), names


def op8_toxicity_automata(spark, sf_dir):
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model = learn(docs, table(spark, sf_dir, "labels").where(~held))
    return score(docs, model, ("doc_id", "held_out"))[0]


QUERIES = {"op8_toxicity_automata": op8_toxicity_automata}
