"""Toxicity by a learned lexicon in a trie, met by Levenshtein automata, with context windows.

Learning (on a bounded sample of labelled rows, TRAIN of them at most):
1. Count in how many toxic and other documents each word, and each beginning of a word ("stem"),
   occurs; keep those whose likelihood ratio says that they go with the label.
2. Words of the sample that are near to a term but occur in other documents too are exceptions.
3. Of the words around hits, keep those that tell abusive documents from others that hold the same terms
   (reports, quotations), in whatever language: their log odds are the context's score.
4. Fit a logistic regression to a handful of features of the sample.

All that comes to the driver is of that sample, so TRAIN bounds it; the lexicon itself has no other bound.

Scoring: the Levenshtein automata of all terms are intersected with the lexicon's trie at once: a
state is the set of (trie node, edits so far) that a word's letters can have led to, built as words
need it and kept. A word in no such state is dead after a few letters. Terms of up to 4 letters must
match exactly, longer ones within one edit, those of 9 and more within two; the first letter always
counts, and stems match exactly, with any ending. Only documents with a hit are looked at word by
word: hits in quotation marks count as quotation, others as abuse, and the
words around each say which of the two it is like.

Defined results: null and empty texts have no hits and get the score of such texts; without labelled
rows of both kinds every score is the share of toxic rows known (0 if none); repeated rows and null
ids are scored like any other (crc32 of a null id counts as held in); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

TRAIN, FOLDS, HELD_OUT, THRESHOLD = 20_000, 4, 2, 0.3
#: Likelihood ratio (G squared) and log odds that a term needs, and stems' lengths.
EVIDENCE, ODDS, STEMS = 18.0, 2.0, range(4, 9)
#: Words around a hit that are its context; documents and likelihood ratio that a word needs to tell something, and the most that one context says.
WINDOW, CONTEXT_DOCS, CONTEXT_EVIDENCE, CONTEXT_MOST = 8, 5, 8.0, 4.0
#: Distinct words and automaton states that a Python worker keeps: bounds its memory, not the result.
KEEP_WORDS, KEEP_STATES, KEEP_LETTERS = 300_000, 50_000, 64
STRIP = ".,!?\"'`;:()[]{}<>#$%&*|/\\-_~^+=«»“”„‘’…¿¡"
QUOTES = "\"“”«»„"

@dataclass
class Lexicon:
    """terms: word -> weight; stems: beginning of words -> weight; context: word near hits -> log odds that it goes with abuse."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """match(word) -> (weight, edits, term) of the best hit, or None."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]  # edits that any term below a node allows
        for store, terms in ((self.word, lexicon.terms), (self.stem, lexicon.stems)):
            for term in terms:
                node = 0
                allowed = edits(term) if store is self.word else 0
                for c in term:
                    self.reach[node] = max(self.reach[node], allowed)
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.word.append(None)
                        self.stem.append(None)
                        self.reach.append(0)
                    node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
                store[node] = term
        self.clear()

    def clear(self) -> None:
        #: states: (node, edits) pairs; node < 0: an accepted stem, of node -1 - node
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.hit: list[tuple[float, int, str] | None] = []
        self.start = self._state(frozenset([(0, 0)]))

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.number:
            self.number[pairs] = len(self.states)
            self.states.append(pairs)
            self.step.append({})
            self.hit.append(self._accepted(pairs))
        return self.number[pairs]

    def _accepted(self, pairs) -> tuple[float, int, str] | None:
        found = []
        for node, e in pairs:
            if node < 0:
                term = self.stem[-1 - node]
                found.append((self.lexicon.stems[term], 0, term + "*"))
            elif (term := self.word[node]) is not None and e <= edits(term):
                found.append((self.lexicon.terms[term] / (1 + e), e, term))
        return max(found, default=None)

    def _next(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if node < 0 or e <= self.reach[node]:
                if e < least.get(node, 99):
                    least[node] = e
                    if node > 0:
                        for child in self.children[node].values():  # a letter of the term left out
                            put(child, e + 1)

        for node, e in self.states[state]:
            if node < 0:
                put(node, 0)
                continue
            for letter, child in self.children[node].items():
                if letter == c:
                    put(child, e)
                    if e == 0 and self.stem[child] is not None:
                        put(-1 - child, 0)
                elif node:  # another letter; not in the first place
                    put(child, e + 1)
            if node:  # a letter too many
                put(node, e + 1)
        return self._state(frozenset(least.items()))

    def match(self, word: str) -> tuple[float, int, str] | None:
        if len(self.states) > KEEP_STATES:
            self.clear()
        state = self.start
        for c in word:
            to = self.step[state].get(c)
            if to is None:
                to = self.step[state][c] = self._next(state, c)
            state = to
            if not self.states[state]:
                return None
        found = self.hit[state]
        return None if found and found[1] and word in self.lexicon.exceptions else found


def normal(token: str) -> str:
    return token.lower().strip(STRIP)


FEATURES = ("abuse", "most", "terms", "near", "quoted", "context")


class Scorer:
    """features(text): numbers that the hits of a text and their contexts give."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = Automaton(lexicon)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[float, int, str]] = {}

    def _found(self, tokens: set[str]) -> dict[str, tuple[float, int, str]]:
        """Those of the tokens that are hits."""
        if len(self.clean) + len(self.hits) > KEEP_WORDS:
            self.clean, self.hits = set(), {}
        found = {t: self.hits[t] for t in tokens & self.hits.keys()}
        for token in tokens - self.clean - found.keys():
            hit = self.automaton.match(normal(token))
            if hit:
                found[token] = hit
            if len(token) <= KEEP_LETTERS:
                if hit:
                    self.hits[token] = hit
                else:
                    self.clean.add(token)
        return found

    def places(self, text: str | None) -> tuple[list[str], list[tuple[int, tuple[float, int, str], set[str]]]]:
        """(words, hits) of a text: each hit with its place and the other words around it."""
        words = (text or "").split()
        found = self._found(set(words))
        at = [i for i, w in enumerate(words) if w in found] if found else []
        return words, [(i, found[words[i]], {normal(w) for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + WINDOW + 1]}) for i in at]

    def features(self, text: str | None) -> tuple[float, ...]:
        words, hits = self.places(text)
        if not hits:
            return (0.0,) * len(FEATURES)
        quoted_at = self._quoted(words, [i for i, _, _ in hits])
        abuse = most = quoted = near = 0.0
        terms, said = set(), []
        for i, (weight, e, term), around in hits:
            told = sum(self.automaton.lexicon.context.get(w, 0.0) for w in around)
            said.append(max(-CONTEXT_MOST, min(CONTEXT_MOST, told)))
            if i in quoted_at:
                quoted += weight
                continue
            abuse += weight
            most = max(most, weight)
            terms.add(term)
            near += e > 0
        return (math.log1p(abuse), most, math.log1p(len(terms)), math.log1p(near), math.log1p(quoted), max(said, key=abs))

    @staticmethod
    def _quoted(words: list[str], places: list[int]) -> set[int]:
        """Those of the places that lie in quotation marks."""
        wanted, out, depth = set(places), set(), 0
        last = places[-1]
        for i, w in enumerate(words[: last + 1]):
            n = sum(w.count(q) for q in QUOTES) if not w.isalnum() else 0
            if i in wanted and (depth % 2 or n):
                out.add(i)
            depth += n
        # a mark never closed quotes nothing: only texts with marks on both sides count
        return out if any(q in w for w in words[last:] for q in QUOTES) or not depth % 2 else set()


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # intercept first
    share: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled documents that are not held out, the same each time."""
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("of")))
    some = written(known.orderBy(F.xxhash64("of"), "of", "toxic").limit(most), "sample")
    texts = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("of")).select("text", "toxic")
    # near copies repeat the same rare words: one text of each least shingle hash and label counts
    words = F.split(F.coalesce("text", F.lit("")), " ")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, F.lit(3))))
    sketched = texts.withColumn("words", words).withColumn("sketch", F.when(F.size("words") > 0, F.array_min(shingles)))
    return written(sketched.groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "train")


def _candidates(texts: Iterator[tuple[str | None, int]]) -> tuple[Counter, Counter]:
    """Documents by word and by stem ("stem*"): toxic ones, and others."""
    found = (Counter(), Counter())
    for text, toxic in texts:
        words = {normal(w) for w in (text or "").split()}
        own = {w for w in words if 2 < len(w) < 40}
        own |= {w[:n] + "*" for w in words for n in STEMS if n < len(w)}
        found[0 if toxic == 1 else 1].update(own)
    return found


def _evidence(a, b, toxic: int, other: int):
    """G squared of (toxic, other) documents with a term against those without."""
    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    n, with_term = toxic + other, a + b
    cells = [(a, toxic, with_term), (b, other, with_term), (toxic - a, toxic, n - with_term), (other - b, other, n - with_term)]
    return 2 * sum((part(x, F.greatest(side * total / F.lit(n), F.lit(1e-9))) for x, side, total in cells), F.lit(0.0))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model:
    train = _sample(docs, labels, most)
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Model(Lexicon(), None, float(toxic > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                a, b = _candidates(zip(batch.column(0)[at : at + 500].to_pylist(), batch.column(1)[at : at + 500].to_pylist(), strict=True))
                terms = list(a.keys() | b.keys())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([a[t] for t in terms], pa.int64()), pa.array([b[t] for t in terms], pa.int64())], names=["term", "a", "b"])

    counted = written(train.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "terms")
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
    scored = counted.filter("a > 2").withColumn("odds", odds).withColumn("g", _evidence(F.col("a").cast("double"), F.col("b").cast("double"), toxic, other))
    found = scored.filter((F.col("g") >= EVIDENCE) & (F.col("odds") >= ODDS)).orderBy(F.col("g").desc(), "term").collect()
    lexicon = _pruned([(r["term"], r["a"], r["b"], r["odds"]) for r in found])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if (m := machine.match(w)) and m[1]], pa.string())], names=["term"])

    common = counted.filter("b > 0 and not endswith(term, '*')").select("term").mapInArrow(known, "term string")
    lexicon.exceptions = frozenset(r["term"] for r in common.collect())
    lexicon.context = _context(train, lexicon)
    rows = np.array([(*r["f"], r["toxic"]) for r in _featured(train.select("text", "toxic"), lexicon).collect()])
    return Model(lexicon, _fit(rows[:, :-1], rows[:, -1]), toxic / (toxic + other))


def _context(train: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """Log odds, by documents with hits, of the words around them that tell abusive documents from others."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                _, hits = scorer.places(text.as_py())
                if hits:
                    own = [*{w for _, _, near in hits for w in near if 0 < len(w) < 40}, ""]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([int(toxic == 1)] * len(own), pa.int64())], names=["word", "toxic"])

    counted = train.select("text", "toxic").mapInArrow(around, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    stored = written(counted, "context")
    every = stored.filter("word = ''").first()  # one empty word a document
    if every is None or not every["a"] or not every["b"]:
        return {}
    odds = F.log((F.col("a") + 0.5) / (every["a"] + 1)) - F.log((F.col("b") + 0.5) / (every["b"] + 1))
    told = stored.filter((F.col("word") != "") & (F.col("a") + F.col("b") >= CONTEXT_DOCS)).withColumn("odds", odds).withColumn("g", _evidence(F.col("a").cast("double"), F.col("b").cast("double"), every["a"], every["b"]))
    return {r["word"]: round(r["odds"], 6) for r in told.filter(F.col("g") >= CONTEXT_EVIDENCE).collect()}


def _pruned(found: list[tuple[str, int, int, float]]) -> Lexicon:
    """Stems before words; longer stems, and words, that a kept stem begins are left out; a stem that is one word's is that word."""
    out = Lexicon()
    words = {t: (a, b) for t, a, b, _ in found if not t.endswith("*")}
    for t, a, b, odds in sorted((f for f in found if f[0].endswith("*")), key=lambda f: (len(f[0]), f[0])):
        stem = t[:-1]
        of_words = max((n[0] for w, n in words.items() if w.startswith(stem)), default=0)
        if of_words >= 0.8 * a or any(stem[:n] in out.stems for n in STEMS if n < len(stem)):
            continue
        out.stems[stem] = round(odds, 6)
    for t, _, _, odds in found:
        if not t.endswith("*") and not any(t[:n] in out.stems for n in STEMS if n <= len(t)):
            out.terms[t] = round(odds, 6)
    return out


def _featured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rows with `text` replaced by f, the text's features; the other columns stay."""
    at, others = rows.columns.index("text"), [c for c in rows.columns if c != "text"]
    places = [rows.columns.index(c) for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            values = [scorer.features(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), *(batch.column(i) for i in places)], names=["f", *others])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"f array<double>, {kinds}")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text hash, score) of every row of docs (doc_id, text)."""
    found = _featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), model.lexicon)
    if model.weights is None:
        return found.select("doc_id", "text_hash", F.lit(model.share).alias("score"))
    total = sum((F.col("f")[i] * float(w) for i, w in enumerate(model.weights[1:])), F.lit(float(model.weights[0])))
    return found.select("doc_id", "text_hash", (1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score `threshold` or more; docs' columns."""
    model = learn(docs, labels)
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, at = Scorer(model.lexicon), columns.index("text")
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.probability(x) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
