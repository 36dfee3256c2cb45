"""Toxicity: Levenshtein automata over a lexicon trie, with context windows around the hits.

The lexicon has fixed seed terms and terms learned from labelled rows (whole words, and word beginnings of 4 to 7
characters that mark a family of inflected words). Seeds and learned whole words of LEAST_FUZZY letters or more also match
misspelled, word beginnings as they stand. All terms stand in one trie; a word is read by the intersection of the trie with
the Levenshtein automata of the terms (one edit from 5 characters on, two from 9), made deterministic as states are met, so
almost every word dies within a few characters and each distinct word is read once per task. Misspelled forms that
the clean labelled rows use are exceptions.

A hit counts by its window of WINDOW words on either side: less if it stands in quotation marks or next to a reporting word
(a quotation), more next to a second-person pronoun (abuse). Sums by kind of hit go into a logistic score. Its weights are
the posterior mode under a prior that already holds without any label, so few labels change little. Fitting uses at most
MAX_LABELLED labelled rows (the first by hash); of these the driver gets the terms that pass LEAST_LLR and LEAST_PRECISION, the
exceptions and KINDS + 1 numbers a row.

Defined results: null or empty text has no hit and scores the base rate; a null identifier is never held out and never
matches a label; repeated labels of a row count once, as toxic if any is; null labels are unlabelled; without labels the
prior alone scores; texts of any length are read whole; other columns are never read, and drop_toxic returns them whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_LABELLED = 6000
LEAST_LLR = 20.0
LEAST_PRECISION = 0.8
WINDOW = 6

#: Abusive words of general English.
SEEDS = ["bastard", "clown", "crap", "creep", "cretin", "degenerate", "despicable", "dimwit", "disgusting", "dumb", "dumbass", "filth", "fool", "freak", "garbage", "halfwit", "idiot", "idiotic", "imbecile", "jerk", "loser", "lowlife", "moron", "moronic", "nitwit", "parasite", "pathetic", "pig", "scum", "scumbag", "shit", "sicko", "sleaze", "stupid", "subhuman", "swine", "trash", "weirdo", "worthless"]
#: Words that report what someone else said.
REPORTING = {"said", "says", "say", "called", "calls", "quote", "quoted", "quotes", "wrote", "writes", "word", "words", "term", "terms", "phrase", "slur", "insult", "insults", "dit", "mot", "sagte", "wort", "dijo", "palabra"}
#: Second-person pronouns.
YOU = {"you", "your", "youre", "u", "ur", "du", "dich", "tu", "te", "toi", "vous", "usted", "vosotros"}
QUOTES = "\"“”„«»"
LOOKS_LIKE = str.maketrans("013457@$", "oieastas")
WORDS = re.compile(r"[\w@$]+")
#: Prior mean of the logistic weights: bias, then log(1 + sum) of seed, learned, misspelled seed, quoted and misspelled learned hits.
PRIOR = np.array([-3.5, 6.0, 6.0, 5.0, 1.5, 2.0])
KINDS = len(PRIOR) - 1
LEAST_FUZZY = 6


def fuzzy_terms(terms: list[str]) -> set[str]:
    """Terms that also match misspelled: seeds, and learned whole words of LEAST_FUZZY letters or more."""
    return set(SEEDS) | {t for t in terms if len(t) >= LEAST_FUZZY and not t.endswith("*")}


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Terms are words, or beginnings if they end in *. read(word) gives (edits, term) of the best term, or None. Only the terms in fuzzy match with edits."""

    def __init__(self, terms: list[str], fuzzy: set[str]):
        self.fuzzy = fuzzy
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.begin: list[str | None] = [None]
        self.most = [0]
        for t in terms:
            stem, k, at = t.rstrip("*"), edits_for(t) if t in fuzzy else 0, 0
            for c in stem:
                self.most[at] = max(self.most[at], k)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.begin.append(None)
                    self.most.append(0)
                at = self.children[at][c]
            self.most[at] = max(self.most[at], k)
            if t.endswith("*"):
                self.begin[at] = t
            else:
                self.word[at] = t
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.stops: list[str | None] = []
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """The number of the state with these trie nodes and edits, closed under letters the word leaves out; -1 if there are none."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and found.get(child, 99) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        found = {n: e for n, e in found.items() if e <= self.most[n]}
        if not found:
            return -1
        key = tuple(sorted(found.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(found)
            self.moves.append({})
            self.ends.append(min(((e, self.word[n]) for n, e in found.items() if self.word[n] is not None and (e == 0 or self.word[n] in self.fuzzy and e <= edits_for(self.word[n]))), default=None))
            self.stops.append(min((self.begin[n] for n, e in found.items() if e == 0 and self.begin[n] is not None), default=None))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e < self.most[node]:
                found[node] = min(found.get(node, 99), e + 1)
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child]:
                    found[child] = min(found.get(child, 99), cost)
        self.moves[state][c] = to = self._state(found)
        return to

    def read(self, word: str) -> tuple[int, str] | None:
        s = self.start
        for c in word:
            to = self.moves[s].get(c)
            s = self._move(s, c) if to is None else to
            if s < 0:
                return None
            if self.stops[s] is not None:
                return 0, self.stops[s]
        return self.ends[s]


class Scorer:
    def __init__(self, terms: list[str], exceptions: set[str], weights: np.ndarray):
        self.seeds = set(SEEDS)
        self.automaton = Automaton(sorted(self.seeds | set(terms)), fuzzy_terms(terms))
        self.exceptions, self.weights = exceptions, weights
        self.known: dict[str, tuple[int, str] | None] = {}

    def look(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of a word, lower case."""
        if word in self.known:
            return self.known[word]
        hit = self.automaton.read(word)
        if hit is None and not word.isalpha() and (plain := word.translate(LOOKS_LIKE)) != word and plain.isalpha():
            hit = self.automaton.read(plain)
            hit = hit and (max(1, hit[0]), hit[1])
        if hit is not None and hit[0] and word in self.exceptions:
            hit = None
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = hit
        return hit

    def features(self, text: str) -> list[float]:
        """Sums over hits: seed, learned, misspelled seed, quoted, misspelled learned."""
        low = text.lower()
        look, known = self.look, self.known
        words = set(WORDS.findall(low))
        hits = {w: h for w in words if (h := known[w] if w in known else look(w)) is not None}
        sums = [0.0] * KINDS
        if not hits:
            return sums
        spans = [(m.group(), m.start()) for m in WORDS.finditer(low)]
        line_quotes = self._quoted(low)
        for i, (w, at) in enumerate(spans):
            if (h := hits.get(w)) is None:
                continue
            near = {x for x, _ in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
            kind = (2 if h[0] else 0) if h[1] in self.seeds else (4 if h[0] else 1)
            if line_quotes(at) or near & REPORTING:
                sums[3] += 1.0
                sums[kind] += 0.1
            else:
                sums[kind] += 1.5 if near & YOU else 1.0
        return sums

    @staticmethod
    def _quoted(text: str):
        """Whether a place is between an odd and an even quotation mark of its line."""
        marks = [(m.start(), m.group() == "\n") for m in re.finditer(f"[{QUOTES}\n]", text)]
        pairs, first = [], None
        for at, end in marks:
            if end:
                first = None
            elif first is None:
                first = at
            else:
                pairs.append((first, at))
                first = None
        starts = np.array([a for a, _ in pairs])

        def inside(at: int) -> bool:
            k = int(np.searchsorted(starts, at)) - 1 if pairs else -1
            return k >= 0 and at < pairs[k][1]

        return inside

    def score(self, text: str) -> float:
        return logistic(self.weights, np.log1p(np.array([self.features(text)])))[0]


def logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def loss(w: np.ndarray, x1: np.ndarray, y: np.ndarray, precision: float) -> float:
    z = x1 @ w
    return float(np.logaddexp(0, z).sum() - z @ y + precision * ((w - PRIOR) ** 2).sum() / 2)


def fit(x: np.ndarray, y: np.ndarray, precision: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Posterior mode of the logistic weights under PRIOR, by Newton steps that are halved until the loss falls."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    now = loss(w, x1, y, precision)
    for _ in range(rounds):
        p = logistic(w, x)
        step = np.linalg.solve((x1.T * (p * (1 - p))) @ x1 + precision * np.eye(len(w)), x1.T @ (y - p) - precision * (w - PRIOR))
        size = 1.0
        while size > 1e-6 and (after := loss(w + size * step, x1, y, precision)) > now:
            size /= 2
        if size <= 1e-6:
            break
        w, done = w + size * step, now - after < 1e-9 * max(1.0, abs(now))
        now = after
        if done:
            break
    return w


def term_features(text: str) -> set[str]:
    words = {w for w in WORDS.findall(text.lower()) if 3 < len(w) < 40 and w.isalpha()}.difference(SEEDS)
    return words | {f"{w[:k]}*" for w in words for k in range(4, 8) if len(w) > k}


def held_out(id_col: str):
    """Rows never used to learn: the CRC-32 of the identifier as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """What scoring needs: terms and misspelled forms that clean labelled rows use (both words of at most MAX_LABELLED documents), and the weights."""

    def __init__(self, terms: list[str], exceptions: set[str], weights: np.ndarray):
        self.terms, self.exceptions, self.weights = terms, exceptions, weights

    def scorer(self) -> Scorer:
        return Scorer(self.terms, self.exceptions, self.weights)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most max_labelled labelled rows that are not held out."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("__y"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(own), "__id")
    rows = checkpointed(rows.select("__text", "__y"))  # documents are read once to learn

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, pos, neg = batch.slice(at, 128), Counter(), Counter()
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (pos if y else neg).update(term_features(text))
                    (pos if y else neg)[""] += 1
                keys = list(pos | neg)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["term", "pos", "neg"])

    counts = rows.mapInArrow(gather, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    whole = counts.filter("term = ''").first()
    terms: list[str] = []
    exceptions: set[str] = set()
    if whole is not None and whole.pos and whole.neg:
        base = whole.pos / (whole.pos + whole.neg)
        n = F.col("pos") + F.col("neg")
        p = F.col("pos") / n
        llr = 2 * (F.col("pos") * F.log(p / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - p) / (1 - base))).otherwise(0.0))
        best = counts.filter((F.col("term") != "") & (F.col("pos") >= 4)).filter(p >= max(LEAST_PRECISION, base)).withColumn("llr", llr).filter(F.col("llr") >= LEAST_LLR).select("term").collect()  # words of at most max_labelled documents
        begins: set[str] = set()
        for r in sorted(best, key=lambda r: (len(r.term.rstrip("*")), r.term)):
            stem = r.term.rstrip("*")
            if any(stem[:k] in begins for k in range(4, len(stem) + 1)):
                continue  # a shorter beginning has it already
            if r.term.endswith("*"):
                begins.add(stem)
            terms.append(r.term)

        def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Automaton(sorted(set(SEEDS) | set(terms)), fuzzy_terms(terms))
            for batch in batches:
                yield batch.filter(pa.array([(h := reader.read(w)) is not None and h[0] > 0 for w in batch.column(0).to_pylist()], pa.bool_()))

        clean = counts.filter((F.col("neg") > 0) & (F.col("neg") * base >= F.col("pos") * (1 - base)) & ~F.col("term").endswith("*") & (F.col("term") != "")).select("term").mapInArrow(misspelled, "term string")
        exceptions = {r.term for r in clean.collect()}  # of at most max_labelled documents
    counts.unpersist()
    model = Model(terms, exceptions, PRIOR)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for batch in batches:
            x = [s.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in x], pa.float64()) for k in range(KINDS))], names=["y", *names])

    names = [f"x{k}" for k in range(KINDS)]
    seen = rows.mapInArrow(observe, "y int, " + ", ".join(f"{n} double" for n in names)).collect()  # KINDS + 1 numbers of at most max_labelled rows
    if seen:
        model.weights = fit(np.log1p(np.array([[r[n] for n in names] for r in seen])), np.array([float(r.y) for r in seen]))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows as identifier, held_out, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.weights))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = [float(s.score(t or "")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_col)


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that aren't predicted toxic, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.weights))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for batch in batches:
            good = pa.array([s.score(t or "") < 0.5 for t in batch.column(1).to_pylist()], pa.bool_())
            yield batch.select(["row"]).filter(good)

    return rows.mapInArrow(each, rows.select("row").schema).select("row.*")
