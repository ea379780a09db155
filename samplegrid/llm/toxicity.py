"""Toxicity by a learned lexicon: a trie of terms intersected with Levenshtein automata, and scores of context windows.

fit() learns from labelled rows which word beginnings mark toxic texts (a grouped count over a bounded sample), how much a misspelt
one still tells (from copies of the toxic texts with each term damaged by one edit, against the near hits of clean texts), and a logistic model of
the sum of all hits and of the densest window. Hits never count against toxicity: a misspelt term has at most the weight of the term, one that is quoted
or reported MENTIONED of it, and both features have weights of 0 or more, so each further hit raises a text's score, and a quoted term scores under
the same term used. score() walks every word of every whole text through the automaton.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.bpe import Memo, slices
from samplegrid.llm.common import map_arrow

#: Bound of the labelled sample: documents of each class, chosen by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
#: Letters of the word beginnings that may become terms.
SHORTEST, LONGEST = 4, 12
#: Characters on either side of a term in which signs of quotation count; words of a window whose hits are added up.
CONTEXT, WINDOW = 48, 50
#: What a quoted or reported term counts of its weight.
MENTIONED = 0.5
#: Clean texts that are taken to have a near hit of each term beside those that do: words that no sample holds.
UNSEEN = 2.0

WORD = re.compile(r"[^\W\d_]+")
#: Signs that a term is mentioned, not used.
QUOTES = "\"'“”„«»‹›"
REPORTING = re.compile(r"\b(?:said|says|called|quote|quoted|wrote|term|word|sagte|genannt|zitat|wort|dit|appelé|citation|mot|dijo|llamó|cita|palabra)\b")


class Automaton:
    """Deterministic product of a trie and the Levenshtein automata of its terms, built state by state as words need it.

    A state is a set of (trie node, edits). Terms match as exact beginnings of a word, or, from five letters on,
    as whole words with one edit.
    """

    STATES = 50_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term = [-1]
        for t, s in enumerate(terms):
            node = 0
            for ch in s:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                node = self.children[node][ch]
            self.term[node] = t
        self.clear()

    def clear(self) -> None:
        self.sets: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.exact: list[int] = []
        self.fuzzy: list[int] = []
        self.start = self.state({0: 0})

    def state(self, edits: dict[int, int]) -> int:
        """The number of the state with these edits by node, closed under leaving out a letter of the term; -1: dead."""
        for node, e in list(edits.items()):
            if e == 0:
                for child in self.children[node].values():
                    edits.setdefault(child, 1)
        key = frozenset(edits.items())
        if not key:
            return -1
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.exact.append(max((self.term[n] for n, e in key if e == 0), default=-1))
            self.fuzzy.append(max((self.term[n] for n, e in key if e == 1 and self.term[n] >= 0 and len(self.terms[self.term[n]]) >= 5), default=-1))
        return self.index[key]

    def step(self, state: int, ch: str) -> int:
        edits: dict[int, int] = {}
        for node, e in self.sets[state]:
            child = self.children[node].get(ch)
            if child is not None and e < edits.get(child, 2):
                edits[child] = e
            if e == 0:
                edits.setdefault(node, 1)
                for other in self.children[node].values():
                    edits.setdefault(other, 1)
        to = self.steps[state][ch] = self.state(edits)
        return to

    def match(self, word: str) -> tuple[int, bool] | None:
        """(term, exact) or None."""
        if len(self.sets) > self.STATES:
            self.clear()
        state, found, steps = self.start, -1, self.steps
        for ch in word:
            to = steps[state].get(ch)
            state = self.step(state, ch) if to is None else to
            if state < 0:
                break
            if self.exact[state] >= 0:
                found = self.exact[state]
        if found >= 0:
            return found, True
        if state >= 0 and self.fuzzy[state] >= 0:
            return self.fuzzy[state], False
        return None


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    near: list[float]
    coefficients: list[float]


def misspelt(word: str) -> str:
    """The word with one edit, chosen by its checksum: a letter left out, another one in its place, or one more."""
    h = crc32(word.encode())
    at, kind, letter = h // 3 % len(word), h % 3, "abcdefghijklmnopqrstuvwxyz"[h // 1000 % 26]
    if kind == 1 and letter == word[at]:
        letter = "e" if letter != "e" else "a"
    return word[:at] + ("" if kind == 0 else letter) + word[at + (kind < 2) :]


class Scorer:
    FEATURES = 3

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms)
        self.memo = Memo(lambda w: self.automaton.match(w) or (), 150_000)

    def hits(self, text: str | None) -> list[tuple[int, str, int, bool, bool]]:
        """(word number, word, term, exact, mentioned) of every hit."""
        low = (text or "").lower()
        memo = self.memo
        if not any(map(memo.__getitem__, WORD.findall(low))):
            return []
        out = []
        for i, m in enumerate(WORD.finditer(low)):
            if hit := memo[m[0]]:
                before, after = low[max(0, m.start() - CONTEXT) : m.start()], low[m.end() : m.end() + CONTEXT]
                wrapped = before[-1:] in QUOTES and after[:1] in QUOTES and before[-1:] and after[:1]
                out.append((i, m[0], *hit, bool(wrapped or REPORTING.search(before))))
        return out

    def features(self, text: str | None) -> list[float]:
        """1, and the logarithms of one more than all hits' weight and than that of the heaviest WINDOW words."""
        places, total, best, inside, first = [], 0.0, 0.0, 0.0, 0
        for i, _, term, exact, mentioned in self.hits(text):
            w = (self.model.weights if exact else self.model.near)[term] * (MENTIONED if mentioned else 1)
            places.append((i, w))
            total += w
            inside += w
            while places[first][0] <= i - WINDOW:
                inside -= places[first][1]
                first += 1
            best = max(best, inside)
        return [1.0, float(np.log1p(total)), float(np.log1p(best))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.model.coefficients))
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))

    def damaged(self, text: str | None) -> str:
        """The text, lower-cased, with every exact hit misspelt."""
        low = (text or "").lower()
        exact = lambda w: (self.memo[w] or (0, False))[1]
        return WORD.sub(lambda m: misspelt(m[0]) if exact(m[0]) else m[0], low)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch, by class, that have a word with a beginning of SHORTEST to LONGEST letters."""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            counts = Counter(), Counter()
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counts[toxic].update({w[:n] for w in set(WORD.findall((text or "").lower())) for n in range(SHORTEST, min(len(w), LONGEST) + 1)})
            terms = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """(text, toxic) of at most so many labelled rows of each class; the ids with the smallest hashes."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic in (0, 1)")
    known = known.dropDuplicates(["doc_id"])
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, toxic), (0, clean))]
    # bounded by toxic + clean rows of two numbers
    chosen = F.broadcast(picked[0].union(picked[1]))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").join(chosen, "doc_id").select("text", "toxic")


def lexicon(rows: list, toxic: int, clean: int) -> tuple[list[str], list[float]]:
    """Of significant beginnings: the longest that keep a shorter one's documents, without those that only narrow it."""
    count = {r["term"]: r["toxic"] for r in rows}
    terms: list[str] = []
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        t = r["term"]
        longer = any(len(x) > len(t) and x.startswith(t) and n >= 0.9 * count[t] for x, n in count.items())
        if not longer and not any(t.startswith(x) for x in terms):
            terms.append(t)
    odds = {r["term"]: np.log((r["toxic"] + 0.5) / (toxic + 1)) - np.log((r["clean"] + 0.5) / (clean + 1)) for r in rows}
    return terms, [float(odds[t]) for t in terms]


def logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's method with a ridge penalty, none on the first column (ones); other weights under 0 are 0. count: what each row counts."""
    w, free = np.zeros(x.shape[1]), np.arange(x.shape[1])
    while True:
        own, v = x[:, free], np.zeros(len(free))
        penalty = np.diag([1e-6] + [ridge] * (len(free) - 1))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ v, -30, 30)))
            step = np.linalg.solve((own * (count * p * (1 - p))[:, None]).T @ own + penalty, own.T @ (count * (y - p)) - penalty @ v)
            v += step
            if np.abs(step).max() < 1e-6:
                break
        if len(free) == 1 or v[1:].min() >= 0:
            w[free] = v
            return w
        free = np.delete(free, 1 + v[1:].argmin())


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model:
    """Learns from at most toxic + clean labelled documents. Without labels of both kinds, every text scores the
    share of toxic labels (0 without labels)."""
    chosen = sample(docs, labels, toxic, clean).persist()
    size = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        chosen.unpersist()
        return Model([], [], [], [30.0 if t else -30.0, 0, 0])
    counts = map_arrow(chosen, _beginnings, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = t / (t + c)
    # log likelihood ratio of the observed split against the sample's share of toxic documents
    n = F.col("toxic") + F.col("clean")
    ratio = F.col("toxic") * F.log(F.col("toxic") / n / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    found = counts.where(F.col("toxic") > 2).withColumn("ratio", ratio).where((F.col("ratio") >= 9) & (odds >= 2.5))
    rows = found.collect()  # beginnings of the bounded sample's words
    terms, weights = lexicon(rows, t, c)
    model = Model(terms, weights, [0.0] * len(terms), [0.0] * Scorer.FEATURES)

    def near_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with a near hit of each term, by class; toxic ones with their terms misspelt."""
        scorer = Scorer(model)
        for batch in batches:
            counts = np.zeros((2, len(terms)), np.int64)
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[y, list({h[2] for h in scorer.hits(scorer.damaged(text) if y else text) if not h[3]})] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), *map(pa.array, counts)], ["term", "clean", "toxic"])

    for r in map_arrow(chosen, near_hits, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():
        odds_near = np.log((r["toxic"] + 0.5) / (t + 1)) - np.log((r["clean"] + UNSEEN) / (c + 1))
        model.near[r["term"]] = float(np.clip(odds_near, 0, weights[r["term"]]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of all texts, and of the toxic ones once more with their terms misspelt: each of the two counts half."""
        scorer = Scorer(model)
        for batch in batches:
            texts = list(zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True))
            texts += [(scorer.damaged(s), y) for s, y in texts if y]
            x, y = [scorer.features(s) for s, _ in texts], [y for _, y in texts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array([1 - y / 2 for y in y])], ["x", "y", "count"])

    table = map_arrow(chosen, features, "x array<double>, y int, count double").collect()
    chosen.unpersist()
    model.coefficients = logistic(*(np.array([r[k] for r in table], float) for k in ("x", "y", "count"))).tolist()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row. A null or empty text has the score of a text without terms. Repeated
    rows score alike; null keys are kept; other columns are not read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "t", 4 << 20):
                s = [scorer.score(t) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(s, pa.float64())], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = map_arrow(docs.selectExpr(f"`{key}` k", f"`{text}` t"), run, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that the model predicts as toxic; all columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                yield part.filter(pa.array([scorer.score(t) < 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
