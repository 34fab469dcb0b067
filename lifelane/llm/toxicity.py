"""Toxicity: a lexicon trie walked with Levenshtein automata, weighed by the words around each hit."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, remainder, slices, stored, training_labels

# Insults of four languages that the lexicon starts from; the training rows add their own.
SEED_TERMS = (
    "idiot idiots moron morons stupid pathetic worthless trash garbage scum loser losers clown disgusting filthy imbecile "
    "dumb dumbass bastard asshole bitch retard retarded vermin parasite cretin jerk scumbag fool "
    "idioten dummkopf trottel abschaum versager arschloch widerlich erbärmlich wertlos "
    "idiote imbécile crétin connard minable dégoûtant ordure salaud "
    "idiota imbécil estúpido basura escoria perdedor payaso patético asqueroso inútil"
).split()
# Words that report speech, and words that address the reader.
REPORTING = frozenset("said says wrote writes quote quoted quotes quoting word words term terms called meaning definition reported sagte schrieb wort zitat dit écrit mot terme citation dijo escribió palabra término cita".split())
ADDRESS = frozenset("you your you're youre u are du dich dir dein ihr tu toi vous ton es eres usted vosotros".split())
# Signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_EDGE = "\"'“”„«»‘’.,;:!?()[]{}<>*_~-|#%&…"
_RUN = re.compile(r"(.)\1\1+")
_OPEN, _CLOSE = "\"“„«‘'", "\"”“»’'"


def _thinned(word: str, n: int) -> Iterator[str]:
    """word with up to n letters left out; a form can come twice."""
    yield word
    if n:
        for i in range(len(word)):
            one = word[:i] + word[i + 1 :]
            yield one
            if n > 1:
                yield from [one[:j] + one[j + 1 :] for j in range(i, len(one))]


class Trie:
    """A lexicon trie intersected with the Levenshtein automata of its terms.

    A state of the intersection is a set of (trie node, edits spent); it and its transitions are made when a word first
    needs them and kept, so a word costs one dictionary look-up for each of its letters until its state is empty.
    """

    def __init__(self, terms) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # the largest number of edits that any term below a node allows
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.allowed(term))
            self.most[0] = max(self.most[0], self.allowed(term))
            self.term[node] = term
        self.thinned = frozenset(v for t in self.term if t for v in _thinned(t, self.allowed(t)))
        self.depth: dict[int, int] = {}  # by length of a word: how many of its letters edits can add or change
        for t in filter(None, self.term):
            k = self.allowed(t)
            for n in range(len(t) - k, len(t) + k + 1):
                self.depth[n] = max(self.depth.get(n, 0), k - max(0, len(t) - n))
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.arcs: list[dict[str, int]] = [{}]
        self.result: list[tuple[str, int] | None] = [None]
        self.members: dict[int, frozenset] = {}
        self.start = {c: self._state({(n, 0)}) for c, n in self.children[0].items()}
        self.root = self._state({(0, 0)})

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 8 else 2

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        open_ = list(pairs)
        while open_:
            node, spent = open_.pop()
            if spent <= self.most[node] and spent < best.get(node, 9):
                best[node] = spent
                open_ += [(child, spent + 1) for child in self.children[node].values()]  # a letter left out
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.arcs)
            self.arcs.append({})
            ends = [(e, self.term[n]) for n, e in best.items() if self.term[n] and e <= self.allowed(self.term[n])]
            self.result.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.members[self.number[key]] = key
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        pairs = set()
        for node, spent in self.members[state]:
            pairs.add((node, spent + 1))  # a letter too many
            for x, child in self.children[node].items():
                pairs.add((child, spent + (x != c)))
        found = self.arcs[state][c] = self._state(pairs)
        return found

    def search(self, word: str) -> tuple[str, int] | None:
        """The closest term within its allowed edits that begins with the same letter: (term, distance) or none."""
        if len(self.arcs) > 20_000:
            self._reset()
        return self._walk(self.start.get(word[:1], 0), word[1:])

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The closest term within its allowed edits, wherever in the word they are: (term, distance) or none.

        A word within n edits of a term equals it once up to n letters of each are left out; only such words are walked.
        """
        depth = self.depth.get(len(word))
        if depth is None or self.thinned.isdisjoint(_thinned(word, depth)):
            return None
        if len(self.arcs) > 20_000:
            self._reset()
        return self._walk(self.root, word)

    def _walk(self, state: int, word: str) -> tuple[str, int] | None:
        arcs = self.arcs
        for c in word:
            if not state:
                return None
            following = arcs[state].get(c)
            state = self._step(state, c) if following is None else following
        return self.result[state]


class _Hits(dict):
    """Raw token -> 0 none, 1 exact, 2 misspelled; filled as tokens come, emptied when it holds too many."""

    def __init__(self, trie: Trie, terms: frozenset, harmless: frozenset) -> None:
        self.trie, self.terms, self.harmless, self.longest = trie, terms, harmless, max(map(len, terms), default=0) + 2
        self.shortest = min((len(t) - trie.allowed(t) for t in trie.term if t), default=0)

    def __missing__(self, raw: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[raw] = found = self.look(raw)
        return found

    def look(self, raw: str) -> int:
        word = raw.strip(_EDGE)
        if word in self.terms:
            return 1
        if word in self.harmless:
            return 0
        if len(word) <= self.longest and word.isalpha() and self.misspelled(word):
            return 2
        plain = word if word.isalpha() else re.sub(r"[^\w]|_", "", word.translate(_LEET))
        for run in {plain, _RUN.sub(r"\1\1", plain), _RUN.sub(r"\1", plain)}:
            if run != word and (run in self.terms or self.misspelled(run)):
                return 2
        return 0

    def misspelled(self, word: str) -> bool:
        return self.shortest <= len(word) <= self.longest and word not in self.harmless and self.trie.nearest(word) is not None


#: exact abusive, misspelled abusive, quoted hits, hits by word, any abusive hit, addressed hits
WIDTH = 6


def evidence(text: str | None, hits: _Hits, window: int = 5) -> np.ndarray:
    """Counts of abusive and quoted hits of a whole text, weighed by the window of words around each."""
    words = (text or "").lower().split()
    exact = fuzzy = quoted = addressed = 0.0
    for i in [i for i, w in enumerate(words) if hits[w]]:
        w = words[i]
        near = [x.strip(_EDGE) for x in words[max(0, i - window) : i + window + 1]]
        in_quotes = (w[0] in _OPEN or any(x[0] in _OPEN for x in words[max(0, i - 3) : i])) and (w.rstrip(".,;:!?")[-1:] in _CLOSE or any(x.rstrip(".,;:!?")[-1:] in _CLOSE for x in words[i + 1 : i + 4]))
        if in_quotes or (REPORTING.intersection(near) and not ADDRESS.intersection(near)):
            quoted += 1
        elif hits[w] == 1:
            exact += 1
        else:
            fuzzy += 1
        addressed += bool(ADDRESS.intersection(near))
    n = exact + fuzzy + quoted
    return np.array([math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * n / (len(words) + 1)), float(exact > 0), math.log1p(addressed)])


@dataclass
class ToxicityModel:
    terms: frozenset  # matched as they are
    spelled: frozenset  # the terms of which misspellings are looked for
    harmless: frozenset  # look-alikes that clean texts use
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2, 1, 0, 0, 4, 0]))  # first the constant

    def hits(self) -> _Hits:
        return _Hits(Trie(sorted(self.spelled)), self.terms, self.harmless)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -700, 700)))


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = 20_000, min_share: float = 0.003, odds: float = 20.0, mod: int = 5) -> ToxicityModel:
    """Learns terms, harmless look-alikes and weights from at most about max_rows labelled rows outside the held-out fold.

    A word joins the lexicon when min_share of the toxic texts (and at least four) hold it, its odds against clean
    texts are at least odds, and most texts that hold it differ: near copies, which share their smallest word hash,
    count little. Misspellings are looked for of seed terms, and of learned ones whose look-alikes in the sample are
    mostly toxic. A look-alike that more clean than toxic texts hold is harmless. As a learned term is in min_share of
    the toxic texts, the sample's texts bound how many there are. Repeated documents count each; null texts count as
    empty. Empty tables, and labels of one kind only, leave the seed terms and default weights.
    """
    sample = documents.select("doc_id", "text").join(F.broadcast(training_labels(labels, label, max_rows, mod)), "doc_id").select("text", "label")
    sample = stored(sample, "toxic-sample")
    totals = dict.fromkeys((0, 1), 0) | {r.label: r["count"] for r in sample.groupBy("label").count().collect()}

    def distinct_words(text: str | None) -> set[str]:
        return {w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if 4 <= len(w) <= 24}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label = {0: Counter(), 1: Counter()}
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_label[k].update(distinct_words(text))
            found = list(by_label[0].keys() | by_label[1].keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "toxic": pa.array([by_label[1][w] for w in found], pa.int64()), "clean": pa.array([by_label[0][w] for w in found], pa.int64())})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = distinct_words(text)
                make = min((zlib.crc32(w.encode()) for w in found), default=0)
                yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "make": pa.array([make] * len(found), pa.int64())})

    words = sample.mapInArrow(counted, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    makes = sample.where("label = 1").mapInArrow(made, "word string, make long").groupBy("word").agg(F.count_distinct("make").alias("makes"))
    words = stored(words.join(makes, "word", "left").withColumn("makes", F.coalesce("makes", F.lit(0))), "toxic-words")
    ratio = ((F.col("toxic") + 0.5) / (totals[1] + 1)) / ((F.col("clean") + 0.5) / (totals[0] + 1))
    enough = (F.col("makes") >= max(4, min_share * totals[1])) & (F.col("makes") >= 0.6 * F.col("toxic"))
    learned = {r.word for r in words.where(enough & (ratio >= odds)).select("word").collect()}
    terms = frozenset(SEED_TERMS) | learned

    def look_alikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sorted(terms))
        for batch in batches:
            found = [None if w in terms else trie.nearest(w) for w in batch.column(0).to_pylist()]
            near = batch.append_column("term", pa.array([f and f[0] for f in found], pa.string()))
            yield near.filter(pc.is_valid(near.column("term")))

    alike = stored(words.select("word", "toxic", "clean").mapInArrow(look_alikes, "word string, toxic long, clean long, term string"), "toxic-alike")
    harmless = frozenset(r.word for r in alike.where((F.col("clean") >= 1) & (F.col("clean") >= F.col("toxic"))).select("word").collect())
    good = {r.term for r in alike.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t > c").collect()}
    model = ToxicityModel(terms, frozenset(SEED_TERMS) | good, harmless)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in slices(batches):
            x = [evidence(t, hits).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column(1), "x": pa.array(x, pa.list_(pa.float64()))})

    rows = sample.mapInArrow(features, "label int, x array<double>").collect()
    if len({r.label for r in rows}) == 2:
        model.weights = _logistic(np.array([[1.0, *r.x] for r in rows]), np.array([r.label for r in rows], dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; no penalty on the constant."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scores(model: ToxicityModel, hits: _Hits, texts: list[str | None]) -> np.ndarray:
    let_go()
    return model.score(np.array([evidence(t, hits) for t in texts])) if texts else np.zeros(0)


def score(documents: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts score as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in slices(batches):
            s = _scores(model, hits, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": pa.array((s >= threshold).astype(np.int32))})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", mod) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: ToxicityModel, *, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, all columns kept, that score below threshold. Null texts score as empty, repeated rows each."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.hits()
        for batch in slices(batches):
            yield batch.filter(pc.less(pa.array(_scores(model, hits, batch.column(at).to_pylist())), threshold))

    return documents.mapInArrow(run, documents.schema)


def op4_toxicity_lexicon(spark, sf_dir: str) -> DataFrame:
    """score() of documents by a model of their labelled rows: a row for each of theirs, null ids and texts and repeated rows too."""
    from .common import let_go, table

    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
