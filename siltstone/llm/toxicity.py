"""Toxicity scores from a fuzzy lexicon and the words around each hit.

The lexicon is a trie of terms and stems that mark label 1 in a bounded sample
of training rows.  Levenshtein automata of the terms are intersected with the
trie as one automaton over (node, errors) pairs, made deterministic as words
are read, so a misspelled term costs no more than a correct one and most words
end in the dead state after a few letters.  Each hit weighs its log odds,
scaled by its context window: quotation marks and reporting words lower it,
address in the second person raises it.

Very long texts are read in parts cut at white space; the number of quotation
marks so far and the NEAR words on either side are carried from part to part,
so a text scores the same however it is cut.  Of several hits of one term the
strongest counts, whichever place it has, so ties do not matter.

Edge cases: null and empty texts have no hits and get the score of such texts;
without labels of both kinds there is no lexicon and every text scores 0.95 (all
training labels are 1) or 0.05 (otherwise); null ids and repeated rows each
give a row; an empty table gives none; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labelled import FOLDS, remainder, training_sample

WORD = re.compile(r"\w+")
MARKS = "\"“”„«»"
QUOTES = re.compile(f"[{MARKS}]")
GAP = re.compile(r"\s")
PART = 1 << 20
#: Words on either side of a hit that are its context.
NEAR = 6
REPORTING = frozenset(
    "said says wrote writes quoted quote called reported reads term word slur dijo escribió palabra "
    "citó sagte schrieb wort zitat genannt dit écrit mot cité".split()
)
ADDRESS = frozenset("you your youre tu te usted tus du dich dein sie vous toi ton".split())
QUOTED, ADDRESSED = 0.3, 1.25
LEAST_TERM, MOST_TERM = 4, 14
SKETCH = 16
#: States and words that a worker remembers before it starts anew.
MOST_STATES, MOST_WORDS = 100_000, 200_000


def budget(term: str) -> int:
    """Edit errors allowed for a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """A trie of (term, is_stem) walked by Levenshtein automata."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]
        self.ends: list[list[int]] = [[]]
        for t, (term, _) in enumerate(terms):
            node, k = 0, budget(term)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.most.append(0), self.ends.append([])
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append(t)
        self._start()

    def _start(self) -> None:
        self.ids: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.steps: list[dict[str, int]] = [defaultdict(int)]
        self.stems: list[tuple] = [()]
        self.wholes: list[tuple] = [()]
        self.words: dict[str, tuple] = {}
        self.first = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of the state, closed under letters that the text lacks."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            hits = [(t, e) for node, e in key for t in self.ends[node] if e <= budget(self.terms[t][0])]
            self.stems.append(tuple(h for h in hits if self.terms[h[0]][1]))
            self.wholes.append(tuple(h for h in hits if not self.terms[h[0]][1]))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
            reach(node, e + 1)
        to = self._state(reached) if reached else 0
        self.steps[state][c] = to
        return to

    def find(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, fewest errors) of every term that the word matches or every stem it starts with."""
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self.states) > MOST_STATES or len(self.words) > MOST_WORDS:
            self._start()
        best: dict[int, int] = {}
        s = self.first
        for c in word:
            to = self.steps[s].get(c)
            s = self._step(s, c) if to is None else to
            if not s:
                break
            for t, e in self.stems[s]:
                best[t] = min(e, best.get(t, 9))
        for t, e in self.wholes[s]:
            best[t] = min(e, best.get(t, 9))
        self.words[word] = out = tuple(sorted(best.items()))
        return out


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """Stretches of about PART characters that end before white space, with where they start."""
    at = 0
    while len(text) - at > PART:
        end = GAP.search(text, at + PART)
        if end is None:
            break
        yield at, text[at : end.start()]
        at = end.start()
    yield at, text[at:]


class ToxicityModel:
    """Lexicon, weights and a calibrated logistic score."""

    def __init__(self, terms: list[tuple[str, bool]], exact: list[float], fuzzy: list[float], scale: float, bias: float):
        self.terms, self.exact, self.fuzzy, self.scale, self.bias = terms, exact, fuzzy, scale, bias
        self._trie: FuzzyTrie | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None}

    @property
    def trie(self) -> FuzzyTrie:
        if self._trie is None:
            self._trie = FuzzyTrie(self.terms)
        return self._trie

    def hits(self, text: str) -> list[tuple[int, int, float, int, int]]:
        """(term, errors, context factor, start, end) of each hit, in the lower-cased text."""
        out, find = [], self.trie.find
        parts = _parts(text.lower())
        ahead: list[tuple[int, str, list[str]]] = []

        def pull() -> bool:
            for at, part in parts:
                ahead.append((at, part, WORD.findall(part)))
                return True
            return False

        before: list[str] = []
        quotes = 0
        while ahead or pull():
            at, part, words = ahead.pop(0)
            if any(find(w) for w in set(words)):
                while sum(len(p[2]) for p in ahead) < NEAR and pull():
                    pass
                after = [w for p in ahead for w in p[2][:NEAR]][:NEAR]
                row = before + words + after
                marks = [m.start() for m in QUOTES.finditer(part)]
                for i, m in enumerate(WORD.finditer(part), len(before)):
                    found = find(m[0])
                    if found:
                        around = set(row[max(0, i - NEAR) : i + NEAR + 1])
                        inside = (quotes + bisect_left(marks, m.start())) % 2 == 1
                        factor = QUOTED if inside or around & REPORTING else 1.0
                        factor *= ADDRESSED if around & ADDRESS else 1.0
                        out += [(t, e, factor, at + m.start(), at + m.end()) for t, e in found]
            quotes += sum(part.count(q) for q in MARKS)
            before = (before + words)[-NEAR:]
        return out

    def evidence(self, text: str) -> float:
        """Sum over terms of the strongest hit of each."""
        best: dict[int, float] = {}
        for t, e, factor, _, _ in self.hits(text):
            best[t] = max(best.get(t, 0.0), factor * (self.fuzzy[t] if e else self.exact[t]))
        return sum(best.values())

    def score(self, text: str) -> float:
        z = self.bias + self.scale * min(self.evidence(text), 30.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows that share fewer than half of their SKETCH least word hashes with every row before them.

    Copies of one text would otherwise make its rare words look like signs of its label.
    """
    by_hash: dict[int, list[int]] = defaultdict(list)
    kept = []
    for text, y in rows:
        least = sorted({zlib.crc32(w.encode()) for w in set(WORD.findall(text.lower()))})[:SKETCH]
        shared = Counter(i for h in least for i in by_hash[h])
        if least and shared and max(shared.values()) * 2 >= len(least):
            continue
        for h in least:
            by_hash[h].append(len(kept))
        kept.append((text, y))
    return kept


def _lexicon(samples: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """Terms and stems whose document frequency under label 1 is 20 times that under 0, or more."""
    pos, neg = Counter(), Counter()
    whole = Counter()
    n_pos = sum(y for _, y in samples)
    n_neg = len(samples) - n_pos
    for text, y in samples:
        words = set(WORD.findall(text.lower()))
        if y:
            pos.update({w[:k] for w in words for k in range(LEAST_TERM, min(len(w), MOST_TERM) + 1)})
            whole.update(words)
        else:
            neg.update(words)
    least = max(4, n_pos // 80)
    kept = {p for p, c in pos.items() if c >= least}
    against: Counter = Counter()
    for w, c in neg.items():
        for k in range(LEAST_TERM, min(len(w), MOST_TERM) + 1):
            if w[:k] in kept:
                against[w[:k]] += c
    marks = {p for p in kept if pos[p] * n_neg > 20 * (against[p] + 0.5) * n_pos}
    terms: dict[str, bool] = {}
    for p in sorted(marks):
        if p[:-1] in marks and len(p) > LEAST_TERM:
            continue
        while longer := [q for q in kept if len(q) == len(p) + 1 and q.startswith(p) and pos[q] >= 0.9 * pos[p]]:
            p = longer[0]
        terms[p] = whole[p] < 0.9 * pos[p]
    return sorted(terms.items())


def fit(samples: list[tuple[bytes, int]]) -> ToxicityModel:
    """A model for (text, label) rows."""
    rows = _without_copies([(t.decode("utf-8", "replace"), y) for t, y in samples])
    n_pos = sum(y for _, y in rows)
    n_neg = len(rows) - n_pos
    if not n_pos or not n_neg:
        return ToxicityModel([], [], [], 1.0, 3.0 if n_pos else -3.0)
    terms = _lexicon(rows)
    model = ToxicityModel(terms, [1.0] * len(terms), [1.0] * len(terms), 1.0, 0.0)
    seen = np.zeros((2, 2, len(terms)))  # label, inexact, term
    for text, y in rows:
        best: dict[int, int] = {}
        for w in set(WORD.findall(text.lower())):
            for t, e in model.trie.find(w):
                best[t] = min(e, best.get(t, 9))
        for t, e in best.items():
            seen[y, int(e > 0), t] += 1
    odds = np.log((seen[1] + 0.1) / n_pos) - np.log((seen[0] + 0.1) / n_neg)
    model.exact = np.maximum(odds[0], 0.0).tolist()
    model.fuzzy = np.where(seen[1, 1] >= 3, np.clip(odds[1], 0.0, None), np.where(odds[1] > 0, 0.7 * odds[0], 0.0)).clip(0).tolist()
    x = np.array([min(model.evidence(t), 30.0) for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    a, b = 1.0, -3.0
    for _ in range(50):  # Newton steps for the logistic fit, with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    model.scale, model.bias = max(a, 0.05), b
    return model


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit(training_sample(docs, labels, "toxic"))


def score_column(model: ToxicityModel, text: str | Column = "text") -> Column:
    """The score of each text, as an Arrow function of the column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([model.score((x.as_py() or b"").decode("utf-8", "replace")) for x in b], pa.float64())

    c = F.col(text) if isinstance(text, str) else text
    return score(c.cast("string").cast("binary"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels)
    rows = docs.select("doc_id", score_column(model).alias("score"))
    return rows.select(
        "doc_id",
        (remainder("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
