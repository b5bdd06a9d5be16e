"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled texts: words, and beginnings of words, that toxic texts hold far more often than
others, besides a short list of common insults. Features of a text are the densities of lexicon words and beginnings,
how near they stand to the second person, and the rates of capitals, punctuation and obfuscated spellings. Trees are
grown on histograms in numpy; isotonic regression on labelled texts left out of the trees turns margins into chances.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import held_out, labelled_sample, table

NAME = "op5_toxicity"
#: The most labelled rows that are learned from; a quarter of them calibrates.
TRAIN_ROWS = 8000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 5
#: Letters of a word's beginning that count as a stem.
STEM_LENGTHS = (4, 5, 6)
#: Toxic texts that must hold a lexicon entry, in all and as a part of them (copies of a text repeat its words), and how
#: much more often toxic texts must.
LEXICON_TEXTS, LEXICON_PART, LEXICON_RATIO = 3, 0.015, 12.0
NEAR = 4
THRESHOLD = 0.5
#: Words that a worker keeps the kinds of; beyond that it starts anew.
MEMO = 200_000

INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros vuestro".split())
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_EDGES = ".,;:!?\"'()[]{}*#&%$|<>-_/"
_MIXED = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]")
LEX, STEM, YOU, CAPS, HIDDEN = 1, 2, 4, 8, 16
NAMES = ("lexicon density", "lexicon count", "stem density", "stem count", "near second person", "second person density", "capital words", "capitals", "punctuation", "exclamations", "obfuscated", "log words")


def word_of(token: str) -> str:
    """A token without its outer punctuation, in lower case, with digits and signs inside read as letters."""
    w = token.strip(_EDGES).lower()
    return w.translate(_PLAIN) if _MIXED.search(w) else w


@dataclass
class Lexicon:
    words: frozenset
    stems: frozenset
    memo: dict = field(default_factory=dict, repr=False, compare=False)

    def kind(self, token: str) -> int:
        w = word_of(token)
        bare = token.strip(_EDGES)
        return (
            (LEX if w in self.words else 0)
            | (STEM if any(w[:n] in self.stems for n in STEM_LENGTHS if len(w) >= n) else 0)
            | (YOU if w in SECOND_PERSON else 0)
            | (CAPS if len(bare) > 1 and bare.isupper() else 0)
            | (HIDDEN if _MIXED.search(bare) else 0)
        )

    def kinds(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = list(map(memo.get, tokens))
        if None in out:
            for i, k in enumerate(out):
                if k is None:
                    t = tokens[i]
                    out[i] = memo[t] = self.kind(t)
        return np.array(out, np.uint8)

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        n = max(1, len(tokens))
        k = self.kinds(tokens)
        hit, you = (k & (LEX | STEM)) > 0, (k & YOU) > 0
        count = lambda bit: int(np.count_nonzero(k & bit))
        near = 0
        if hit.any() and you.any():
            at = np.flatnonzero(you)
            spots = np.flatnonzero(hit)
            right = np.searchsorted(at, spots)
            gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - spots), np.abs(at[np.maximum(right - 1, 0)] - spots))
            near = int(np.count_nonzero(gap <= NEAR))
        bytes_ = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size = max(1, int(bytes_.sum()))
        punctuation = int(bytes_[33:48].sum() + bytes_[58:65].sum() + bytes_[91:97].sum() + bytes_[123:127].sum())
        return [count(LEX) / n, float(count(LEX)), count(STEM) / n, float(count(STEM)), near / n, count(YOU) / n, count(CAPS) / n, float(bytes_[65:91].sum()) / size, punctuation / size, float(bytes_[33]) / size, count(HIDDEN) / n, float(np.log1p(len(tokens)))]


def learn_lexicon(sample: list[tuple[str, int]]) -> Lexicon:
    """Entries of enough toxic texts whose share of them is LEXICON_RATIO times that of other texts."""
    held, number = ((Counter(), Counter()), (Counter(), Counter())), [0, 0]
    for text, y in sample:
        number[y] += 1
        words = {word_of(t) for t in set(text.split())}
        held[y][0].update(words)
        held[y][1].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) > n and w.isalpha()})
    picked, least = [], max(LEXICON_TEXTS, LEXICON_PART * number[1])
    for kind in (0, 1):
        toxic, other = held[1][kind], held[0][kind]
        picked.append(frozenset(w for w, c in toxic.items() if w and c >= least and c / max(1, number[1]) > LEXICON_RATIO * (other[w] + 1) / max(1, number[0])))
    return Lexicon(picked[0] | INSULTS, picked[1])


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, edges: list[np.ndarray]):
    """A tree as (feature, edge, left, right) or a leaf's step: Newton steps of the logistic loss, best gain first."""
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)

    def node(rows: np.ndarray, depth: int):
        g, h = residual[rows].sum(), weight[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 2 * LEAST:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (residual[rows], weight[rows], np.ones(len(rows))))
                gain = np.where((ns >= LEAST) & (len(rows) - ns >= LEAST), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            return float(g / (h + 1))
        j, cut = best[1]
        left = codes[rows, j] <= cut
        return (j, float(edges[j][cut]), node(rows[left], depth - 1), node(rows[~left], depth - 1))

    return node(np.arange(len(x)), DEPTH)


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = apply_tree(tree[2], x[left]), apply_tree(tree[3], x[~left])
    return out


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the rising chances that fit the labels best: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for m, y in sorted(zip(margin.tolist(), label.tolist(), strict=True)):
        if pools and pools[-1][3] == m:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, m, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, _, high = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = high
    chance = [(y + 0.02) / (n + 0.04) for y, n, _, _ in pools]
    return np.array([m for p in pools for m in (p[2], p[3])]), np.maximum.accumulate(np.repeat(chance, 2)) if pools else np.zeros(0)


@dataclass
class Model:
    lexicon: Lexicon
    trees: list
    base: float
    margins: np.ndarray
    chances: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + RATE * sum((apply_tree(t, x) for t in self.trees), np.zeros(len(x)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m = self.margin(np.array([self.lexicon.features(t) for t in texts]))
        return np.interp(m, self.margins, self.chances) if len(self.margins) else 1 / (1 + np.exp(-m))


def train(sample: list[tuple[str, int]]) -> Model:
    """Fits lexicon and trees to three quarters of the sample and calibrates on the rest. With one class only, or
    none, every text gets the smoothed share of toxic ones."""
    labels = np.array([y for _, y in sample], np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(Lexicon(INSULTS, frozenset()), [], base, np.zeros(0), np.zeros(0))
    rest = np.arange(len(sample)) % 4 == 3
    # features of texts that the lexicon was learned from look too good: two lexicons, each for the other's texts
    halves = np.arange(len(sample)) // 4 % 2
    crossed = [learn_lexicon([sample[i] for i in np.flatnonzero(~rest & (halves != h))]) for h in (0, 1)]
    learned = np.flatnonzero(~rest)
    x = np.array([crossed[halves[i]].features(sample[i][0]) for i in learned])
    y = labels[learned]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))[:BINS] for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, np.quantile(v[v > 0], [0, 0.25, 0.5, 0.75]) - 1e-12])) if (v := x[:, j]).max() > 0 else e for j, e in enumerate(edges)]
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(x, y - p, p * (1 - p), edges))
        margin = margin + RATE * apply_tree(trees[-1], x)
    model = Model(learn_lexicon([sample[i] for i in learned]), trees, base, np.zeros(0), np.zeros(0))
    left = np.flatnonzero(rest)
    if len(left):
        margins = model.margin(np.array([model.lexicon.features(sample[i][0]) for i in left]))
        model.margins, model.chances = isotonic(margins, labels[left])
    model.lexicon.memo.clear()
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from at most `rows` labelled rows of labels.toxic; those with crc32(doc_id) mod 5 = 0 are never read."""
    return train(labelled_sample(docs, labels, "toxic", 5, 0, rows))


def with_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the toxicity of each whole text from 0 to 1. Null texts count as empty, and empty ones are scored too;
    repeated rows stay, an empty table stays empty, other columns are not read. Memory follows the longest text."""

    def run(batches):
        for batch in batches:
            scores, texts = [], batch.column(1)
            for at in range(0, len(texts), 200):
                scores.append(model.scores([t.as_py() or "" for t in texts.slice(at, 200)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: SQL can't express the training; tests measure held-out accuracy.
ORACLE_SQL = None
