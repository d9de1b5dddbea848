"""Toxicity: cumulative-link ordinal regression over sparse text features.

A document's features are its distinct words, without signs around them and in lower case, and their beginnings of four to six
letters, which carry a stem over to endings that were never seen. Features are chosen in the labelled sample by how surely they
occur more often on one side of the label. The labels only say toxic or not, so severity grades are made of them: 0 where the label
is 0; where it is 1, one grade for each third of how much chosen evidence a document has.

The model has one weight per feature, shared by all thresholds: P(grade > k) = sigmoid(w x - t_k), with t_0 < t_1 < t_2. The likelihood
of the grades, P(grade = k) = P(grade > k - 1) - P(grade > k), is fitted by proximal gradient steps with an L1 penalty, so that most
weights are exactly 0. Severity is the expected grade, 0 to 3; a document
is toxic where P(grade > 0) reaches the threshold.

The fit reads at most labelled.SAMPLE labelled rows outside fold 2, without near copies among them, and keeps at most FEATURES
features; every document is scored over its whole text. Null and empty texts have no features. Without labels of both classes, every
severity is 0. Repeated rows are scored each; a document with two labels counts with both; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import map_rows
from .quality import keep_where, sigmoid

GRADES = 3
BEGINNINGS = (4, 5, 6)
FEATURES, LEAST_DOCUMENTS, LEAST_Z = 4_000, 3, 4.0
STEPS, RATE, PENALTY = 600, 0.5, 3e-5
#: Between thresholds.
LEAST_GAP = 0.01
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»“”‘’„¡¿–—"
MOST_WORDS = 500_000


def features(chunk: str) -> list[str]:
    """Of what stands between white space: the word and, marked by a sign that no word keeps at its end, its beginnings."""
    word = chunk.strip(SIGNS).lower()
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)] if word else []


class Weights(dict):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, chunk: str) -> tuple[tuple[str, float], ...]:
        w = tuple((f, self.weights[f]) for f in features(chunk) if f in self.weights)
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(chunk) < 100:
            self[chunk] = w
        return w


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_chunks"}

    def exceeding(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for k = 0..GRADES-1, a row per text."""
        if not hasattr(self, "_chunks"):
            self._chunks = Weights(self.weights)
        of = self._chunks.__getitem__
        z = np.array([math.fsum(dict(f for c in filter(None, map(of, set(t.split()))) for f in c).values()) for t in texts], dtype=np.float64)
        if not np.isfinite(self.thresholds).all():
            return np.zeros((len(texts), GRADES))
        return sigmoid(z[:, None] - self.thresholds[None, :])


def without_copies(texts: Iterable[tuple[str, int]]) -> Iterator[tuple[set[str], int]]:
    """Distinct words and label of each text that is no near copy of an earlier one: else the words of a copied text would count as
    evidence. Texts are near copies here if two of four minima over hashed word triples agree."""
    seen: list[set[int]] = [set() for _ in range(4)]
    for text, label in texts:
        words = text.split()
        triples = np.array([*map(crc32, map(str.encode, words))], dtype=np.uint64)
        if len(triples) >= 3:
            triples = triples[:-2] * np.uint64(0x9E3779B97F4A7C15) + triples[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + triples[2:]
        minima = [int(((triples ^ np.uint64(k * 0x51ED2701)) * np.uint64(0xD6E8FEB86659FD93)).min()) if len(triples) else 0 for k in range(4)]
        if sum(m in held for m, held in zip(minima, seen, strict=True)) < 2:
            yield set(words), label
        for m, held in zip(minima, seen, strict=True):
            held.add(m)


def chosen_features(docs: np.ndarray, ids: np.ndarray, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Features with the surest difference between the classes' document shares. The presences are given by (doc, feature id)."""
    n, share = len(toxic), toxic.mean()
    seen = np.bincount(ids, minlength=n_features).astype(np.float64)
    seen_toxic = np.bincount(ids[toxic[docs] == 1], minlength=n_features).astype(np.float64)
    z = np.abs(seen_toxic - seen * share) / np.sqrt(seen * share * (1 - share) * (1 - seen / n) + 1e-9)
    z[seen < LEAST_DOCUMENTS] = 0
    best = np.lexsort((np.arange(n_features), -z))[:FEATURES]
    return best[z[best] >= LEAST_Z]


def grades_of(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for label 0; 1 to GRADES for label 1, by thirds of the evidence."""
    grade = np.zeros(len(toxic), dtype=np.int64)
    cuts = np.quantile(evidence[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grade[toxic == 1] = 1 + np.searchsorted(cuts, evidence[toxic == 1], side="right")
    return grade


def loss_and_gradients(z: np.ndarray, t: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, P(grade = k) = P(grade > k - 1) - P(grade > k), and its gradients by z and t (each
    times the number of rows for z)."""
    n, above = len(grades), sigmoid(z[:, None] - t[None, :])
    edge = np.c_[np.ones(n), above, np.zeros(n)]  # P(grade > k - 1) for k = 0..GRADES, and 0
    slope = edge * (1 - edge)
    rows = np.arange(n)
    p = np.maximum(edge[rows, grades] - edge[rows, grades + 1], 1e-12)
    upper, lower = slope[rows, grades] / p, slope[rows, grades + 1] / p
    by_t = np.zeros(GRADES)
    np.add.at(by_t, np.maximum(grades - 1, 0), np.where(grades > 0, upper, 0))
    np.add.at(by_t, np.minimum(grades, GRADES - 1), np.where(grades < GRADES, -lower, 0))
    return float(-np.log(p).mean()), lower - upper, by_t / n


def fit_ordinal(doc: np.ndarray, place: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by proximal AdaGrad on the likelihood. The presences are given by (doc, place)."""
    n = len(grades)
    above = (grades[:, None] > np.arange(GRADES)[None, :]).astype(np.float64)
    w, squares = np.zeros(n_features), np.full(n_features, 1e-12)
    share = np.clip(above.mean(axis=0), 0.5 / n, 1 - 0.5 / n)
    t, squares_t = -np.log(share / (1 - share)), np.full(GRADES, 1e-12)
    for _ in range(STEPS):
        z = np.bincount(doc, weights=w[place], minlength=n)
        _, by_z, grad_t = loss_and_gradients(z, t, grades)
        grad = np.bincount(place, weights=by_z[doc], minlength=n_features) / n
        squares += grad * grad
        rate = RATE / np.sqrt(squares)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - PENALTY * rate, 0)
        squares_t += grad_t * grad_t
        t = t - RATE / np.sqrt(squares_t) * grad_t
        t = t[0] + np.r_[0, np.cumsum(np.maximum(np.diff(t), LEAST_GAP))]
    return w, t


def fit(rows: Iterable[tuple[str, int]]) -> ToxicityModel:
    names: dict[str, int] = {}
    docs, labels = [], []
    for words, label in without_copies(rows):
        docs.append(np.unique([names.setdefault(f, len(names)) for w in words for f in features(w)]).astype(np.int32))
        labels.append(label)
    toxic = (np.array(labels, dtype=np.int64) > 0).astype(np.int64)
    if len(set(toxic.tolist())) < 2 or not names:
        return ToxicityModel()
    doc, ids = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs]), np.concatenate(docs)
    docs.clear()
    chosen = chosen_features(doc, ids, toxic, len(names))
    place_of = np.full(len(names), -1)
    place_of[chosen] = np.arange(len(chosen))
    doc, place = doc[place_of[ids] >= 0], place_of[ids][place_of[ids] >= 0]
    # evidence: chosen features that the toxic side has more often
    lean = np.bincount(place, weights=toxic[doc] - toxic.mean(), minlength=len(chosen))
    evidence = np.bincount(doc, weights=lean[place] > 0, minlength=len(toxic))
    w, t = fit_ordinal(doc, place, grades_of(evidence, toxic), len(chosen))
    by_place = {int(c): k for k, c in enumerate(chosen)}
    return ToxicityModel({f: float(w[by_place[i]]) for f, i in names.items() if i in by_place and w[by_place[i]]}, t)


def score_documents(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, severity (expected grade), p_toxic, grade (the likeliest) and toxic."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(ids, texts):
        p = sent.value.exceeding(texts)
        each = np.c_[np.ones(len(texts)), p] - np.c_[p, np.zeros(len(texts))]
        return ids, p.sum(axis=1), p[:, 0], each.argmax(axis=1).astype(np.int32), p[:, 0] >= threshold

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_rows(rows, "doc_id long, severity double, p_toxic double, grade int, toxic boolean", work)


def keep_clean(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return keep_where(documents, model, lambda m, texts: m.exceeding(texts)[:, 0] < threshold, text_col)


def model_for(documents: DataFrame, labels: DataFrame, most: int = labelled.SAMPLE) -> ToxicityModel:
    return fit(labelled.sample(documents, labels, "toxic", most))
