"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network with calibrated probabilities.

A word has a form (as written) and a shape (runs of letters and digits folded, signs kept). Each form and shape gets a sparse random
index vector from a hash of itself; a context vector is the sum of the index vectors that stand within two words of it in the
labelled sample. A document's input is the mean of its words' vectors, with how many of its words and lines are distinct and how
many words there are. A network of one hidden layer is trained on most of the sample; on the rest, one temperature is fitted that
divides the logits, so that scores can be read as probabilities.

The fit reads at most labelled.SAMPLE labelled rows of the folds that may be learned from; every document is scored over its whole
text. Null texts count as empty, and an empty text has a score too. Without labels of both classes, all scores are their mean (0.5
without any). The model knows at most VOCABULARY words and MOST_SHAPES shapes, of which the first 12 signs count; it is broadcast.
Repeated rows are scored each; a document with two labels counts with both; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import map_rows

DIMENSIONS, NONZERO, WINDOW = 48, 4, 2
VOCABULARY, LEAST_COUNT, MOST_SHAPES = 20_000, 5, 500
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 0.01, 1e-4
RUN = re.compile(r"([A-Z])[A-Z]+|([^\W\d_A-Z])[^\W\d_A-Z]+|(\d)\d+|(.)\4{2,}")
MOST_WORDS = 500_000


def shape(word: str) -> str:
    """Upper case runs as A, other letter runs as a, digits as 0; any other sign three times where it is repeated more often."""
    folded = RUN.sub(lambda m: "AA" if m[1] else "aa" if m[2] else "00" if m[3] else m[4] * 3, word)
    folded = re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", folded))
    return "".join("a" if c.isalpha() and c != "A" else c for c in folded)[:12]


def index_vector(token: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token.encode()))
    v = np.zeros(DIMENSIONS, dtype=np.float32)
    v[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


class Rows(dict):
    """The row of a word's vector: that of its form if known, else of its shape, else 0."""

    def __init__(self, forms: dict[str, int], shapes: dict[str, int]):
        super().__init__()
        self.forms, self.shapes = forms, shapes

    def __missing__(self, word: str) -> int:
        row = self.forms.get(word)
        if row is None:
            row = self.shapes.get(shape(word), 0)
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) < 100:
            self[word] = row
        return row


@dataclass
class QualityModel:
    forms: dict[str, int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, DIMENSIONS), dtype=np.float32))
    network: list[np.ndarray] | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0
    prior: float = 0.5

    def rows(self) -> Rows:
        if not hasattr(self, "_rows"):
            self._rows = Rows(self.forms, self.shapes)
        return self._rows

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_rows"}

    def inputs(self, texts: list[str]) -> np.ndarray:
        rows, out = self.rows().__getitem__, np.zeros((len(texts), DIMENSIONS + 4), dtype=np.float32)
        for k, text in enumerate(texts):
            words = text.split()
            if words:
                total = np.zeros(DIMENSIONS, dtype=np.float64)
                for at in range(0, len(words), 100_000):
                    total += self.vectors[list(map(rows, words[at : at + 100_000]))].sum(axis=0)
                lines = [x for x in text.split("\n") if x]
                distinct = len(set(words))
                out[k, :DIMENSIONS] = total / len(words)
                out[k, DIMENSIONS:] = np.log1p(len(words)), distinct / len(words), np.log1p(distinct), len(set(lines)) / max(1, len(lines))
        return out

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.network
        return np.tanh(np.clip((inputs - self.mean) / self.spread, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.logits(self.inputs(texts)).astype(np.float64) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learn_vectors(texts: list[str]) -> QualityModel:
    """Context vectors of the frequent forms and of the shapes; row 0 is for words of neither."""
    forms, shapes, kinds = Counter(), Counter(), {}
    for text in texts:
        forms.update(text.split())
    for word, n in forms.items():
        kinds[word] = shape(word)
        shapes[kinds[word]] += n
    by_count = lambda c, most: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= LEAST_COUNT]
    known, known_shapes = by_count(forms, VOCABULARY), by_count(shapes, MOST_SHAPES)
    shape_row = {s: k + 1 for k, s in enumerate(known_shapes)}
    form_row = {w: k + 1 + len(shape_row) for k, w in enumerate(known)}
    n = 1 + len(shape_row) + len(form_row)
    index = np.zeros((n, DIMENSIONS), dtype=np.float32)
    shape_of = np.zeros(n, dtype=np.int64)
    for s, row in shape_row.items():
        index[row], shape_of[row] = index_vector(f"shape {s}"), row
    for w, row in form_row.items():
        shape_of[row] = shape_row.get(kinds[w], 0)
        index[row] = index_vector(f"form {w}") + index[shape_of[row]]
    rows, context = Rows(form_row, shape_row), np.zeros((n, DIMENSIONS), dtype=np.float64)
    held: list[int] = []

    def add() -> None:
        ids = np.array(held)
        held.clear()
        for step in range(1, WINDOW + 1):
            a, b = ids[:-step], ids[step:]
            code, count = np.unique(np.r_[a * n + b, b * n + a], return_counts=True)
            word, near = code // n, code % n
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            context[word[begins]] += np.add.reduceat(index[near] * count[:, None], begins, axis=0)

    for text in texts:
        held += map(rows.__getitem__, text.split())
        held += [0] * WINDOW
        if len(held) > 200_000:
            add()
    if held:
        add()
    whole = np.zeros_like(context)  # a shape's context is that of all its words
    np.add.at(whole, shape_of, context)
    for row in shape_row.values():
        context[row] = whole[row]
    context[0] = 0
    context -= context.sum(axis=0) / max(1.0, np.abs(context).sum()) * np.abs(context).sum(axis=1, keepdims=True)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    vectors = unit(context) + unit(index.astype(np.float64)) * 0.5
    vectors[len(shape_row) + 1 :] += vectors[shape_of[len(shape_row) + 1 :]]
    vectors[0] = 0
    return QualityModel(form_row, shape_row, vectors.astype(np.float32))


def train(inputs: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Adam on the cross-entropy of one tanh layer."""
    d = inputs.shape[1]
    params = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), BATCH):
            x, y = inputs[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            h = np.tanh(x @ params[0] + params[1])
            g = (sigmoid(h @ params[2] + params[3]) - y) / len(y)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [x.T @ back + DECAY * params[0], back.sum(axis=0), h.T @ g + DECAY * params[2], g.sum()]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] = params[k] - RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return params


def fit(rows: list[tuple[str, int]], seed: int = 0) -> QualityModel:
    labels = np.array([y for _, y in rows], dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        return QualityModel(prior=float(labels.mean()) if len(labels) else 0.5)
    model = learn_vectors([t for t, _ in rows])
    inputs = model.inputs([t for t, _ in rows]).astype(np.float64)
    model.prior, model.mean, model.spread = float(labels.mean()), inputs.mean(axis=0), inputs.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    kept = rng.random(len(rows)) < 0.2  # for the temperature
    scaled = np.clip((inputs - model.mean) / model.spread, -8, 8)
    model.network = train(scaled[~kept], labels[~kept], rng)
    if kept.any():
        z, y = model.logits(inputs[kept]), labels[kept]
        loss = lambda t: -np.mean(y * np.log(sigmoid(z / t) + 1e-9) + (1 - y) * np.log(1 - sigmoid(z / t) + 1e-9))
        model.temperature = float(min(np.geomspace(0.5, 8, 49), key=loss))
    return model


def score_documents(documents: DataFrame, model: QualityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score and predicted (1 where the score reaches the threshold)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(ids, outs, texts):
        scores = sent.value.scores(texts)
        return ids, outs, scores, (scores >= threshold).astype(np.int32)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), labelled.held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", work)


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return keep_where(documents, model, lambda m, texts: m.scores(texts) >= threshold, text_col)


def keep_where(documents: DataFrame, model, decide, text_col: str) -> DataFrame:
    """The rows for whose texts decide(model, texts) is true."""
    import pyarrow as pa

    from .common import slices, tidied

    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(np.asarray(decide(sent.value, texts), dtype=bool)))

    return documents.mapInArrow(tidied(run, decide.__module__), documents.schema)


def model_for(documents: DataFrame, labels: DataFrame, most: int = labelled.SAMPLE) -> QualityModel:
    return fit([*labelled.sample(documents, labels, "quality", most)])
