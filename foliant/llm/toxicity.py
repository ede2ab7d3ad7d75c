"""Toxicity categories by a chain of linear models.

Category after category is predicted by a logistic model on the words of a
text and the probabilities of the categories before it. While the chain is
trained, those probabilities come from models that have not seen the row
(out-of-fold); the models that score the corpus are fitted on the whole sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.textops import chunks, word_hashes

#: The chain in order: category and the condition on a label row that makes it positive.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
#: Labelled rows that the classifier is fitted on at most, taken by a hash of their ids.
SAMPLE = 20_000
#: Words in the models at most, and the least chi-square value of a word with a category.
FEATURES, LEAST_CHI2, LEAST_DOCS = 512, 30.0, 5
FOLDS = 3
RIDGE = 0.1
THRESHOLD = 0.5


def _distinct_words(text: pa.Array) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(first row, distinct words of each row, their counts)."""
    for i, j, data, offsets in chunks(text):
        words, rows = word_hashes(data, offsets, plain=True)
        own = [np.unique(words[rows[r] : rows[r + 1]], return_counts=True) for r in range(j - i)]
        yield i, [w for w, _ in own], [n for _, n in own]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, one sum for each category) of the documents that have a word, combined by batch."""
    for batch in batches:
        labels = np.array([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 1)], np.int64)
        words, owner = [], []
        for i, own, _ in _distinct_words(batch.column("text")):
            words += own
            owner += [np.full(len(w), i + r) for r, w in enumerate(own)]
        if not words:
            continue
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        row = np.concatenate(owner)
        sums = [np.bincount(at, labels[c][row], len(word)).astype(np.int64) for c in range(len(labels))]
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, minlength=len(word))), *map(pa.array, sums)], ["word", "n", *(f"y{k}" for k in range(len(labels)))])


def _vectors(features: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the matrix of log(1 + count) of the feature words, rows by bounded pieces."""
    for batch in batches:
        for i, own, counts in _distinct_words(batch.column("text")):
            x = np.zeros((len(own), len(features)), np.float32)
            if len(features):
                size = [len(w) for w in own]
                words, n = np.concatenate(own), np.concatenate(counts)
                at = np.minimum(np.searchsorted(features, words), len(features) - 1)
                hit = np.flatnonzero(features[at] == words)
                x[np.repeat(np.arange(len(own)), size)[hit], at[hit]] = np.log1p(n[hit])
            yield batch.slice(i, len(own)), x


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic model by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))[:, None]


@dataclass
class Chain:
    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(categories, rows) probabilities, each from the words and those before it."""
        out = []
        for w in self.weights:
            p = probability(w, x)
            out.append(p)
            x = np.hstack([x, _logit(p)])
        return np.array(out).reshape(len(self.weights), len(x))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """The weights of each category's model; labels: (categories, rows)."""
    weights = []
    for y in labels:
        weights.append(fit(x, y))
        held = np.full(len(y), y.mean() if len(y) else 0.0)
        for k in range(FOLDS):
            own = folds == k
            if own.any() and not own.all():
                held[own] = probability(fit(x[~own], y[~own]), x[own])
        x = np.hstack([x, _logit(held)])
    return weights


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = SAMPLE) -> Chain:
    """A chain for documents (id, text) from label rows (id and the columns that the conditions read).

    At most sample labelled ids are used (a documented bound, which is what
    makes the broadcast of their labels and the matrix on the driver bounded);
    the words are chosen on the sample's whole texts. Of several label rows of
    an id a positive one counts; document rows that repeat a labelled id are
    rows of the sample each. Null texts and null ids teach nothing, empty and
    very long texts are rows like others; equal scores of words go by the
    word's hash. Further columns of docs go. Without labelled rows every
    probability is 0.
    """
    categories = categories or CATEGORIES
    names = [f"y{k}" for k in range(len(categories))]
    flags = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(n) for n, c in zip(names, categories.values())]
    chosen = labels.filter("id is not null").groupBy("id").agg(*flags).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select("id", "text").filter("text is not null").join(F.broadcast(chosen), "id").select("text", *names, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))
    counts = rows.select("text", *names).mapInArrow(_word_counts, f"word long, n long, {', '.join(f'{n} long' for n in names)}")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).filter(F.col("n") >= LEAST_DOCS)
    total = rows.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not total["n"]:
        return Chain(list(categories), np.zeros(0, np.uint64), [])

    def chi2(name: str) -> F.Column:
        n, pos, a, b = float(total["n"]), float(total[name]), F.col(name), F.col("n")
        # The 2 x 2 table of word and category: n (a d - b c)^2 / product of the sums of rows and columns.
        spread = b * (n - b) * pos * (n - pos)
        return F.when(spread > 0, n * F.pow(a * n - b * pos, 2) / spread).otherwise(0.0)

    scored = counts.withColumn("chi2", F.greatest(*[chi2(n) for n in names]) if len(names) > 1 else chi2(names[0]))
    best = scored.filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").limit(FEATURES).select("word")
    features = np.sort(np.array([r["word"] for r in best.collect()], np.int64).view(np.uint64))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _vectors(features, batches):
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), max(1, x.shape[1])) if x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat.cast(pa.list_(pa.float32()))], [*batch.schema.names[1:], "x"])

    data = rows.mapInArrow(matrix, f"{', '.join(f'{n} int' for n in names)}, fold int, x array<float>").toArrow()
    x = data.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(data.num_rows, len(features))
    columns = {c: data.column(c).to_numpy() for c in [*names, "fold"]}
    return Chain(list(categories), features, fit_chain(x, np.array([columns[n] for n in names], float), columns["fold"]))


def score(docs: DataFrame, chain: Chain, keys: list[str], text: str = "text") -> DataFrame:
    """The columns keys of each row with p_<category> for each category of the chain and flags p >= THRESHOLD named by category.

    A null text counts as empty and gets the probabilities of a text without
    known words. Very long texts are counted whole; equal texts, and rows that
    stand twice, are scored each, alike. Columns other than keys go, whatever
    their names; a key may not be named like a result. An empty table gives an
    empty one.
    """
    rows = docs.select(*keys, F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, x in _vectors(model.features, batches):
            p = model.predict(x) if model.weights else np.zeros((len(names), len(x)))
            kept = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(q.astype(np.float64)) for q in p]], [*keys, *names])

    out = rows.mapInArrow(scored, f"{schema}, {', '.join(f'{n} double' for n in names)}")
    return out.withColumns({c: F.col(f"p_{c}") >= THRESHOLD for c in chain.categories})
