"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after another. Each model is a logistic regression over the
words of a text and over the probabilities that the models before it gave; in training those
probabilities are out of fold, so a later model sees them as they will be on unseen text.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import PrefixHash, Words, byte_set, byte_symbols, lower_table, mixed
from tidemark.llm.frames import map_texts

#: Letters, digits and all non-ASCII bytes, after lower-casing A-Z.
WORD_BYTES = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words are counted in this many hashed places; the most telling ones become features.
PLACES, FEATURES = 1 << 20, 4096
#: Beginnings of longer words count too, in bytes: inflected forms share them.
STEMS = (5, 6, 7, 8)
#: Labelled rows that the chain is fitted on at most; all rows are scored.
SAMPLE = 8_000
FOLDS, RIDGE, PASSES = 5, 3e-4, 200
#: A word must occur in this many labelled texts to be a feature.
LEAST = 6


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every distinct word, and word beginning, of every row."""
    low = lower_table()[data]
    words = Words(low, offsets, WORD_BYTES)
    hashes = PrefixHash(byte_symbols()[low])
    found = [(words.row, hashes.of(words.start, words.end))]
    for size in STEMS:
        long_ = np.flatnonzero(words.end - words.start > size)
        start = words.start[long_]
        found.append((words.row[long_], mixed(hashes.of(start, start + size))))
    both = np.unique(np.concatenate([r * PLACES + (h % np.uint64(PLACES)).astype(np.int64) for r, h in found]))
    return both // PLACES, both % PLACES


@dataclass
class Chain:
    """Models of a chain, in order: weights of features, of earlier probabilities, intercept, cutoff."""

    categories: list[str]
    features: np.ndarray  # place of each feature, ascending
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    intercept: list[float]
    cutoff: list[float]

    def scores(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Probability of each category for n texts, given their distinct word places."""
        row, feature = known(self.features, row, place)
        out = np.zeros((n, len(self.categories)))
        for k in range(len(self.categories)):
            z = np.bincount(row, self.weights[k][feature], n) + self.intercept[k] + logit(out[:, :k]) @ self.earlier[k]
            out[:, k] = sigmoid(z)
        return out


def known(features: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature numbers of those places that are features."""
    if not len(features):
        return row[:0], place[:0]
    at = np.minimum(np.searchsorted(features, place), len(features) - 1)
    hit = features[at] == place
    return row[hit], at[hit]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_linear(row, feature, extra, y, n_features: int):
    """Ridge logistic regression by accelerated gradient steps; (weights, earlier, intercept).

    Each coordinate's step follows from a diagonal bound of the curvature, so rare words move as
    fast as frequent ones.
    """
    n, k = len(y), extra.shape[1]
    mass = np.bincount(row, minlength=n) + np.abs(extra).sum(axis=1) + 1.0
    bound = 0.25 * np.concatenate([np.bincount(feature, mass[row], n_features), np.abs(extra).T @ mass, [mass.sum()]]) + RIDGE * n
    w = np.zeros(n_features + k + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    ahead, momentum = w.copy(), 1.0
    for _ in range(PASSES):
        gap = sigmoid(np.bincount(row, ahead[feature], n) + extra @ ahead[n_features:-1] + ahead[-1]) - y
        grad = np.concatenate([np.bincount(feature, gap[row], n_features), extra.T @ gap, [gap.sum()]])
        grad[:-1] += RIDGE * n * ahead[:-1]
        new = ahead - grad / bound
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w[:n_features], w[n_features:-1], float(w[-1])


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The cutoff with the best F1 on out-of-fold probabilities, between two of them."""
    if not y.sum() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = y[order].cumsum()
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(row, place, labels: dict[str, np.ndarray], fold: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The chain and its out-of-fold probabilities.

    Features are the places whose words tell most about some category (by the chi-square of
    presence and label). They are chosen again inside every fold, from its training part.
    """
    names = list(labels)
    targets = np.stack([labels[c] for c in names], axis=1).astype(float)
    n = len(targets)

    def chosen(rows: np.ndarray) -> np.ndarray:
        take = rows[row]
        seen = np.bincount(place[take], minlength=PLACES).astype(float)
        best = np.zeros(PLACES)
        for k in range(len(names)):
            hit = np.bincount(place[take], targets[row[take], k], PLACES)
            share = targets[rows, k].mean() if rows.any() else 0.0
            spread = np.maximum(seen * share * (1 - share), 1e-9)
            best = np.maximum(best, np.where(seen >= LEAST, (hit - seen * share) ** 2 / spread, 0))
        return np.sort(np.argsort(-best, kind="stable")[:min(FEATURES, int((best > 4).sum()))])

    def fit(rows: np.ndarray, features: np.ndarray, k: int, before: np.ndarray):
        at = np.cumsum(rows) - 1
        r, f = known(features, row[rows[row]], place[rows[row]])
        return fit_linear(at[r], f, logit(before[rows]), targets[rows, k], len(features))

    folds = [(fold != f) for f in range(FOLDS)]
    picks = [chosen(rows) for rows in folds]
    out = np.zeros((n, len(names)))
    every = chosen(np.ones(n, bool))
    chain = Chain(names, every, [], [], [], [])
    for k in range(len(names)):
        for rows, features in zip(folds, picks):
            if rows.all() or not rows.any():
                continue
            w, e, c = fit(rows, features, k, out[:, :k])
            r, f = known(features, row, place)
            z = np.bincount(r, w[f], n) + logit(out[:, :k]) @ e + c
            out[~rows, k] = sigmoid(z)[~rows]
        w, e, c = fit(np.ones(n, bool), every, k, out[:, :k])
        for to, x in zip((chain.weights, chain.earlier, chain.intercept, chain.cutoff), (w, e, c, best_cutoff(out[:, k], targets[:, k]))):
            to.append(x)
    return chain, out


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id: str, text: str, sample: int):
    """(rows, places, labels, folds) of at most ``sample`` labelled rows, picked by the hash of their id."""
    marked = labels.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("_l"), *[c.cast("int").alias(f"y_{k}") for k, c in categories.items()]).dropna()
    total = marked.count()
    part = F.pmod(F.xxhash64("_l"), F.lit(1 << 20))
    if total > sample:  # the sample's bound is a parameter, the models' quality levels off
        marked = marked.where(part < int((1 << 20) * sample / total))
    places = map_texts(docs.select(F.col(f"`{id}`").alias("_i"), F.col(f"`{text}`").alias("_t")).join(
        marked, F.col("_i") == F.col("_l")), ["_i", *[f"y_{k}" for k in categories]], "_t", "places array<int>", _places)
    # Order by the id's hash and cut: a tie or repeated id cannot exceed the bound.
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_i"), F.lit(FOLDS)).alias("fold")
    rows = places.select("*", fold).orderBy(F.xxhash64("_i"), "_i", F.hash("places")).limit(sample).toPandas()
    fold = rows["fold"].to_numpy()
    size = np.array([len(p) for p in rows["places"]], np.int64)
    place = np.concatenate([np.zeros(0, np.int32), *rows["places"]]).astype(np.int32)
    return np.repeat(np.arange(len(rows), dtype=np.int32), size), place, {k: rows[f"y_{k}"].to_numpy() for k in categories}, fold


def _places(data: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    row, place = word_places(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(place, pa.int32()))]


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id: str = "doc_id", text: str = "text",
             sample: int = SAMPLE) -> DataFrame:
    """id, then for each category its probability p_<category> and verdict is_<category>, for every row.

    ``categories`` are boolean columns of ``labels``, in the order of the chain. Without labelled
    rows all probabilities are 0.5 and all verdicts false. Null and empty texts have no words
    and get the base rate; rows with null or repeated ids are scored as they are. The chain is
    fitted on at most ``sample`` labelled rows on the driver; every whole text is scored in one map.
    """
    row, place, y, fold = training_rows(docs, labels, categories, id, text, sample)
    n = len(fold)
    chain, _ = fit_chain(row, place, y, fold) if n else (None, None)
    names = list(categories)

    def score(data, offsets):
        r, p = word_places(data, offsets)
        size = len(offsets) - 1
        found = chain.scores(r, p, size) if chain else np.full((size, len(names)), 0.5)
        out = []
        for k in range(len(names)):
            out += [found[:, k], found[:, k] >= chain.cutoff[k] if chain else np.zeros(size, bool)]
        return out

    return map_texts(docs, [id], text, ", ".join(f"p_{k} double, is_{k} boolean" for k in names), score)
