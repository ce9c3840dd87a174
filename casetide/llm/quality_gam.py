"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by a few ratios over all of it. Each ratio is cut into quantile bins.
Cyclic boosting visits one feature after the other and adds a shallow tree on that feature
alone, so that all its trees sum to one lookup table per feature. The pairs whose residuals
interact most then get two-way tables the same way. A score is a sum of table entries.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of the key; that
bound keeps what the driver receives constant. Scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide.llm.tables import crc32_of_id

#: Labelled rows that the model is fitted on, about, and at most twice as many.
SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "digits", "exclaims", "bars", "stops", "commas",
    "distinct_words", "longest_word", "line_words", "repeated_lines", "other_bytes", "short_words",
)

_BYTES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "space": (32, *range(9, 14)),
    "exclaims": b"!",
    "bars": b"|",
    "stops": b".?!",
    "commas": b",;:",
    "symbols": b"#$%&*+<=>@[\\]^_`{|}~/",
    "high": range(128, 256),
}
_CLASSES = np.zeros((256, len(_BYTES)))
for _i, _members in enumerate(_BYTES.values()):
    _CLASSES[list(_members), _i] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` per text. Null and empty texts are all zeros."""
    counts = np.zeros((len(texts), 256))
    shape = np.zeros((len(texts), 6))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        counts[i] = np.bincount(raw, minlength=256)
        words, lines = text.split(), [x for x in text.split("\n") if x]
        lengths = [len(w) for w in words]
        shape[i] = (
            len(words), len(set(words)), max(lengths, default=0), len(lines), len(set(lines)),
            sum(n <= 3 for n in lengths),
        )
    by = dict(zip(_BYTES, (counts @ _CLASSES).T, strict=True))
    words, distinct, longest, lines, different, short = shape.T
    size = counts.sum(axis=1)
    some, letters = np.maximum(words, 1), np.maximum(by["upper"] + by["lower"], 1)
    out = (
        np.log1p(words), (size - by["space"]) / some, by["upper"] / letters, by["symbols"] / some,
        by["digits"] / some, by["exclaims"] / some, by["bars"] / some, by["stops"] / some, by["commas"] / some,
        distinct / some, longest, words / np.maximum(lines, 1), (lines - different) / np.maximum(lines, 1),
        by["high"] / np.maximum(size, 1), short / some,
    )
    return np.column_stack(out)


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, by adding up the table entries of the bins."""
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for (j, k), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[
                np.searchsorted(self.coarse[j], x[:, j], "right"),
                np.searchsorted(self.coarse[k], x[:, k], "right"),
            ]
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


_CALM = 2.0  # added to the sum of second derivatives of a leaf


def _gain(g, h):
    return g * g / (h + _CALM)


def _stump(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of bins into two, and its gain over no cut."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on the bins of one feature: a value per bin."""
    out = np.zeros(len(g))
    at = _stump(g, h)[1]
    for a, b in ((0, at), (at, len(g))):
        if a < b:
            mid = a + _stump(g[a:b], h[a:b])[1]
            for c, d in ((a, mid), (mid, b)):
                if c < d:
                    out[c:d] = g[c:d].sum() / (h[c:d].sum() + _CALM)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts the first feature, then the second on either side."""
    best, found = -1.0, np.zeros_like(g)
    for at in range(1, len(g)):
        gain, out = 0.0, np.zeros_like(g)
        for rows in (slice(0, at), slice(at, len(g))):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            mid = _stump(gs, hs)[1]
            for cols in (slice(0, mid), slice(mid, len(gs))):
                gain += _gain(gs[cols].sum(), hs[cols].sum())
                out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + _CALM)
        if gain > best:
            best, found = gain, out
    return found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, n_pairs: int = 6) -> Model:
    """Fit on feature rows ``x`` with labels 0 and 1.

    No rows give a model that scores 0.5; labels of one kind give a constant near it.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    columns = range(x.shape[1])
    model.cuts = [_cuts(x[:, j], bins) for j in columns]
    model.coarse = [_cuts(x[:, j], 8) for j in columns]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.coarse)]
    total = np.full(len(y), model.base)

    def slopes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(rounds):
        for j in columns:
            step = rate * _tree(*slopes(fine[j], len(model.tables[j])))
            model.tables[j] += step
            total += step[fine[j]]

    ranked = []
    for j in columns:
        for k in range(j):
            shape = (len(model.coarse[j]) + 1, len(model.coarse[k]) + 1)
            g, h = slopes(rough[j] * shape[1] + rough[k], shape[0] * shape[1])
            ranked.append((float(_gain(g, h).sum()), j, k, shape))
    ranked = sorted(ranked, key=lambda r: (-r[0], r[1:3]))[:n_pairs]
    model.pairs = [r[1:3] for r in ranked]
    model.grids = [np.zeros(r[3]) for r in ranked]
    for _ in range(rounds // 2):
        for i, (_, j, k, shape) in enumerate(ranked):
            cell = rough[j] * shape[1] + rough[k]
            g, h = slopes(cell, shape[0] * shape[1])
            step = rate * _pair_tree(g.reshape(shape), h.reshape(shape))
            model.grids[i] += step
            total += step.ravel()[cell]
    return model


def held_out(key: str) -> Column:
    return F.pmod(crc32_of_id(key), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside the held-out fold.

    Labels other than 0 and 1 and rows without a key are left out; a document with several
    labels counts as the smallest, one with several texts as the smallest feature row.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_y"))
    rows = known.count()
    if rows > sample:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(rows)) < sample)
    # At most twice the sample: a hash share of that size does not stray further.
    known = known.limit(2 * sample)
    measure = F.pandas_udf(lambda s: pd.Series(list(features(s.tolist()))), "array<double>")
    found = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), "_id")
    found = found.select("_id", "_y", measure("_text").alias("_x")).groupBy("_id").agg(F.min("_y").alias("y"), F.min("_x").alias("x"))
    table = found.orderBy("_id").toPandas()
    x = np.array(table["x"].tolist(), float).reshape(len(table), len(FEATURES))
    return fit(x, table["y"].to_numpy(float))


def score(model: Model, text: str = "text") -> Column:
    """Score between 0 and 1 of every whole text, null ones included."""
    add = F.pandas_udf(lambda s: pd.Series(model.score(features(s.tolist()))), "double")
    return add(F.col(text).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    Null and empty texts are scored as a text without words. Rows with equal ids are scored
    one by one; a null id counts as empty text in the fold rule. Without any label the score
    is 0.5. Columns of other names are not read.
    """
    model = train(docs, labels, key, text, label, sample)
    scored = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), score(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    return docs.where(score(train(docs, labels, key, text), text) >= THRESHOLD)
