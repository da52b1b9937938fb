"""Quality classifier from positive and unlabelled documents.

A linear model on shape features of the whole text minimises the non-negative unbiased risk
(Kiryo et al., 2017): prior * loss of the positives, plus the loss of the unlabelled as negatives
less prior * that of the positives as negatives, held at zero from below. The class prior is
estimated from the same two sets (Blanchard et al., 2010). Labels of 0 are never used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import prepare, released

MOST_POSITIVES = 20_000  # bound on the sampled trusted positives
MOST_UNLABELLED = 20_000  # bound on the sampled unlabelled documents
STEPS, RATE, DECAY = 600, 0.05, 1e-4
THRESHOLD = 0.3

_KINDS = ["lower", "upper", "digit", "blank", "line", "stop", "comma", "exclaim", "bar", "symbol", "quote", "other"]


@cache
def _kind_of() -> np.ndarray:
    """The kind of every code point of the basic plane; beyond it, other."""
    marks = {".": "stop", "?": "stop", ",": "comma", ";": "comma", ":": "comma", "!": "exclaim", "|": "bar",
             "\n": "line", "'": "quote", '"': "quote", "-": "quote", "(": "quote", ")": "quote"}

    def kind(c: str) -> str:
        if c in marks:
            return marks[c]
        if c.isspace():
            return "blank"
        general = unicodedata.category(c)
        if general in ("Lu", "Lt"):
            return "upper"
        if general[0] in "LM":
            return "lower"
        if general[0] == "N":
            return "digit"
        return "symbol" if general[0] in "PS" else "other"

    return np.array([_KINDS.index(kind(chr(i))) if not 0xD800 <= i < 0xE000 else len(_KINDS) - 1
                     for i in range(1 << 16)], dtype=np.uint8)


def features(text: str | None) -> list[float]:
    """Shares and rates of a whole text; none grows with its length but the two logarithms."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    kinds = _kind_of()[np.minimum(codes, 0xFFFF)]
    n = dict(zip(_KINDS, np.bincount(kinds, minlength=len(_KINDS)).tolist(), strict=True))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    chars, n_words = max(len(text), 1), max(len(words), 1)
    letters = n["lower"] + n["upper"]
    distinct = len(set(words))
    rates = [n["exclaim"] / n_words, n["bar"] / n_words, n["symbol"] / n_words, n["digit"] / n_words,
             n["stop"] / n_words, n["comma"] / n_words, n["quote"] / n_words]
    return [
        n["upper"] / max(letters, 1), letters / chars, n["digit"] / chars, n["other"] / chars,
        *(min(r, 1.0) for r in rates), *(min(10 * r, 1.0) for r in rates),
        min(letters / n_words, 20.0), np.log1p(len(words)), np.log1p(distinct) / np.log1p(n_words),
        len(lines) / n_words, len(set(lines)) / max(len(lines), 1), float(not words),
        sum(map(str.__eq__, words, words[1:])) / n_words,
    ]


def _feature_frames(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_with_one((x - self.mean) / self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip(x, -8, 8), np.ones((len(x), 1))])


def _descend(gradient, size: int) -> np.ndarray:
    """Adam on the whole sample."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two shares above a
    score, over scores that keep half of the positives or more, where the scores come from telling
    the two sets apart. A margin of one standard error keeps noise from lowering it."""
    x = np.vstack([positives, unlabelled])
    y = np.append(np.ones(len(positives)), np.zeros(len(unlabelled)))
    each = np.where(y == 1, 0.5 / len(positives), 0.5 / len(unlabelled))
    w = _descend(lambda w: x.T @ (each * (_sigmoid(x @ w) - y)) + DECAY * w, x.shape[1])
    scores = _sigmoid(x @ w)
    p, u = np.sort(scores[y == 1]), np.sort(scores[y == 0])
    cuts = np.quantile(p, np.linspace(0, 0.5, 101))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(above_u * (1 - above_u) / len(u)) + np.sqrt(above_p * (1 - above_p) / len(p))
    return float(np.clip(np.min((above_u + error) / above_p), 0.01, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """Minimise the non-negative unbiased risk with the logistic loss. Without any positive
    the model is constant: it scores 1, so nothing is rejected for want of labels."""
    both = np.vstack([positives, unlabelled])
    if not len(positives) or not len(unlabelled):
        width = len(features(""))
        return QualityModel(np.zeros(width), np.ones(width), np.append(np.zeros(width), 40.0), 1.0)
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = _with_one((positives - mean) / scale), _with_one((unlabelled - mean) / scale)
    prior = estimate_prior(p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        fp, fu = _sigmoid(p @ w), _sigmoid(u @ w)
        as_positive = p.T @ (fp - 1) / len(p)
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        of_negative = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)
        # below zero the negative part has been fitted to noise: step back from it
        return prior * as_positive + of_negative + DECAY * w if negative >= 0 else -of_negative

    return QualityModel(mean, scale, _descend(gradient, p.shape[1]), prior)


def train_quality(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  may_learn: Column, most_positives: int = MOST_POSITIVES,
                  most_unlabelled: int = MOST_UNLABELLED) -> QualityModel:
    """Fit on a sample by hash of at most about ``most_positives`` documents labelled 1 and about
    ``most_unlabelled`` documents whatever their label, both only from rows where ``may_learn``
    (a column over the id). The sampled ids travel to the documents, not the texts to the labels."""
    prepare(documents.sparkSession)

    def sampled(rows: DataFrame, bound: int) -> DataFrame:
        chance = min(1.0, bound / max(rows.count(), 1))
        return rows.where(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30)) < int(chance * (1 << 30)))

    trusted = sampled(labels.where((F.col(label_col) == 1) & may_learn).select(id_col).distinct(), most_positives)
    named = documents.select(F.col(id_col), F.col(text_col).alias("_tw_text")).where(may_learn)
    chance = min(1.0, most_unlabelled / max(documents.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit(6), id_col), F.lit(1 << 30)) < int(chance * (1 << 30))
    trusted = trusted.select(id_col, F.lit(True).alias("_tw_trusted"))  # a bounded sample
    marked = named.join(F.broadcast(trusted), id_col, "left").withColumn("_tw_drawn", drawn).where("_tw_trusted or _tw_drawn")
    @F.pandas_udf("array<double>")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(_feature_frames)(batches)

    rows = marked.select("_tw_trusted", "_tw_drawn", of_text("_tw_text").alias("_tw_x")).toPandas()
    x = np.array(rows["_tw_x"].tolist(), dtype=float).reshape(len(rows), len(features("")))
    return fit(x[rows["_tw_trusted"].eq(True).to_numpy(bool)], x[rows["_tw_drawn"].eq(True).to_numpy(bool)])


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score of a text, 0 to 1; null counts as empty, whatever the length all of it is read."""
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(model.mean))
            yield pd.Series(model.score(x))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(scores)(batches)

    return score(text)
