"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text is turned into a few statistics (shares on the logit scale, counts on the log
scale). Per class, means and covariances come from one distributed pass over all labelled rows:
each task adds up moments, Spark sums them, and only the sums (a few hundred numbers, however
large the input) reach the driver. Covariances are shrunk toward the pooled one and its
diagonal, their Cholesky factors are cached in the model, and a score is the logistic of
the difference of the two Mahalanobis log-densities plus the log of the class ratio.

Defined cases: a null text counts as empty and is scored like any text; a document labelled
several times has the label of the majority, and none on a tie; null labels, null ids and
labels without a document teach nothing; a class with fewer than two rows takes the pooled
covariance; with no row of one class every score is the smoothed share of label 1; repeated
rows get equal scores; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

STATISTICS = (
    "words", "word_length", "word_spread", "distinct_words", "lines", "line_words", "distinct_lines",
    "upper", "digits", "marks", "shouts", "symbols", "bars", "other_bytes", "closed_words",
)
#: Scores from here on count as good.
THRESHOLD = 0.3
#: Share of the pooled covariance in that of a class, and of its diagonal in the pooled one.
TOWARD_POOLED, TOWARD_DIAGONAL = 0.5, 0.3

_UPPER, _DIGIT, _MARK, _SHOUT, _SYMBOL, _BAR, _OTHER, _SPACE, _PLAIN = range(9)
_KIND = np.full(256, _PLAIN, np.uint8)
for _kind, _bytes in ((_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_MARK, b".,;:'\"()-"),
                      (_SHOUT, b"!?"), (_SYMBOL, b"#$%&*+/<=>@[\\]^_`{}~"), (_BAR, b"|"), (_SPACE, b" \t\n\v\f\r")):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = _OTHER
_CLOSING = np.isin(np.arange(256), list(b"!?#$%&*+/<=>@[\\]^_`{}~|"))


def _logit(share: float) -> float:
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = text.encode() if isinstance(text, str) else b""
    data = np.frombuffer(raw, np.uint8)
    kinds = _KIND[data]
    counts = np.bincount(kinds, minlength=9)
    dense = max(1, len(data) - int(counts[_SPACE]))
    inside = np.r_[False, kinds != _SPACE, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    words = len(starts)
    length = (ends - starts).astype(float)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda part, whole: _logit(part / whole if whole else 0.0)
    return [
        float(np.log1p(words)),
        float(np.log1p(length.mean())) if words else 0.0,
        float(np.log1p(length.std())) if words else 0.0,
        float(np.log1p(len(set(raw.split())))) - float(np.log1p(words)),
        float(np.log1p(len(lines))),
        float(np.log1p(words / max(1, len(lines)))),
        float(np.log1p(len(set(lines)))) - float(np.log1p(len(lines))),
        *[share(counts[k], dense) for k in (_UPPER, _DIGIT, _MARK, _SHOUT, _SYMBOL, _BAR, _OTHER)],
        share(int(_CLOSING[data[ends - 1]].sum()) if words else 0, words),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and statistics ``x`` of every row, written once."""
    return settle(docs.select(F.col(id_column).alias("id"), _statistics(F.col(text)).alias("x")), "statistics")


@dataclass
class Discriminant:
    """A fitted model; ``whiten`` holds the inverse Cholesky factor of each class's covariance."""

    base: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offset: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for rows of statistics."""
        if self.means is None:
            return np.full(len(x), self.base)
        z = (x - self.shift) / self.scale
        far = [(((z - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(self.means, self.whiten)]
        return 1 / (1 + np.exp(-np.clip(self.offset + 0.5 * (far[0] - far[1]), -30, 30)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = np.array(batch["x"].tolist(), float).reshape(-1, d), batch["y"].to_numpy()
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
    n = total.shape[1]
    yield pd.DataFrame({"y": np.repeat([0, 1], n), "k": np.tile(np.arange(n), 2), "v": total.ravel()})


def fit(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality",
        toward_pooled: float = TOWARD_POOLED, toward_diagonal: float = TOWARD_DIAGONAL) -> Discriminant:
    """A model from all ``rows`` (``document_statistics``) that ``labels`` covers."""
    known = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id"))
             .agg(F.avg(label).alias("share")).where("share <> 0.5")
             .select("id", F.expr("int(share > 0.5)").alias("y")))
    sums = rows.join(known, "id").mapInPandas(_moments, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v"))
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for y, k, v in sums.collect():  # two rows for each moment
        total[y, k] = v
    n = total[:, 0]
    base = float((n[1] + 1) / (n.sum() + 2))
    if not n.min():
        return Discriminant(base)
    mean = total[:, 1:1 + d] / n[:, None]
    scatter = total[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / max(1, n.sum() - 2)
    scale = np.sqrt(np.clip(np.diag(pooled), 1e-12, None))
    scale[scale < 1e-5] = 1.0
    pooled = pooled / np.outer(scale, scale)
    pooled = (1 - toward_diagonal) * pooled + toward_diagonal * np.diag(np.clip(np.diag(pooled), 0.01, None))
    pooled += 1e-6 * np.eye(d)
    shift = mean.mean(axis=0)
    whiten, logs = [], []
    for k in (0, 1):
        own = scatter[k] / np.outer(scale, scale) / (n[k] - 1) if n[k] > 1 else pooled
        root = np.linalg.cholesky((1 - toward_pooled) * own + toward_pooled * pooled)
        whiten.append(np.linalg.inv(root))
        logs.append(np.log(np.diag(root)).sum())
    return Discriminant(base, shift, scale, (mean - shift) / scale, np.array(whiten),
                        float(np.log(n[1] / n[0]) + logs[0] - logs[1]))


def score_statistics(model: Discriminant, x: str = "x") -> Column:
    """Score of a column of statistics."""
    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(-1, len(STATISTICS))))
    return of(F.col(x))


def score_text(model: Discriminant, text: str = "text") -> Column:
    """Score of a column of whole texts."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))))
    return of(F.col(text))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier scores ``threshold`` or more."""
    model = fit(document_statistics(docs, id_column, text), labels, id_column)
    return docs.where(score_text(model, text) >= threshold)
