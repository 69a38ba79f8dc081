"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (one to three characters,
blended) present in both, divided by the root of the product of their numbers of n-grams.
N-grams are hashed to a fixed number of buckets. A few sampled texts are landmarks; the
Nyström map turns kernel values with them into features, and kernel ridge regression in
that space gives one score per language against the rest. Texts are scored in batches:
presence rows times landmark rows is one matrix product, times the weights another.

Only a bounded sample of labelled rows is learned from (``sample``, spread evenly over the
languages); of it the driver gets bit rows of fixed size, never texts. Every whole text is
scored.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if
there is nothing to learn from; null languages and null ids teach nothing; ties between
languages go to the first by name; repeated rows get equal results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

GRAMS = 3
BUCKETS = 1 << 14
#: Rows to learn from and landmarks among them, at most.
SAMPLE, LANDMARKS = 2000, 256
RIDGE = 1e-3
UNKNOWN = "und"

_BATCH = 256
_GOLDEN = np.uint32(2654435761)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(text: str | None) -> np.ndarray | None:
    """Which buckets the n-grams of the whole text fall in; None if it has no letter.

    Letters are lower-cased; what stands between words counts as one space.
    """
    if not isinstance(text, str):
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = np.r_[True, letter[1:] | letter[:-1]]
    points = np.r_[np.uint32(32), points[keep], np.uint32(32)]
    row = np.zeros(BUCKETS, bool)
    gram = np.zeros(len(points), np.uint32)
    for n in range(GRAMS):
        gram = (gram[:len(points) - n] * np.uint32(31) + np.uint32(n + 1)) * _GOLDEN + points[n:]
        row[(gram * _GOLDEN) >> np.uint32(32 - (BUCKETS - 1).bit_length())] = True
    return row


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of presence rows with landmark rows."""
    x, y = rows.astype(np.float32), landmarks.astype(np.float32)
    return (x @ y.T) / np.sqrt(x.sum(axis=1)[:, None] * y.sum(axis=1)[None, :])


@dataclass
class StringKernel:
    """Landmarks as packed bit rows, weights (landmarks x languages) and the languages' names."""

    languages: list[str]
    landmarks: np.ndarray | None = None
    weights: np.ndarray | None = None

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        points = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        for at in range(0, len(texts), _BATCH):
            rows = [(i, presence(t)) for i, t in enumerate(texts[at:at + _BATCH], at)]
            rows = [(i, r) for i, r in rows if r is not None]
            if not rows:
                continue
            values = kernel(np.stack([r for _, r in rows]), points) @ self.weights
            best = values.argmax(axis=1)
            for (i, _), k, v in zip(rows, best, values[np.arange(len(rows)), best]):
                names[i], scores[i] = self.languages[k], min(1.0, max(0.0, (1 + float(v)) / 2))
        return names, scores


def train(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> StringKernel:
    """One-versus-rest kernel ridge regression on presence rows; the first ``landmarks`` rows are landmarks."""
    names = sorted(set(languages))
    if not names:
        return StringKernel([])
    points = rows[:landmarks]
    values, vectors = np.linalg.eigh(kernel(points, points).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel(rows, points) @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.array([languages.count(n) for n in languages])  # languages count alike
    weight /= weight.mean()
    gram = features.T @ (features * weight[:, None]) + ridge * len(rows) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (y * weight[:, None]))
    return StringKernel(names, np.packbits(points, axis=1), (root @ solved).astype(np.float32))


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE, landmarks: int = LANDMARKS) -> StringKernel:
    """A model from a bounded sample of ``docs``, all of whose rows may be learned from."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(lang).alias("lang"))
    sizes = settle(rows.groupBy("lang").count(), "languages")  # written first: the join by a hot language moves no row
    quota = max(1, sample // max(1, sizes.count()))
    # ids hashed to the unit interval; a generous share of each language first, then the exact number
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    some = rows.withColumn("spot", spot).join(sizes, "lang").where(F.col("spot") * F.col("count") < 2 * quota + 50)
    order = Window.partitionBy("lang").orderBy("spot", "id")
    chosen = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).select("id", "place").distinct()

    @F.pandas_udf(T.BinaryType())
    def bits(texts: pd.Series) -> pd.Series:
        rows = [presence(t) for t in texts]
        return pd.Series([None if r is None else np.packbits(r).tobytes() for r in rows], dtype=object)

    found = docs.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("body")).where(
        "lang IS NOT NULL").join(F.broadcast(chosen), "id")  # at most ``sample`` ids
    found = found.select("place", "lang", "id", bits("body").alias("bits")).where("bits IS NOT NULL").orderBy(
        "place", "lang", "id", "bits").limit(2 * sample).collect()
    if not found:
        return StringKernel([])
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in found])
    return train(np.unpackbits(packed, axis=1).astype(bool), [r["lang"] for r in found], landmarks)


def predict(model: StringKernel, text: str = "text") -> Column:
    """A struct of ``lang`` and ``score`` for a column of whole texts."""
    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})
    return of(F.col(text))
