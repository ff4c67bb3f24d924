"""A quality classifier by Bradley-Terry pairwise ranking.

Each document gets features of its text alone. Preference pairs (one document of label 1, one of label 0) are drawn from labelled
training rows; weights minimise the logistic loss of the pairs' feature differences, so ``w . x`` ranks documents. The threshold is the
training scores' quantile at the share of label 0; scores are mapped so that it lies at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import text_slices

#: Labelled rows that a fit uses at most: those with the least hash of their id.
MOST_LABELLED = 12_000
PAIRS = 60_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_CLASSES = 12


def _class_table() -> np.ndarray:
    """A class for each code point below 0x3000; all above share the last."""
    out = np.full(0x3001, 1, np.uint8)  # 1: other letters and signs
    for i in range(0x3000):
        c = chr(i)
        if c.isspace():
            out[i] = 0
        elif c.isdigit():
            out[i] = 2
        elif c.isupper():
            out[i] = 3
        elif c.islower():
            out[i] = 4
    for group, k in ((".?…", 5), (",;:", 6), ("!", 7), ("#*$%&<>@^~=+_\\/{}[]", 8), ("|•·»›", 9), ("\"'()-“”‘’«»–—", 10)):
        for c in group:
            out[ord(c)] = k
    out[0x3000] = 11
    return out


_TABLE = _class_table()
NAMES = ["bias_length", *(f"share_{k}" for k in range(_CLASSES)), "any_exclaim", "any_symbol", "any_bar", "word_length", "log_words", "distinct", "distinct_by_length", "adjacent_repeats", "distinct_tail", "line_repeats", "upper_words"]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each text; nulls count as empty texts."""
    texts = [t or "" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[np.minimum(points, 0x3000)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(doc * _CLASSES + kinds, minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    shares = counts / np.maximum(1, sizes)[:, None]
    out = np.zeros((len(texts), len(NAMES)))
    out[:, 0] = np.log1p(sizes)
    out[:, 1 : 1 + _CLASSES] = shares
    out[:, 13] = np.minimum(1, 30 * shares[:, 7])
    out[:, 14] = np.minimum(1, 30 * shares[:, 8])
    out[:, 15] = np.minimum(1, 30 * shares[:, 9])
    for k, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        distinct = len(set(words))
        lines = [x for x in text.split("\n") if x]
        out[k, 16] = (sizes[k] - counts[k, 0]) / n
        out[k, 17] = np.log1p(n)
        out[k, 18] = distinct / n
        # of text in a natural language distinct words grow as a power of all words; loops and word lists lie off that
        out[k, 19] = np.log(distinct) - 0.85 * np.log(n)
        out[k, 20] = sum(map(str.__eq__, words, words[1:])) / n
        out[k, 21] = max(0.0, 0.45 - distinct / n)
        out[k, 22] = 1 - len(set(lines)) / len(lines)
        out[k, 23] = sum(map(str.isupper, words)) / n
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the quantile threshold lies at 0.7."""
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """None if a class has no rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-7:
            break
    raw = np.sort(z @ w)
    at = len(bad)  # the quantile at label 0's share, halfway to the next score
    cut = (raw[at - 1] + raw[min(at, len(raw) - 1)]) / 2
    return Model(mean, scale, w, float(cut), float(max(raw.std() / 3, 1e-9)))


def fold(key: str):
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(FOLDS))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Model | None:
    """Fit on at most ``most`` labelled rows outside the held-out fold: those whose id hashes lowest, so all of a smaller set.

    Only their ids and labels are broadcast, and only their features come to the driver: both are bounded by ``most``. Of rows that
    repeat an id each counts; where that makes more than ``most``, ids of the lowest hashes stay, whatever their texts.
    """
    chosen = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull() & (fold(key) != HELD_OUT)).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y"))
    chosen = chosen.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "k").select("k", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["k", "y", "x"])

    kind = documents.schema[key].dataType.simpleString()
    found = rows.mapInArrow(run, f"k {kind}, y int, x array<double>").orderBy(F.xxhash64("k"), "k", "x", "y").limit(most).drop("k").toPandas()
    if not len(found):
        return None
    return fit(np.stack(found["x"].to_numpy()), found["y"].to_numpy())


ADDED = ("held_out", "score", "predicted")


def classify(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, held_out, score and predicted of each row, and the columns named in ``keep``.

    A narrow operator. A null text is scored as an empty one, whose features are all zero. Long texts are read
    whole, in slices of rows, a text being the least slice. Without a model (no labelled rows of both classes) every score is 0.5. A
    null key isn't held out. Equal rows each give a row; other columns are left out; an empty table gives an empty one. Columns to
    keep may have any names; those named as one of the three that are added give way to it.
    """
    out = [key, *(c for c in dict.fromkeys(keep) if c != key and c not in ADDED)]
    plain = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(out)), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                score = model.score(features(part.column("text").to_pylist())) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(out))), pa.array(score)], [*(f"c{i}" for i in range(len(out))), "score"])

    fields = ", ".join(f"c{i} {plain.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(out)))
    scored = plain.mapInArrow(run, f"{fields}, score double")
    held = F.coalesce(fold("c0") == HELD_OUT, F.lit(False))
    done = scored.select(*(f"c{i}" for i in range(len(out))), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    return done.toDF(*out, *ADDED)
