"""Operator 1: toxicity by a character n-gram linear classifier with naive Bayes scaled features.

Presence of hashed character n-grams is counted per class over all distinct learning texts; the log-count ratio of
a feature scales its presence, and a logistic model is fitted on the scaled features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.llm.common import add_columns, settled
from tableproof.llm.vectors import vector_sums

BITS = 20
BUCKETS = 1 << BITS
ORDERS = (4, 5, 6, 7)
SPACES = re.compile(r"\W+")
#: Bound of the texts the weights are fitted on; ratios are counted over all learning texts.
FIT_ROWS = 10_000
#: Buckets with a weight, those whose ratio is furthest from zero in standard errors; the others weigh nothing.
FEATURES = 2048


def ngram_buckets(text: str | None, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased text, runs of non-word characters being one space."""
    clean = SPACES.sub(" ", (text or "").lower()).strip(" ")
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if not clean or len(c) < orders[0]:
        return
    h, have = c.copy(), 1
    for order in orders:
        if len(c) < order:
            return
        while have < order:
            h = h[:-1] * np.uint32(0x01000193) + c[have:] * np.uint32(0x9E3779B1)
            have += 1
        x = h ^ (h >> np.uint32(15))
        yield (x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


@dataclass
class Toxicity:
    """Chosen buckets (``slot`` maps a bucket to its feature, or to the last one, which weighs nothing)."""

    slot: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    fitted_on: int = 0

    def features(self, text: str | None) -> np.ndarray:
        """Numbers of the chosen features that the text has."""
        none, found = len(self.ratio), []
        for buckets in ngram_buckets(text):
            at = self.slot[buckets]
            found.append(at[at != none])
        return np.unique(np.concatenate(found)) if found else np.empty(0, self.slot.dtype)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[self.features(text)].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))


def count_presence(rows: DataFrame) -> dict[str, np.ndarray]:
    """Documents of each class that hold a bucket; the vector's last number counts documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        sums = {"0": np.zeros(BUCKETS + 1, np.int64), "1": np.zeros(BUCKETS + 1, np.int64)}
        for batch in batches:
            for i in range(batch.num_rows):
                counts = sums[batch.column(0)[i].as_py()]
                parts = list(ngram_buckets(batch.column(1)[i].as_py()))
                if parts:
                    counts[np.unique(np.concatenate(parts))] += 1
                counts[BUCKETS] += 1
        return sums

    return vector_sums(rows, BUCKETS + 1, add)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the bias is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
        hessian[np.diag_indices_from(hessian)] += shrink
        step = np.linalg.solve(hessian, x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(labelled: DataFrame, text: str = "text", label: str = "toxic", smooth: float = 1.0, features: int = FEATURES,
                 fit_rows: int = FIT_ROWS, ridge: float = 1.0, rounds: int = 12) -> Toxicity:
    """Learn from rows with a label of 0 or 1 (others are left out; a null text has no features).

    A text is evidence once for each label it bears, however often it is repeated: presence counts and log-count ratios
    cover all distinct pairs of label and text. The ``features`` buckets whose ratio is furthest
    from zero in standard errors carry the classifier; its weights are fitted on ``fit_rows`` of these pairs at
    most, those with the smallest hashes, half of them toxic where there are enough, and the bias is put back to the
    share of toxic pairs. Without rows of both classes the score is their smoothed share. Empty and very long texts
    count whole; an empty table, ties and further columns with clashing names do no harm."""
    given = labelled.filter(F.col(f"`{label}`").isin(0, 1)).select(
        F.col(f"`{label}`").cast("int").cast("string").alias("label"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = settled(given.distinct(), "evidence")
    sums = count_presence(rows)
    none = np.zeros(BUCKETS + 1, np.int64)
    good, bad = sums.get("0", none), sums.get("1", none)
    n0, n1 = int(good[-1]), int(bad[-1])
    p, q = (bad[:-1] + smooth) / (n1 + 2 * smooth), (good[:-1] + smooth) / (n0 + 2 * smooth)
    ratio = np.log(p / q)
    error = np.sqrt((1 - p) / (p * (n1 + 2 * smooth)) + (1 - q) / (q * (n0 + 2 * smooth)))
    chosen = np.sort(np.argsort(-np.abs(ratio / error), kind="stable")[:features])
    slot = np.full(BUCKETS, len(chosen), np.int32)
    slot[chosen] = np.arange(len(chosen))
    prior = float(np.log((n1 + smooth) / (n0 + smooth)))
    model = Toxicity(slot, ratio[chosen], np.zeros(len(chosen)), prior)
    if not n0 or not n1:
        return model
    most = max(1, fit_rows // 2)
    # a little more than is wanted is drawn by hash, and what is over is left out on the driver
    take = {c: min(1.0, (most + 6 * most ** 0.5) / n) for c, n in (("0", n0), ("1", n1))}
    share = F.pmod(F.xxhash64("label", "text"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.withColumn("share", share).filter(F.col("share") < F.when(F.col("label") == "1", take["1"]).otherwise(take["0"]))
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        for texts in lists:
            yield [[held.value.features(t).astype(np.int32) for t in texts]]

    drawn = add_columns(sample, "text", [("at", T.ArrayType(T.IntegerType(), False))], per_text).select("label", "share", "at").collect()
    drawn = [r for c in "01" for r in sorted((r for r in drawn if r["label"] == c), key=lambda r: (r["share"], r["at"]))[:most]]
    model.fitted_on = len(drawn)
    x, y = np.zeros((len(drawn), len(chosen)), np.float32), np.zeros(len(drawn))
    for i, r in enumerate(drawn):
        x[i, r["at"]] = model.ratio[r["at"]]
        y[i] = r["label"] == "1"
    if 0 < y.sum() < len(y):
        weight, bias = logistic(x, y, ridge, rounds)
        model.weight = weight * model.ratio
        model.bias = bias + prior - float(np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), row by row over whole texts.

    Null and empty texts have no features and get the prior's score; very long texts are taken whole; repeated rows are
    scored each; columns of those names are replaced. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        for texts in lists:
            scores = [held.value.score(t) for t in texts]
            yield [scores, [int(s >= threshold) for s in scores]]

    return add_columns(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], per_text)
