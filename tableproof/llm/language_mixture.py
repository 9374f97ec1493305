"""Operator 7: language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams, counted over all learning rows. A text
is a mixture of languages: expectation-maximisation estimates the proportions that make its trigrams
likeliest, and languages are taken out of the set while the penalised likelihood gets better."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.llm.common import add_columns
from tableproof.llm.vectors import vector_sums

BUCKETS = 1 << 16
UNDETERMINED = "und"
NO_LETTER = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased letters, words being set off by one space."""
    letters = NO_LETTER.sub(" ", text.lower()).strip(" ")
    if not any(map(str.isalpha, letters)):
        return np.empty(0, np.uint16)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.uint16)


@dataclass
class Mixture:
    """Languages and their trigram probabilities (a row a bucket), with add-``smooth`` smoothing."""

    languages: list[str]
    probability: np.ndarray
    rounds: int = 12
    penalty: float = 1.0
    floor: float = 0.01

    def proportions(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation and their log-likelihood; ``p`` has a row a trigram."""
        total, theta = n.sum(), np.full(p.shape[1], 1.0 / p.shape[1])
        if p.shape[1] > 1:
            for _ in range(self.rounds):
                theta = theta * ((n / (p @ theta)) @ p) / total
                theta /= theta.sum()
        return theta, float(n @ np.log(p @ theta))

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """The leading language, its proportion, and the proportions of the selected set."""
        buckets = trigrams(text) if text else ()
        if not len(buckets) or not self.languages:
            return UNDETERMINED, 0.0, {}
        if len(buckets) > BUCKETS // 4:
            n = np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(n)
            n = n[at].astype(float)
        else:
            at, n = np.unique(buckets, return_counts=True)
            n = n.astype(float)
        p = self.probability[at]
        theta, _ = self.proportions(p, n)
        chosen = np.flatnonzero(theta >= min(self.floor, theta.max()))
        theta, fit = self.proportions(p[:, chosen], n)
        cost = 0.5 * self.penalty * np.log(max(2.0, n.sum()))
        while len(chosen) > 1:
            weakest = np.argmin(theta)
            fewer = np.delete(chosen, weakest)
            theta2, fit2 = self.proportions(p[:, fewer], n)
            if fit2 + cost < fit:
                break
            chosen, theta, fit = fewer, theta2, fit2
        best = int(np.argmax(theta))
        return (self.languages[chosen[best]], float(min(1.0, max(0.0, theta[best]))),
                {self.languages[k]: float(t) for k, t in zip(chosen, theta)})


def fit_languages(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", smooth: float = 0.5,
                  **options) -> Mixture:
    """Trigram distributions of every language among the rows of ``learn`` that have a text and a language.

    All such rows are counted. The model is languages times 2^16 numbers; its size is checked. No rows, no
    languages: every text is then undetermined."""
    rows = docs.filter(learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key, buckets = batch.column(0)[i].as_py(), trigrams(batch.column(1)[i].as_py())
                if key not in counts:
                    counts[key] = np.zeros(BUCKETS, np.int64)
                if len(buckets) > BUCKETS // 4:
                    counts[key] += np.bincount(buckets, minlength=BUCKETS)
                elif len(buckets):
                    at, n = np.unique(buckets, return_counts=True)
                    counts[key][at] += n
        return counts

    sums = vector_sums(rows, BUCKETS, add)
    languages = sorted(sums)
    table = np.stack([(sums[k] + smooth) / (sums[k].sum() + smooth * BUCKETS) for k in languages], axis=1) if languages else \
        np.empty((BUCKETS, 0))
    return Mixture(languages, table, **options)


def detect_languages(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (its proportion) and ``languages`` (the selected set with proportions).

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name;
    repeated rows are judged each; very long texts are counted whole, in a vector of fixed size; an empty table has no
    rows; columns of those names are replaced. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        mixture = held.value
        for texts in lists:
            got = [mixture.infer(t) for t in texts]
            yield [[g[0] for g in got], [g[1] for g in got], [list(g[2].items()) for g in got]]

    return add_columns(docs, text, [("lang_pred", T.StringType()), ("score", T.DoubleType()),
                                    ("languages", T.MapType(T.StringType(), T.DoubleType()))], per_text)
