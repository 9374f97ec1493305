"""Operator 4: mixing sources to target weights with soft membership.

A naive Bayes classifier learnt from a labelled table predicts how far each document belongs to each
domain. Nonnegative document rates are then fitted by projected-gradient least squares so that the
expected tokens of every domain meet its target. A round is one map-side combined sum of as many numbers as
there are domains; the rates stay where the documents are."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.llm.common import add_columns, settled
from tableproof.llm.vectors import vector_sums

BITS = 15
BUCKETS = 1 << BITS


def trigram_buckets(text: str) -> np.ndarray:
    """Buckets of the text's character trigrams as they stand, case and symbols included."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        return np.empty(0, np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


@dataclass
class Domains:
    """Domain names, their log priors and log trigram probabilities (a row a bucket)."""

    names: list[str]
    prior: np.ndarray
    table: np.ndarray
    evidence: float = 60.0

    def posterior(self, text: str | None) -> np.ndarray:
        """Posteriors that add up to one. The likelihood counts as that of ``evidence`` trigrams at most, as neighbouring ones are not
        independent; texts of under three characters get the priors. Without domains it is empty."""
        if not self.names:
            return self.prior
        at = trigram_buckets(text or "")
        z = self.prior.copy()
        if len(at):
            n = np.bincount(at, minlength=BUCKETS) if len(at) > BUCKETS // 4 else None
            total = self.table[at].sum(axis=0, dtype=np.float64) if n is None else n @ self.table
            z = z + total * (min(len(at), self.evidence) / len(at))
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_domains(labelled: DataFrame, domain: str, text: str = "text", smooth: float = 0.5, evidence: float = 60.0) -> Domains:
    """Learn from all rows that have a domain; a null text counts for the prior alone. No rows, no domains."""
    rows = labelled.filter(F.col(domain).isNotNull()).select(
        F.col(domain).cast("string").alias("domain"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                if key not in sums:
                    sums[key] = np.zeros(BUCKETS + 1, np.int64)
                at = trigram_buckets(batch.column(1)[i].as_py())
                if len(at) > BUCKETS // 4:
                    sums[key][:-1] += np.bincount(at, minlength=BUCKETS)
                elif len(at):
                    place, n = np.unique(at, return_counts=True)
                    sums[key][place] += n
                sums[key][BUCKETS] += 1
        return sums

    sums = vector_sums(rows, BUCKETS + 1, add)
    names = sorted(sums)
    docs = np.array([sums[k][-1] for k in names], float)
    table = [np.log((sums[k][:-1] + smooth) / (sums[k][:-1].sum() + smooth * BUCKETS)) for k in names]
    return Domains(names, np.log(docs / docs.sum()) if names else docs, np.array(table, np.float32).T.copy(), evidence)


def with_posteriors(docs: DataFrame, model: Domains, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens`` (words) and ``posterior`` (one number a domain)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        for texts in lists:
            yield [[len((t or "").split()) for t in texts], [held.value.posterior(t).tolist() for t in texts]]

    return add_columns(docs, text, [("n_tokens", T.LongType()), ("posterior", T.ArrayType(T.DoubleType(), False))], per_text)


SUMS = "sums array<double>"


class Unmet(UserWarning):
    """Targets that no nonnegative rates were found for: their domains have too few tokens, or too mixed ones."""


def _shares(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, posteriors and rates of a batch ``n_tokens, posterior, rate``."""
    tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
    return tokens, p, batch.column(2).to_numpy(zero_copy_only=False)


def replay(p: np.ndarray, rate: np.ndarray, history: list[np.ndarray], step: float, pull: float) -> np.ndarray:
    """Rates after the rounds of ``history`` (scaled residuals): the projected-gradient steps of each document.
    They are taken in the metric of tokens, so a long document's rate moves no further than a short one's."""
    for residual in history:
        rate = np.maximum(0.0, rate - step * (p @ residual + pull * (rate - 1.0)))
    return rate


def fit_rates(docs: DataFrame, model: Domains, targets: Mapping[str, float], pull: float = 1e-6, rounds: int = 60,
              tolerance: float = 1e-3, fold: int = 10) -> DataFrame:
    """``docs`` (with ``n_tokens`` and ``posterior``) plus ``rate``: nonnegative, fitted so that the expected tokens of
    each domain meet its share of all tokens.

    ``targets`` maps domains to weights, which are scaled to one; domains without one have target 0. Each
    domain's error is measured in units of the root of its tokens by membership, which makes the steps alike for
    large and small domains; ``pull`` draws rates weakly to 1. Ends when every error is below ``tolerance`` of
    all tokens, or after ``rounds``, and then warns (:class:`Unmet`) which targets are missed and by how much. Documents without tokens keep rate 1, and so do all if there is no domain."""
    names = model.names
    if not names:
        return docs.withColumn("rate", F.lit(1.0))
    weight = np.array([max(0.0, float(targets.get(n, 0.0))) for n in names])
    if weight.sum() <= 0:
        raise ValueError("no target names a learnt domain")
    rated = settled(docs.withColumn("rate", F.lit(1.0)), "rates")

    def total(df: DataFrame, per_batch, size: int) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    got += per_batch(*_shares(batch))
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = df.select("n_tokens", "posterior", "rate").mapInArrow(work, SUMS)
        cells = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        out = np.zeros(size)
        for r in cells:
            out[r["pos"]] = r["s"]
        return out

    k = len(names)
    first = total(rated, lambda t, p, r: np.concatenate([[t.sum()], ((t[:, None] * p).T @ p).ravel()]), 1 + k * k)
    tokens, gram = first[0], first[1:].reshape(k, k)
    if tokens == 0:
        return rated
    goal = weight / weight.sum() * tokens
    unit = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-12))
    step = 1.0 / (float(np.linalg.eigvalsh(gram * unit[:, None] * unit[None, :]).max()) + pull)
    history: list[np.ndarray] = []
    for at in range(rounds):
        known = list(history)
        reached = total(rated, lambda t, p, r: ((t[:, None] * p) * replay(p, r, known, step, pull)[:, None]).sum(axis=0), k)
        if np.abs(reached - goal).max() <= tolerance * tokens:
            break
        history.append(unit * unit * (reached - goal))
        if len(history) == fold:
            rated, history = settled(_apply(rated, history, step, pull), "rates"), []
    else:
        missed = {n: round(float((r - g) / tokens), 6) for n, r, g in zip(names, reached, goal) if abs(r - g) > tolerance * tokens}
        warnings.warn(f"targets not met after {rounds} rounds, by share of all tokens: {missed}", Unmet, stacklevel=2)
    return _apply(rated, history, step, pull)


def _apply(rated: DataFrame, history: list[np.ndarray], step: float, pull: float) -> DataFrame:
    known = [h.copy() for h in history]
    if not known:
        return rated
    place = rated.columns.index("rate")
    tokens_at, posterior_at = rated.columns.index("n_tokens"), rated.columns.index("posterior")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, p, r = _shares(pa.RecordBatch.from_arrays(
                    [batch.column(tokens_at), batch.column(posterior_at), batch.column(place)], ["t", "p", "r"]))
                batch = batch.set_column(place, "rate", pa.array(replay(p, r, known, step, pull)))
            yield batch

    return rated.mapInArrow(work, rated.schema)


def mix(docs: DataFrame, model: Domains, targets: Mapping[str, float], text: str = "text", doc_id: str = "doc_id",
        seed: int = 7, **options) -> DataFrame:
    """``doc_id, tid, n_tokens, posterior, rate, copies``: how often each document enters the mixture.

    ``copies`` is the rate rounded up or down by a hash of id, text and seed, so its expectation is the
    rate and a second run gives the same. ``tid`` hashes the text and tells rows with one id apart; rows
    that repeat both get the same copies each. Null texts have no tokens, rate 1 and one copy. Very long texts count
    whole. An empty table has no rows; further columns are not read, so names may clash."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = with_posteriors(slim, model).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "n_tokens", "posterior")
    rated = fit_rates(base, model, targets, **options)
    chance = F.pmod(F.xxhash64("doc_id", "tid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def mixed_documents(docs: DataFrame, mixture: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` repeated as often as the mixture says, all columns as they are, whatever their names.

    Rows are matched by id and text, nulls included; repeated rows are repeated each, ties get the same. An empty
    table stays empty, and a document that the mixture does not know is left out."""
    counts = mixture.select("doc_id", "tid", "copies").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"))
    met = rows.join(counts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"), "copies").filter(
        F.col("copy") <= F.col("copies")).select("row.*")
