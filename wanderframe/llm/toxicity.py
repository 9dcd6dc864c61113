"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, other texts are unlabelled; no text counts as a negative. The risk of
a linear model over words and word beginnings (whether a text has them, more than once, and as a share of its words)
is estimated from both with the class prior, and the part that stands for negatives is kept from going below zero (the
non-negative estimator).
Features are counted and chosen in Spark; the driver gets the chosen features' lists for a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied, written

#: Most rows that a model is fitted on.
MAX_POSITIVE, MAX_UNLABELLED = 5000, 10000
#: A feature's least standard errors above chance, and least estimated share of toxic texts among those that have it.
MIN_Z, MIN_PURITY = 4.5, 0.5
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: A word or beginning counts as frequent from one in so many of a text's words on.
ONE_IN = 100
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3

_words = re.compile(r"[^\W\d_]+").findall


def counts_of(text: str | None, wanted=None) -> tuple[Counter, int]:
    """How often a text has each word, lower-cased, and each beginning, which ends in a hyphen (only those wanted, if
    given), and its number of words."""
    words, out = Counter(_words((text or "").lower())), Counter()
    for w, k in words.items():
        if wanted is None or w in wanted:
            out[w] += k
        for p in PREFIXES:
            if len(w) > p and (wanted is None or w[:p] + "-" in wanted):
                out[w[:p] + "-"] += k
    return out, words.total()


def features_of(text: str | None, wanted=None) -> set[str]:
    """x for each of counts_of(), x+ if it is there more than once, x% if it is frequent."""
    found, n = counts_of(text, wanted)
    return {f for x, k in found.items() for f in (x, *([x + "+"] if k > 1 else ()), *([x + "%"] if ONE_IN * k >= n else ()))}


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


@dataclass(frozen=True)
class LinearModel:
    bias: float
    weights: dict[str, float]

    @cached_property
    def wanted(self) -> frozenset[str]:
        """The words and beginnings that some weight is about."""
        return frozenset(f.rstrip("+%") for f in self.weights)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(features_of(text, self.wanted)) if f in self.weights)
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -50, 50))))


def fit_nnpu(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float, steps: int = 800, rate: float = 0.1, l2: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on the non-negative risk with logistic loss. rows: the features that each text has."""
    index = np.fromiter((i for r in rows for i in r), np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    in_p, in_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, late = np.zeros_like(theta), np.zeros_like(theta), []
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, theta[index], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss_as_negative = np.logaddexp(0, z)
        negative_risk = (in_u * loss_as_negative).sum() - prior * (in_p * loss_as_negative).sum()
        d_negative = in_u * p - prior * in_p * p
        d = prior * in_p * (p - 1) + d_negative if negative_risk >= 0 else -d_negative
        # the bias always follows the uncorrected risk: at its minimum the mean score of the unlabelled is the prior.
        # With the corrected risk's, too, few positives let the bias rise: precision 0.15 instead of 1 with 36 of them
        grad = np.append(np.bincount(index, d[row], n_features) + l2 * theta[:-1], (in_u * p).sum() - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > steps - 100:
            late.append(theta)
    theta = np.mean(late, 0)  # of the last steps, which go to and fro around a corrected risk of 0
    return float(theta[-1]), theta[:-1]


def fitted(docs: DataFrame, labels: DataFrame) -> LinearModel:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), without the held-out fold.

    Rows are chosen by the order of a hash of the id, each id once, so the same data give the same model; of rows that
    share an id all texts count, each text once. Labels other than 0 and 1 and null ids are not learnt from. Without a
    positive, or without a text of one, the model says the prior for every text.
    """
    train = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    known = labels.filter(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    prior = known.agg(F.avg("toxic")).first()[0]
    prior = min(0.9, max(0.01, float(prior))) if prior is not None else 0.01
    by_hash = F.xxhash64("doc_id")
    confirmed = known.filter("toxic = 1").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(MAX_POSITIVE)
    others = docs.filter(train & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(MAX_UNLABELLED)
    # at most MAX_POSITIVE + MAX_UNLABELLED ids: small enough to broadcast
    chosen = confirmed.select("doc_id", F.lit(True).alias("positive")).unionByName(others.select("doc_id", F.lit(False).alias("positive")))
    # a text that copies repeat counts once, else the words of one much copied text would look toxic
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text", "positive").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "positive"), "toxicity-sample")

    @tidied
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(seen):
            names = sorted(seen[0].keys() | seen[1].keys())
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())], ["feature", "p", "u"])

        seen = Counter(), Counter()
        for batch in batches:
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[positive].update(features_of(text))
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield from told(seen)
                    seen = Counter(), Counter()
        yield from told(seen)

    total = sample.agg(F.sum(F.col("positive").cast("long")), F.count(F.lit(1))).first()
    n_pos, n_unl = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    if not n_pos or not n_unl:
        return LinearModel(float(np.log(prior / (1 - prior))), {})
    rate_p, rate_u = F.col("p") / n_pos, F.col("u") / n_unl
    # standard errors above what chance gives, were the feature as common among positives as in general
    common = (F.col("u") + F.col("p") + 1) / (n_unl + n_pos)
    excess = (rate_p - rate_u) / F.sqrt(common * (1 / n_pos + 1 / n_unl))
    best = (sample.select("text", "positive").mapInArrow(counts, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
            .filter((F.col("p") >= 3) & (excess >= MIN_Z) & (prior * rate_p >= MIN_PURITY * rate_u)).select("feature").collect())
    names = sorted(r["feature"] for r in best)  # of a bounded sample's texts
    number = {f: i for i, f in enumerate(names)}
    wanted = frozenset(f.rstrip("+%") for f in names)

    @tidied
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [sorted(number[f] for f in features_of(t, wanted) if f in number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.list_(pa.int32())), batch.column(1)], ["have", "positive"])

    rows = sample.select("text", "positive").mapInArrow(listed, "have array<int>, positive boolean").toArrow()
    if not names:
        return LinearModel(float(np.log(prior / (1 - prior))), {})
    bias, weights = fit_nnpu(rows["have"].to_pylist(), np.array(rows["positive"].to_pylist(), bool), len(names), prior)
    return LinearModel(bias, {f: float(w) for f, w in zip(names, weights)})


def scored(docs: DataFrame, model: LinearModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); other columns, whatever their names, are
    ignored. Null and empty texts get the bias's score. Repeated rows are scored each and alike, very long texts are
    taken whole, a null id is not held out. An empty table gives an empty one."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
