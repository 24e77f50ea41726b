"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words and the character 4- to 6-grams of words (with word marks) that a bounded sample of labelled rows
sets apart, as log counts: the ``most_features`` that do so most, of those in ``least_df`` sampled rows or more, ties by
name. These bound the model, not the rows that it rates. Grades are 0 for rows labelled clean, and 1 to 3 for toxic rows by thirds of the number of words
that carry a feature found in toxic rows only. All grades share one weight vector; ordered thresholds part them. The
outcome is the expected severity, the grade, and whether grade 1 or more is the likelier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.byte_bpe import groups_by_bytes
from siteglass.llm.common import join_checked, small_batches, stored

WORD = re.compile(r"[^\W\d_]+")
GRADES = 4


def grams(word: str) -> set[str]:
    """A word with its marks, and its 4- to 6-grams."""
    w = f"^{word}$"
    return {w} | {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)}


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Ordinal:
    """Weights, feature scales and ordered thresholds: P(grade >= j) = sigmoid(x w - t_j)."""

    def __init__(self, features: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.features, self.weights, self.cuts = features, weights, cuts
        self.found = None

    def at_least(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))

    def row(self, ws: list[str]) -> Counter:
        """Counts of features in a text's words: one pass of an automaton over the marked words, whose marks no feature crosses."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for i, f in enumerate(self.features):
                self.found.add_word(f, i)
            self.found.make_automaton()
        return Counter(i for _, i in self.found.iter(f"^{'$^'.join(ws)}$")) if self.features and ws else Counter()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"found": None}

    def predict(self, text: str | None) -> tuple[float, int, bool]:
        """(expected severity, grade, toxic)"""
        row = self.row(words(text))
        score = float(self.weights[list(row)] @ np.log1p(list(row.values()))) if row else 0.0
        p = self.at_least(score)
        return float(p.sum()), int((p >= 0.5).sum()), bool(p[0] >= 0.5)


def fit(sizes: np.ndarray, col: np.ndarray, counts: np.ndarray, y: np.ndarray, n_features: int, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole sample; thresholds stay ordered as a start and positive steps.

    The sample is a sparse matrix: the number of features of each row, and all rows' features and counts in order."""
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    val = np.log1p(counts.astype(np.float32))
    parts = [slice(i, i + 500_000) for i in range(0, len(val), 500_000)]
    k = GRADES - 1
    theta = np.zeros(n_features + k)
    theta[n_features] = 1.0
    above = (y[:, None] >= np.arange(1, GRADES)).astype(float)
    share = np.clip(above.mean(0), 1e-9, 1 - 1e-9)
    weight = np.sqrt(np.where(above > 0, 0.5 / share, 0.5 / (1 - share)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, steps = theta[:n_features], theta[n_features:]
        cuts = steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps[1:]))])
        score = sum((np.bincount(at[p], weights=val[p] * w[col[p]], minlength=len(y)) for p in parts), np.zeros(len(y)))
        gap = weight * (1 / (1 + np.exp(np.clip(cuts - score[:, None], -50, 50))) - above) / len(y)
        g = np.zeros_like(theta)
        pull = gap.sum(1)
        g[:n_features] = sum((np.bincount(col[p], weights=val[p] * pull[at[p]], minlength=n_features) for p in parts), ridge * w)
        d = -gap.sum(0)
        g[n_features] = d.sum()
        g[n_features + 1 :] = np.exp(steps[1:]) * np.cumsum(d[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    steps = theta[n_features:]
    return theta[:n_features], steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps[1:]))])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_docs: int = 12_000, most_features: int = 6000, least_df: int = 4) -> Ordinal:
    """A model from at most about ``sample_docs`` labelled rows, half of them toxic where there are as many.

    A document with conflicting labels counts as toxic. Without rows of both kinds the model calls nothing toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy((F.col("toxic") > 0).alias("bad")).count().collect()}
    if len(sizes) < 2:
        return Ordinal([], np.zeros(0), np.array([50.0, 60.0, 70.0]))
    small_batches(spark)
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    share = F.when(F.col("toxic") > 0, min(1.0, sample_docs / 2 / sizes[True])).otherwise(min(1.0, sample_docs / 2 / sizes[False]))
    chosen = known.where(part < share * (1 << 20))
    sample, _ = stored(spark, join_checked(spark, docs.select("doc_id", "text"), chosen, ["doc_id"], "inner", 4 * sample_docs).where("text IS NOT NULL"), "sample")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(bad.keys() | good.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[x] for x in names], pa.int64()), pa.array([good[x] for x in names], pa.int64())], ["feature", "bad", "good"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for w in set(words(text)):
                    found |= grams(w)
                (bad if toxic else good).update(found)
                if len(bad) + len(good) > 200_000:
                    yield out()
                    bad.clear()
                    good.clear()
        yield out()

    counts = sample.select("text", (F.col("toxic") > 0).alias("toxic")).repartition(24).mapInArrow(presence, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") > 0).alias("bad")).count().collect()}
    n_bad, n_good = max(totals.get(True, 0), 1), max(totals.get(False, 0), 1)
    p, q = F.col("bad") / n_bad, F.col("good") / n_good
    apart = (p - q) * (p - q) / (p + q) * F.signum(p - q)
    rated = counts.where(F.col("bad") + F.col("good") >= least_df).withColumn("apart", apart)
    top = rated.where("apart > 0").orderBy(F.desc("apart"), "feature").limit(most_features).collect()
    features = [r["feature"] for r in top]
    only = {r["feature"] for r in top if r["good"] <= 0.002 * n_good and r["bad"] >= 10 * max(r["good"], 0.1) * n_bad / n_good}
    blank = Ordinal(features, np.zeros(len(features)), np.zeros(3))
    shared = spark.sparkContext.broadcast((blank, only))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marks = shared.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                row = model.row(ws)
                packed = [np.fromiter(x, "<i4", len(row)).tobytes() for x in (row, row.values())]
                out.append((*packed, toxic, sum(n for w, n in Counter(ws).items() if not marks.isdisjoint(grams(w)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.bool_(), pa.int64()))], ["cols", "n", "toxic", "marked"])

    got = sample.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(rows, "cols binary, n binary, toxic boolean, marked long").toArrow()
    toxic, marked = (np.asarray(got[c].to_pylist()) for c in ("toxic", "marked"))
    low, high = np.quantile(marked[toxic], [1 / 3, 2 / 3]) if toxic.any() else (0, 0)
    grades = toxic * (1 + (marked > low) + (marked > high))
    cols, counts = (got[c].to_pylist() for c in ("cols", "n"))
    flat = lambda parts: np.frombuffer(b"".join(parts), "<i4")
    weights, cuts = fit(np.array([len(c) // 4 for c in cols]), flat(cols), flat(counts), grades, len(features))
    shared.unpersist()
    return Ordinal(features, weights, cuts)


def rate(spark: SparkSession, docs: DataFrame, model: Ordinal, keep: str = "all") -> DataFrame:
    """keep 'all': rows (doc_id, severity, grade, toxic) for each row of docs; 'clean': the rows of docs, all their
    columns, that are not toxic. Null and empty texts have no features and are clean; repeated rows are rated alike."""
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)
    whole = keep == "clean"
    picked = docs if whole else docs.select("doc_id", "text")
    at = picked.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t) if t else 0 for t in batch.column(at).to_pylist()]
            for a, b in groups_by_bytes(sizes, 4 << 20):
                part = batch.slice(a, b - a)
                found = [shared.value.predict(t) for t in part.column(at).to_pylist()]
                if whole:
                    yield part.filter(pa.array([not f[2] for f in found], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.bool_())))], ["doc_id", "severity", "grade", "toxic"])

    return picked.mapInArrow(run, docs.schema if whole else "doc_id long, severity double, grade int, toxic boolean")
