"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded, documented sample of labelled rows (``per_class`` of each label, the
smallest hashes of their ids): naive Bayes ratios of hashed n-grams are summed across partitions,
the n-grams that speak most for the toxic label are kept, and a logistic regression is fitted on
presence features scaled by their ratios. N-grams that speak for clean text are as many as there are
clean topics, and features of them lower the held-out accuracy (README has figures), so they are left
out. Only the text is ever an input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_crc32, materialize, null_as_empty

ORDERS = (3, 4, 5)
BITS = 18
SLICES = 64
#: The bound of the sample: at most so many labelled rows of each class.
PER_CLASS = 4000
FEATURES = 4000
#: A missed toxic text weighs as much as so many clean texts that are rejected: a text is rejected
#: from a probability of 1 / (1 + MISS_COST) on. README has precision and recall on held-out rows.
MISS_COST = 2.0


def gram_buckets(text: str) -> np.ndarray:
    """Hashed buckets of all character n-grams of the whole text, one for each place."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = c, []
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class ToxicityModel:
    """Feature number of each bucket (-1: none), the weight of each feature, and the intercept."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        """Probability of the toxic label; a text without n-grams has the intercept alone."""
        found = self.feature[gram_buckets(text)]
        found = np.unique(found[found >= 0])
        z = self.intercept + self.weight[found].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _class_counts(batches):
    """Per task: in how many texts of each class a bucket occurs, in slices."""
    counts, rows = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for pdf in batches:
        for text, toxic in zip(null_as_empty(pdf["text"]), pdf["toxic"]):
            counts[int(toxic), np.unique(gram_buckets(text))] += 1
            rows[int(toxic)] += 1
    for label in (0, 1):
        for k, part in enumerate(np.split(counts[label], SLICES)):
            yield pd.DataFrame({"label": [label], "slice": [k], "n": [int(rows[label])], "counts": [part.tobytes()]})


def _sum_counts(pdf):
    total = np.sum([np.frombuffer(b, np.int32) for b in pdf["counts"]], axis=0, dtype=np.int64)
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "slice": [pdf["slice"].iloc[0]], "n": [pdf["n"].sum()], "counts": [total.astype(np.int64).tobytes()]})


def training_rows(docs: DataFrame, labels: DataFrame, allowed, per_class: int = PER_CLASS) -> tuple[DataFrame, int, int]:
    """The bounded sample with texts (``text``, ``toxic``), and how many rows of each label are allowed.

    A label repeated for an id counts once, as toxic if any of its rows says so; so does a document
    that repeats an id, with its smallest text (a null one is empty). So the bound holds for texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")), "toxicity-labels")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picks[0].union(picks[1]))  # at most 2 * per_class rows of 12 bytes
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    return materialize(rows, "toxicity-sample"), totals.get(0, 0), totals.get(1, 0)


def fit(docs: DataFrame, labels: DataFrame, allowed, per_class: int = PER_CLASS, features: int = FEATURES) -> ToxicityModel:
    """The classifier. With labels of one class only, or none, it gives that class's constant
    (no label: 0)."""
    sample, clean_rows, toxic_rows = training_rows(docs, labels, allowed, per_class)
    none = np.full(1 << BITS, -1, np.int32)
    sums = sample.mapInPandas(_class_counts, "label int, slice int, n long, counts binary").groupBy("label", "slice").applyInPandas(_sum_counts, "label int, slice int, n long, counts binary").collect()
    counts, rows = np.zeros((2, 1 << BITS)), np.zeros(2)
    width = (1 << BITS) // SLICES
    for r in sums:
        counts[r["label"], r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
        rows[r["label"]] = r["n"]
    if rows.min() == 0 or min(clean_rows, toxic_rows) == 0:
        return ToxicityModel(none, np.zeros(1), 40.0 if rows[1] else -40.0)
    share = (counts + 1) / (rows[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    telling = np.maximum(ratio, 0) * np.sqrt(counts.sum(axis=0)) * (counts.sum(axis=0) >= min(8, rows.min()))
    top = np.argsort(-telling, kind="stable")[:features]
    top = np.sort(top[telling[top] > 0])
    feature = none.copy()
    feature[top] = np.arange(len(top))

    def present(batches):
        for pdf in batches:
            found = [feature[gram_buckets(t)] for t in null_as_empty(pdf["text"])]
            yield pd.DataFrame({"toxic": pdf["toxic"], "found": [np.unique(f[f >= 0]).astype(np.int32).tobytes() for f in found]})

    rows_seen = sample.mapInPandas(present, "toxic int, found binary").collect()  # 2 * per_class rows at most
    indices = [np.frombuffer(r["found"], np.int32) for r in rows_seen]
    y = np.array([r["toxic"] for r in rows_seen], np.float64)
    weight, intercept = _logistic(indices, y, ratio[top])
    p, q = toxic_rows / (toxic_rows + clean_rows), y.mean()
    return ToxicityModel(feature, weight * ratio[top], intercept + np.log(p / (1 - p)) - np.log(q / (1 - q)) + np.log(MISS_COST))


def _logistic(indices: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 2e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights of scaled presence features by accelerated gradient steps."""
    columns, owner = np.concatenate(indices), np.repeat(np.arange(len(y), dtype=np.int32), [len(i) for i in indices])
    values = scale[columns]
    w, b = np.zeros(len(scale)), 0.0
    v, vb, t = w.copy(), b, 1.0
    rate = 4.0 / max(1e-9, np.bincount(owner, values**2, len(y)).max() + 1)
    rate = max(rate, 4.0 / (np.percentile(np.bincount(owner, values**2, len(y)), 90) + 1))
    for _ in range(rounds):
        z = np.bincount(owner, v[columns] * values, len(y)) + vb
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(columns, error[owner] * values, len(scale)) + ridge * v
        after, after_b, t_after = v - rate * grad, vb - rate * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = after + (t - 1) / t_after * (after - w), after_b + (t - 1) / t_after * (after_b - b)
        w, b, t = after, after_b, t_after
    return w, b


def score_udf(model: ToxicityModel):
    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in null_as_empty(texts)], dtype="float64")

    return of


def held_out(column: str = "doc_id"):
    return F.pmod(id_crc32(column), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``.

    Null and empty texts get the score of a text without n-grams. Rows of a null id are scored
    but never learnt from. Repeated rows each get a row; other columns are neither read nor
    carried. An empty table gives an empty result.
    """
    model = fit(docs, labels, ~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), score_udf(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns stay as they are.

    Null and empty texts get the score of a text without n-grams, which keeps them unless most
    labels are toxic. Rows are judged one by one, so repeated texts stay or go together; without
    labels all rows stay; an empty table gives an empty result.
    """
    model = fit(docs, labels, ~held_out())
    return docs.where(score_udf(model)(F.col("text")) < 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
