"""A stored index of nearest-vector candidates: coarse cells, probed by the nearest, re-scored exactly.

Cells are the nearest of a bounded number of chosen vectors. The table of all vectors is written with
a folder for each cell, so that a search reads the folders that it probes and no others. How
many cells a search probes is measured when the index is built: the fewest that find the wanted
share of the exact neighbours of a bounded number of sampled vectors. ``vectors.nearest`` is the
exact way beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that cells may be drawn from, and cells at most: the bound of what is sent to all tasks.
SAMPLE, MOST_CELLS = 4096, 1024
#: Sampled vectors whose neighbours are searched exactly when probes are chosen.
JUDGED = 64
#: Rows of a cell, and searching vectors, that meet in one task.
BLOCK = 4096


@dataclass
class Index:
    """A stored index: where it is, its cells' centres, how many are probed, and the recall measured."""

    path: str
    centres: np.ndarray
    probes: int
    recall: float

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _units(vectors: DataFrame, id_col: str) -> DataFrame:
    """``id`` and the unit vector ``u`` of the rows that have one."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).withColumn("norm", norm)
    rows = rows.where((F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf"))))
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("u"))


def _centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical means of a bounded sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def _ranked_cells(centres: np.ndarray, probes: int):
    """Of each unit vector: its nearest cells, the nearest first."""

    @F.pandas_udf("array<int>")
    def of(u: pd.Series) -> pd.Series:
        if not len(u):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.argsort(-(np.stack(u.to_numpy()) @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return of


def _meet(pairs: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``rows`` to each searching vector, by cosine and then by id."""
    ids, x = rows["id"].to_numpy(), np.stack(rows["u"].to_numpy())
    out = []
    for at in range(0, len(pairs), 512):
        part = pairs.iloc[at : at + 512]
        s = np.stack(part["q"].to_numpy()) @ x.T
        for qid, line in zip(part["query_id"].tolist(), s):
            if len(line) > k:
                few = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
            else:
                few = np.arange(len(line))
            best = few[np.lexsort((ids[few], -line[few]))][:k]
            out.append(pd.DataFrame({"query_id": qid, "id": ids[best], "similarity": line[best]}))
    return pd.concat(out)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exclude_self: bool = True) -> DataFrame:
    """The ``k`` nearest stored vectors of each row of ``queries`` (``vec_id``, ``embedding``) among those in its
    ``probes`` nearest cells: ``query_id``, ``id``, ``similarity`` (exact) and ``place``.

    Searching vectors and cells are dealt to blocks, so no task holds a cell whole; each block gives
    no more than ``k`` rows for a searching vector. Null and zero vectors find nothing.
    """
    spark = queries.sparkSession
    asks = _units(queries, "vec_id").select(F.col("id").alias("query_id"), F.col("u").alias("q"))
    near = asks.withColumn("cell", F.explode(_ranked_cells(index.centres, probes or index.probes)("q")))
    cells = near.select("cell").distinct()
    rows = index.table(spark).join(F.broadcast(cells), "cell", "left_semi")  # at most MOST_CELLS rows; prunes folders
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = near.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asking"))
    dealt = F.broadcast(sizes.join(asked, "cell"))  # at most MOST_CELLS rows
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = near.join(dealt, "cell").select("cell", at("query_id", "asking").alias("i"), all_of("blocks").alias("j"), "query_id", "q")
    right = rows.join(dealt, "cell").select("cell", all_of("asking").alias("i"), at("id", "blocks").alias("j"), "id", "u")
    want = k + 1 if exclude_self else k

    def of(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _meet(a, b, want) if len(a) and len(b) else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})

    key = ["cell", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(of, "query_id long, id long, similarity double")
    found = found.where("query_id <> id") if exclude_self else found
    return _top(found, k)


def exact(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """The same as ``search`` over all vectors: every block of vectors meets every block of queries."""
    every = _units(vectors, "vec_id").withColumn("cell", F.lit(0))
    asks = _units(queries, "vec_id").select(F.col("id").alias("query_id"), F.col("u").alias("q"))
    n, m = max(1, -(-every.count() // BLOCK)), max(1, -(-asks.count() // BLOCK))
    left = asks.select(F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), "query_id", "q")
    right = every.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("j"), "id", "u")
    want = k + 1 if exclude_self else k

    def of(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _meet(a, b, want) if len(a) and len(b) else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(of, "query_id long, id long, similarity double")
    return _top(found.where("query_id <> id") if exclude_self else found, k)


def build(vectors: DataFrame, path: str, k: int = 20, recall: float = 0.95, cells: int | None = None) -> Index:
    """Stores ``vectors`` (``vec_id``, ``embedding``, of one length) by cells under ``path`` and measures how many
    cells a search for ``k`` neighbours must probe.

    Cells are about the square root of the rows, MOST_CELLS at most; their centres come from SAMPLE
    rows of the smallest hashes, and JUDGED of these are searched exactly. Every row is stored,
    but for null and zero vectors.
    """
    spark = vectors.sparkSession
    rows = _units(vectors, "vec_id")
    first = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # a bounded sample
    if not first:
        rows.withColumn("cell", F.lit(0)).limit(0).write.mode("overwrite").parquet(path)
        return Index(path, np.zeros((1, 1)), 1, 1.0)
    sample = np.stack([np.array(r["u"]) for r in first])
    n = rows.count()
    cells = min(cells or max(1, int(np.sqrt(n))), MOST_CELLS, len(sample))
    centres = _centres(sample, cells)
    placed = rows.withColumn("cell", F.get(_ranked_cells(centres, 1)("u"), 0))
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (cells * 1_000_000))))).write.mode("overwrite").partitionBy("cell").parquet(path)

    judged = vectors.where(F.col("vec_id").isin([r["id"] for r in first[:JUDGED]]))
    truth = exact(vectors, judged, k).select("query_id", "id")
    order = _units(judged, "vec_id").select(F.col("id").alias("query_id"), F.posexplode(_ranked_cells(centres, cells)("u")).alias("turn", "cell"))
    hits = truth.join(spark.read.parquet(path).select("id", "cell"), "id").join(order, ["query_id", "cell"]).groupBy("turn").agg(F.count("*").alias("n"))
    by_turn = {r["turn"]: r["n"] for r in hits.collect()}  # at most MOST_CELLS rows
    total, found = max(1, sum(by_turn.values())), 0
    for turn in range(cells):
        found += by_turn.get(turn, 0)
        if found >= recall * total:
            return Index(path, centres, turn + 1, found / total)
    return Index(path, centres, cells, 1.0)
