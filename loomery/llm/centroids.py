"""Centroid clustering of quantised vectors with multiplicities.

Vectors that are equal once quantised are one row with a count. Lloyd's rounds run over these
distinct rows alone: a task adds up, as integers, each row times its count; the sums of all tasks
meet as (centroid, component) rows and k centroids are all that a round brings to the driver. The
final assignment of a distinct row is joined back to the ids that share it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join
from .quantised import distances, matrix, quantised

CLUSTERS = 8
ROUNDS = 10
SEED = 3


def _partial_sums(centroids: np.ndarray):
    """Per task: sums of the vectors of each centroid, times their counts, and the counts."""

    def of(batches):
        k, dim = centroids.shape
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, n = matrix(b.column("q"), dim), b.column("n").to_numpy()
            nearest = distances(x, centroids).argmin(axis=1)
            for c in range(k):
                of_c = nearest == c
                sums[c] += n[of_c] @ x[of_c].astype(np.int64)
                counts[c] += n[of_c].sum()
        if counts.any():
            at = np.arange(k * dim)
            yield pa.RecordBatch.from_pydict({"cluster": (at // dim).astype(np.int32), "place": (at % dim).astype(np.int32), "total": sums.ravel(), "n": np.repeat(counts, dim)})

    return of


def _assigned(centroids: np.ndarray):
    """Per batch: each distinct vector's nearest centroid, the smaller number where two tie."""

    def of(batches):
        for b in batches:
            d = distances(matrix(b.column("q"), centroids.shape[1]), centroids)
            nearest = d.argmin(axis=1)
            held = {c: b.column(c) for c in ("h", "g", "cid", "n")}
            yield pa.RecordBatch.from_pydict({**held, "cluster": nearest.astype(np.int32), "distance": d[np.arange(len(d)), nearest]})

    return of


def starts(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest sha256 of ``seed:id``, in that order; a top-k."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("s"), "q")
    return np.array([r["q"] for r in first.orderBy(F.asc_nulls_last("s"), "q").limit(clusters).collect()], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of
    every vector of ``dim`` components, none null or non-finite; other rows have no result.

    Distances, sums and means are integers and exact. Ties go to the smaller centroid; a centroid
    that nothing is nearest to stays where it is. Repeated rows count as often as they occur and
    each get a row; of equal ids the smaller vector comes first as a start. Rows of a null id take
    part, but start no centroid while others can. With fewer vectors than ``clusters`` there are as
    many centroids as vectors; an empty table gives an empty result. Other columns are not carried.
    A component of 2**17 or more in size is an error, as distances would no longer fit.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.where(F.size(vector_col) == dim), id_col, vector_col)
    hashes = [F.xxhash64("q").alias("h"), F.xxhash64(F.lit("second"), "q").alias("g")]
    classes = rows.groupBy("q").agg(F.count("*").alias("n")).select("q", "n", *hashes, F.monotonically_increasing_id().alias("cid"))
    classes = materialize(classes, "distinct-vectors")
    centroids = starts(rows, clusters, seed).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        parts = classes.select("q", "n").mapInArrow(_partial_sums(centroids), "cluster int, place int, total long, n long")
        for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():  # clusters * dim rows
            centroids[r["cluster"], r["place"]] = r["total"] // r["n"]
    found = classes.mapInArrow(_assigned(centroids), "h long, g long, cid long, n long, cluster int, distance long")
    found = materialize(found, "vector-clusters")

    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
    named = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    key, hashed = ["h", "g"], rows.select("id", "q", *hashes)
    if classes.groupBy(*key).count().where("count > 1").isEmpty():
        hashed, found = hashed.select("id", *key), found.select(*key, "n", "cluster", "distance")
    else:  # two vectors share both hashes: then vectors themselves are the key
        key, found = ["q"], classes.select("q", "cid").join(found, "cid").select("q", "n", "cluster", "distance")
    out = spread_join(hashed, found, key, "n").join(F.broadcast(facts), "cluster")  # one row of facts for each centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
