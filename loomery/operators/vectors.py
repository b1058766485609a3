"""Vector search: cosine, nearest neighbours, medoids, and pairs by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a block; two blocks meet in one task.
BLOCK = 2048
#: Where all vectors meet: blocks that a scope is dealt to before they grow, and the most rows of one.
BLOCKS, MOST_ROWS = 24, 65_536


def cosine_to(query: list[float], vector_col: str = "embedding") -> Column:
    """Cosine of each vector with one query vector, in double precision; 0 if a norm is 0, null of
    a null vector or another length. The query is a constant of the plan, one vector long."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vector_col).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    both = F.sqrt(dot(v, v)) * F.lit(float(np.sqrt(np.square(np.asarray(query, np.float64)).sum())))
    return F.when(F.size(v) == len(query), F.when(both > 0, dot(v, q) / both).otherwise(F.lit(0.0)))


def packed(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """``vectors`` with a column's vectors as little-endian 32-bit bytes; null of null."""

    @F.pandas_udf("binary")
    def of(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return vectors.withColumn(name, of(F.col(column).cast("array<float>")))


def unpacked(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """``packed`` bytes as vectors again; null of null and of bytes that end within a number."""

    @F.pandas_udf("array<float>")
    def of(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return vectors.withColumn(name, of(F.col(column)))


def pair_cosine(vectors: DataFrame, a: int, b: int) -> DataFrame:
    """The cosine of two stored vectors to four digits; null where one is missing."""
    held = vectors.where(F.col("vec_id").isin(a, b)).agg(*(F.first(F.when(F.col("vec_id") == i, F.col("embedding").cast("array<double>")), ignorenulls=True).alias(n) for i, n in ((a, "x"), (b, "y"))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    both = F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    return held.select(F.when(F.size("x") == F.size("y"), F.round(F.when(both > 0, dot(F.col("x"), F.col("y")) / both).otherwise(0.0), 4)).alias("similarity"))


def nearest(vectors: DataFrame, query: list[float], threshold: float, limit: int, offset: int = 0, exclude: int | None = None, scope: DataFrame | None = None) -> DataFrame:
    """A page of the vectors nearest to ``query``: by cosine to four digits, then by id. A top-k.

    With a ``scope`` (``vec_id``) only its vectors count; an empty one gives an empty page. ``query`` may be
    a stored vector, or what an upload or a text was embedded as; a zero vector finds nothing.
    """
    if not any(query):
        return vectors.where("false").select("vec_id", F.lit(0.0).alias("similarity"))
    vectors = vectors if scope is None else vectors.join(scope.select("vec_id").distinct(), "vec_id", "left_semi")
    scored = vectors.select("vec_id", cosine_to(query).alias("raw")).where(F.col("raw") >= threshold)
    scored = scored if exclude is None else scored.where(F.col("vec_id") != exclude)
    ordered = scored.select("vec_id", F.round("raw", 4).alias("similarity")).orderBy(F.desc("similarity"), "vec_id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def pairs_with(vectors: DataFrame, some: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs ``a`` < ``b`` of unit vectors (``vec_id``, ``u``, ``scope``) of one scope and length with cosine
    (``similarity``) at least ``threshold``, one of which at least is in ``some`` (``f``).

    Exact: both sides are dealt to blocks of bounded size and each two blocks meet in one task. The
    work is the product of both sides, so ``some`` should be few.
    """
    rows = vectors.join(some.distinct(), F.col("vec_id") == F.col("f"), "left").withColumn("named", F.col("f").isNotNull()).drop("f")
    sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if("named") / block).cast("int").alias("named_blocks")).where("named_blocks > 0")
    rows = rows.join(sizes, "scope").withColumn("hash", F.xxhash64("vec_id"))
    at = lambda n: F.pmod("hash", F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("named").select("scope", at("named_blocks").alias("i"), all_of("blocks").alias("j"), F.lit(True).alias("first"), "named", "vec_id", "u")
    right = rows.select("scope", all_of("named_blocks").alias("i"), at("blocks").alias("j"), F.lit(False).alias("first"), "named", "vec_id", "u")

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "similarity": np.zeros(0)})]
        for _, part in pdf.groupby(pdf["u"].map(len)):
            x, ids = np.stack(part["u"].to_numpy()), part["vec_id"].to_numpy()
            first, named = part["first"].to_numpy(bool), part["named"].to_numpy(bool)
            of_some, of_all = np.flatnonzero(first), np.flatnonzero(~first)
            for k in range(0, len(of_some), 512):
                i, j = np.nonzero((s := x[of_some[k : k + 512]] @ x[of_all].T) >= threshold)
                p, q = ids[of_some[k + i]], ids[of_all[j]]
                once = np.where(named[of_all[j]], p < q, p != q)
                out.append(pd.DataFrame({"a": np.minimum(p, q)[once], "b": np.maximum(p, q)[once], "similarity": s[i, j][once]}))
        return pd.concat(out)

    return left.union(right).groupBy("scope", "i", "j").applyInPandas(of, "a long, b long, similarity double")


def blocks_for(rows: int, block: int = 2 * BLOCK) -> int:
    """Blocks of a scope: as many as ``block`` rows each make, but no more than BLOCKS until each has MOST_ROWS."""
    return max(min(-(-rows // block), BLOCKS), -(-rows // MOST_ROWS))


def block_pairs(vectors: DataFrame, threshold: float, block: int = 2 * BLOCK) -> DataFrame:
    """All pairs ``a`` < ``b`` of unit vectors (``vec_id``, ``u``, ``scope``) of one scope and length with cosine
    (``similarity``) at least ``threshold``. Exact: a scope is dealt to blocks, each two of which are multiplied
    in one task, so a vector is sent to as many tasks as its scope has blocks (see ``blocks_for``): what is
    sent grows with the input up to BLOCKS * MOST_ROWS vectors, and what a task holds never passes two blocks."""
    of_rows = lambda n: F.ceil(F.count("*") / n)
    sizes = vectors.groupBy("scope").agg(F.greatest(F.least(of_rows(block), F.lit(BLOCKS)), of_rows(MOST_ROWS)).cast("int").alias("blocks"))
    rows = vectors.join(sizes, "scope").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("scope", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "vec_id", "u")

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "similarity": np.zeros(0)})]
        for _, part in pdf.groupby(pdf["u"].map(len)):
            x, ids, own = np.stack(part["u"].to_numpy()), part["vec_id"].to_numpy(), part["own"].to_numpy()
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            for k in range(0, len(left), 512):
                i, j = np.nonzero((s := x[left[k : k + 512]] @ x[right].T) >= threshold)
                p, q = ids[left[k + i]], ids[right[j]]
                once = p < q if lo == hi else np.ones(len(p), bool)
                out.append(pd.DataFrame({"a": np.minimum(p, q)[once], "b": np.maximum(p, q)[once], "similarity": s[i, j][once]}))
        return pd.concat(out)

    return dealt.groupBy("scope", "lo", "hi").applyInPandas(of, "a long, b long, similarity double")


def _unit_sums(scope: str):
    """Per task: sums of the unit vectors of each scope and length."""

    def of(batches):
        sums: dict = {}
        for b in batches:
            length = pa.compute.list_value_length(b.column("u")).to_numpy()
            of_row = b.column("scope").to_pylist()
            for key, at in pd.Series(np.arange(len(length))).groupby([pd.Series(of_row, dtype=object), length]).indices.items():
                x = b.column("u").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                sums[key] = sums.get(key, 0) + x.sum(axis=0)
        for (name, dim), s in sums.items():
            yield pa.RecordBatch.from_pydict({"scope": pa.array([name] * dim, scope), "k": np.arange(dim, dtype=np.int32), "s": s})

    return of


def medoids(vectors: DataFrame, scope: str, threshold: float) -> DataFrame:
    """Every vector with its scope's medoid (``scope``, ``vec_id``, ``medoid``, ``distance``, ``outlier``).

    A difference is one less the cosine. The medoid is the vector of the least sum of differences to
    all of its scope, the least id at ties (sums are compared to nine digits); the sum follows from
    the scope's sum of unit vectors, so no pairs are made. Outliers differ from the medoid by more
    than ``threshold``. Vectors of a scope have one length; null scopes, null vectors and zero
    vectors take no part.
    """
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    unit = vectors.where(F.col("embedding").isNotNull() & F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), "vec_id", v.alias("v")).withColumn("norm", norm).where("norm > 0")
    unit = unit.select("scope", "vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    kind = unit.schema["scope"].dataType.simpleString()
    parts = unit.select("scope", "u").mapInArrow(_unit_sums(to_arrow_type(unit.schema["scope"].dataType)), f"scope {kind}, k int, s double")
    sums = parts.groupBy("scope", "k").agg(F.sum("s").alias("s")).groupBy("scope").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = unit.join(sums, "scope").select("scope", "vec_id", "u", F.round(dot("u", "m"), 9).alias("s"))
    best = scored.groupBy("scope").agg(F.min_by(F.struct(F.col("vec_id").alias("medoid"), F.col("u").alias("mu")), F.struct((-F.col("s")).alias("s"), "vec_id")).alias("b"))
    out = unit.join(best.select("scope", "b.medoid", "b.mu"), "scope").withColumn("distance", 1 - dot("u", "mu"))
    return out.select("scope", "vec_id", "medoid", (F.round("distance", 6) + 0.0).alias("distance"), (F.col("distance") > threshold).alias("outlier"))
