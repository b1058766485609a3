"""Shared helpers: scratch tables in the shared folder, bounded blocks, linked components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a cut lineage
    that survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table of ``scratch_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: Keys that hold over one in so many of a join's rows are sent to all tasks; there are fewer of them.
HOT_KEYS = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: list[str], count: str) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and in ``count`` the rows that
    ``left`` has of it; a hot key's rows never meet in one task.

    Keys of over 100 rows of ``left``, and of more than one in ``HOT_KEYS``, are fewer than ``HOT_KEYS``
    whatever the input, so they are sent to all; the rest is shuffled.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) > max(100, -(-total // HOT_KEYS)))
    cold = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(right, key))


def id_crc32(column: str) -> Column:
    """Unsigned crc32 of an id as text; 0 where the id is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0).cast("long"))


def whole_id(column: str) -> tuple[Column, Column]:
    """An id for pandas, which makes longs beside nulls into doubles: ``doc_id`` (0 for null) and
    ``absent``. ``null_id`` puts the two together again."""
    return F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col(column).isNull().alias("absent")


def null_id() -> Column:
    return F.when(~F.col("absent"), F.col("doc_id")).alias("doc_id")


def null_as_empty(texts: pd.Series) -> list[str]:
    return ["" if t is None or t != t else t for t in texts]


class UnionFind:
    """Links between integers of one task; smaller numbers become roots."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up.setdefault(a, a)
        self.up[b] = a
        return True


def _forest(batches):
    """Per task: the links it has read, replaced by node-to-root links."""
    links = UnionFind()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            links.link(a, b)
    nodes = np.fromiter(links.up, np.int64, len(links.up))
    roots = np.fromiter(map(links.root, links.up), np.int64, len(links.up))
    off = nodes != roots
    if off.any():
        yield pd.DataFrame({"a": nodes[off], "b": roots[off]})


def _least_neighbours(links: DataFrame) -> DataFrame:
    """For each ``a``: the smallest of it and its neighbours (``m``), and its number of links (``n``)."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected links ``a``-``b`` (longs).

    Returns ``node``, ``root`` for each node that has a link to another one; ``root`` is the
    smallest node of the component. Links are first contracted inside each task; then the
    alternation of large-star and small-star steps runs until the table stops changing, which
    takes a logarithmic number of rounds. A node's smallest neighbour is found by partial
    aggregates, and reaches the node's links by ``spread_join``, so that the links of a hub are
    spread over all tasks. Each round is written to the shared folder, and the round before it
    deleted.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, name)
    now = materialize(edges.where("a <> b").select("a", "b").mapInPandas(_forest, "a long, b long"), name, path)
    before = None
    for _ in range(0 if now.isEmpty() else max_rounds):
        both = now.union(now.select("b", "a"))
        larger = spread_join(both, _least_neighbours(both), ["a"], "n").where("b > a")
        down_path = scratch_path(spark, name)
        down = materialize(larger.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct(), name, down_path)
        smaller = spread_join(down, _least_neighbours(down), ["a"], "n")
        links = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        after_path = scratch_path(spark, name)
        now = materialize(smaller.select(links).select("e.*").where("a <> b").distinct(), name, after_path)
        forget(spark, path)
        forget(spark, down_path)
        path = after_path
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if state == before or state[0] == 0:
            break
        if state[0] == state[2] and now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            break  # every node has one link and no root has any: all are stars
        before = state
    else:
        if before is not None:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
