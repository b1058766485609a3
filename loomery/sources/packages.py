"""A dataset package on disk: written aside, verified, and put in place by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a package.
PAIRS, MANIFEST = "pairs", "manifest"


class Unfinished(Exception):
    """The package could not be written; nothing of it is left."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write(rows: DataFrame, target: str, files: int | None = None) -> str:
    """Writes the package of ``rows`` (``id``, ``path``, ``file``, ``state``, ``caption``, ``digest``) to ``target``.

    Rows that are ``ok`` become pairs of a picture's path and its caption; every row is in the manifest
    with its state, so one that can't be packed never takes another with it. All is written to a
    folder beside ``target``, read back and held against the plan there; then the folder is renamed. If
    any of this fails, or ``target`` is there already, the folder is deleted and ``Unfinished`` raised.
    """
    spark = rows.sparkSession
    to, system = _files(spark, target)
    aside = f"{target}.staging-{uuid.uuid4().hex}"
    at, _ = _files(spark, aside)
    try:
        if system.exists(to):
            raise FileExistsError(target)
        dealt = rows if files is None else rows.repartition(files)
        dealt.where("state = 'ok'").select("id", "path", "file", "caption").write.json(f"{aside}/{PAIRS}")
        rows.select("id", "path", "file", "state", "digest").write.parquet(f"{aside}/{MANIFEST}")
        bad = problems(spark, aside)
        if not bad.isEmpty():
            raise ValueError(f"{bad.count()} pairs differ from the manifest")
        if not system.rename(at, to):
            raise OSError(f"could not rename to {target}")
    except Exception as e:
        system.delete(at, True)
        raise Unfinished(str(e)) from e
    return target


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pairs and the manifest of a package."""
    pairs = spark.read.schema("id long, path string, file string, caption string").json(f"{path}/{PAIRS}")
    return pairs, spark.read.parquet(f"{path}/{MANIFEST}")


def problems(spark: SparkSession, path: str) -> DataFrame:
    """Rows on which pairs and manifest differ: ``missing`` pairs, ``unexpected`` ones, captions of another
    ``digest``, and pairs of one ``file`` name."""
    pairs, manifest = read(spark, path)
    listed = manifest.where("state = 'ok'").select("id", "digest")
    both = pairs.select("id", F.col("file"), F.sha2("caption", 256).alias("own")).join(listed, "id", "full_outer")
    code = F.when(F.col("own").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when(F.col("own") != F.col("digest"), "digest")
    twice = pairs.groupBy("file").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id", F.lit("file").alias("code"))
    return both.select("id", code.alias("code")).where("code IS NOT NULL").unionByName(twice)
