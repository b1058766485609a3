"""Sources of vocabularies, edges and files, and sinks of captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary_lines(lines: DataFrame) -> DataFrame:
    """``tag,category,count,aliases`` lines (column ``value``); bad numbers count as 0, tags without text drop out."""
    rows = lines.select(F.from_csv("value", "tag string, category string, count string, aliases string").alias("r")).select("r.*")
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return rows.where(F.trim("tag") != "").select(F.trim("tag").alias("tag"), number("category").alias("category"), number("count").alias("count"), F.concat_ws(",", "tag", "aliases").alias("search"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return vocabulary_lines(spark.read.text(path))


def implication_lines(lines: DataFrame) -> DataFrame:
    """Distinct ``child``-``parent`` edges of lines (column ``value``); comments and loops drop out."""
    rows = lines.where(~F.col("value").startswith("#")).select(F.from_csv("value", "child string, parent string").alias("r")).select("r.*")
    return rows.select(F.trim("child").alias("child"), F.trim("parent").alias("parent")).where("child <> '' AND parent <> '' AND child <> parent").distinct()


def implications(spark: SparkSession, *paths: str) -> DataFrame:
    return implication_lines(spark.read.text(list(paths)))


def translations(lines: DataFrame) -> DataFrame:
    """``tag,translation`` lines (column ``value``), in either order: the part with Chinese characters is the
    translation. Lines without one (a header, say) drop out; the least translation of a tag stays."""
    rows = lines.select(F.from_csv("value", "a string, b string").alias("r")).select(F.trim("r.a").alias("a"), F.trim("r.b").alias("b"))
    chinese = lambda c: F.coalesce(F.col(c).rlike("[\u4e00-\u9fff]"), F.lit(False))
    tag, said = F.when(chinese("b"), F.col("a")).otherwise(F.col("b")), F.when(chinese("b"), F.col("b")).otherwise(F.col("a"))
    return rows.where(chinese("a") != chinese("b")).select(tag.alias("tag"), said.alias("translation")).where("tag <> ''").groupBy("tag").agg(F.min("translation").alias("translation"))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """A listing: ``path``, ``size``, ``modified`` of the files under a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def unseen(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index lacks or knows by another size or time."""
    return listing.join(index.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def vanished(index: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """Index rows in a folder whose file is gone."""
    return index.where(F.col("path").startswith(folder)).join(listing.select("path"), "path", "left_anti")


def write_captions(captions: DataFrame, path: str) -> None:
    """One line for each caption, in as many files as tasks."""
    captions.select("caption").write.text(path)


def write_tags(exported: DataFrame, path: str) -> None:
    exported.write.json(path)
