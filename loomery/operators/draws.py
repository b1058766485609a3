"""Prompts drawn by weight: several tags of each category, without repeats, under exclusion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chance(seed: Column, tag: Column) -> Column:
    """A number in (0, 1) that a seed and a tag fix, the same wherever the row lies."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), tag)), 1, 12), 16, 10).cast("double") + 1) / (2.0**48 + 1)


def drawn(counts: DataFrame, seeds: list[int], order: list[tuple[str, int]], rules: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """The prompt of each seed as rows ``seed``, ``category``, ``tag``, ``place``.

    ``counts`` has ``tag``, ``category`` and the weight ``n``; ``order`` the categories in turn and how many tags
    each gives; ``rules`` (``condition``, ``target``) take a target from all later categories once its
    condition is in the prompt; ``always`` (``tag``, ``category``: a set) is in every prompt from the start.
    Each tag arrives after an exponential time of its weight, and the first arrivals win: that
    is a draw by weight without replacement, and a category's next tag doesn't depend on how the
    table is split. Fewer tags than asked for give all there are. A tag is drawn at most once.
    """
    spark = counts.sparkSession
    runs = F.array(*(F.lit(s).cast("long") for s in seeds))
    picked = spark.createDataFrame([], "seed long, category string, tag string, place int")
    if always is not None:
        place = F.row_number().over(Window.partitionBy("category").orderBy("tag"))
        held = always.distinct().select("category", "tag", place.alias("place"))
        picked = held.select(F.explode(runs).alias("seed"), "category", "tag", "place")
    for category, k in order:
        pool = counts.where((F.col("category") == category) & (F.col("n") > 0)).groupBy("tag").agg(F.sum("n").alias("n"))
        held = pool.select("tag", "n", F.explode(runs).alias("seed"))
        barred = picked.join(rules, F.col("tag") == F.col("condition")).select("seed", F.col("target").alias("tag")).union(picked.select("seed", "tag")).distinct()
        time = -F.log(chance(F.col("seed"), F.col("tag"))) / F.col("n")
        free = held.join(barred, ["seed", "tag"], "left_anti").withColumn("time", time)
        place = F.row_number().over(Window.partitionBy("seed").orderBy("time", "tag"))
        now = free.withColumn("place", place).where(F.col("place") <= k)  # each task keeps its k first
        picked = picked.unionByName(now.select("seed", F.lit(category).alias("category"), "tag", "place"))
    return picked


def prompts(picked: DataFrame, order: list[str]) -> DataFrame:
    """One line for each seed: its tags by the order of categories and by place."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0))
    rows = picked.withColumn("at", F.when(at > 0, at).otherwise(len(order) + 1))
    return rows.groupBy("seed").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "category", "place", "tag"))), lambda e: e["tag"]), ", ").alias("prompt"))
