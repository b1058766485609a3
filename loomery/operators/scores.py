"""Stored model scores: coverage, virtual re-thresholds, fused votes and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STORE_FLOOR = 0.1


def gate(threshold: float, character: float, copyright_: float) -> Column:
    """The threshold of a row's category."""
    return F.when(F.col("category") == "character", character).when(F.col("category") == "copyright", copyright_).otherwise(threshold)


def rethreshold(scores: DataFrame, threshold: float, character: float, copyright_: float, keys=("item_id",)) -> DataFrame:
    """Tags as if inferred at these thresholds: rows at or over their gate, and of rating rows the
    best one whatever its score (ties: the least tag)."""
    keys = list(keys)
    rating = F.col("category") == "rating"
    best = F.row_number().over(Window.partitionBy(*keys, rating).orderBy(F.desc("score"), "tag"))
    held = scores.where(rating | (F.col("score") >= gate(threshold, character, copyright_))).withColumn("__n", F.when(rating, best))
    return held.where(~rating | (F.col("__n") == 1)).select(*keys, "tag", "category", "score")


#: The order in which one model's tags are read.
READ_ORDER = ("general", "copyright", "character")


def consensus(per_model: DataFrame, weights: dict[str, float], least: float, bypass=("character", "copyright")) -> DataFrame:
    """Votes of several models' tags (``item_id``, ``model``, ``tag``, ``category``, ``score``): kept
    if the weights of its models (1 where none is given) reach ``least``, 1 at the least, or its
    category is a bypass one. A tag has the category of its first vote: models in the order of
    ``weights`` (others after them, by name), and of one model general tags first, then copyright.
    Rating rows don't vote; see ``rating_verdict``."""
    weight, turn = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(0))
    for k, (model, w) in enumerate(weights.items()):
        weight, turn = weight.when(F.col("model") == model, F.lit(w or 1.0)), turn.when(F.col("model") == model, F.lit(k))
    place = F.struct(turn.otherwise(len(weights)).alias("turn"), "model", F.array_position(F.array(*map(F.lit, READ_ORDER)), F.col("category")).alias("kind"), "category")
    votes = per_model.where("category <> 'rating' AND trim(tag) <> ''").withColumn("weight", weight.otherwise(1.0)).groupBy("item_id", F.lower(F.trim("tag")).alias("tag")).agg(
        F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("votes"), F.round(F.max("score"), 4).alias("confidence"), F.min_by("category", place).alias("category")
    )
    return votes.where((F.col("weight") >= max(1.0, float(int(least)))) | F.col("category").isin(*bypass))


def rating_verdict(per_model: DataFrame) -> DataFrame:
    """The rating of the highest score over all models; ties go to the least model, then tag."""
    order = F.struct((-F.col("score")).alias("s"), "model", "tag")
    return per_model.where("category = 'rating'").groupBy("item_id").agg(F.min_by("tag", order).alias("rating"), F.max("score").alias("score"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tags that were added to or removed from each item that changed, and how many."""
    both = before.select("item_id", F.lower("tag").alias("tag"), F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(after.select("item_id", F.lower("tag").alias("tag"), F.lit(0).alias("old"), F.lit(1).alias("new")))
    sides = both.groupBy("item_id", "tag").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return sides.groupBy("item_id").agg(F.sum(1 - F.col("old")).alias("added"), F.sum(1 - F.col("new")).alias("removed")).where("added + removed > 0")


def gaps(scores: DataFrame, tags: DataFrame, tag: str, low: float, high: float) -> DataFrame:
    """Items whose best score for ``tag`` over all models lies in [low, high) and that don't hold it."""
    band = scores.where((F.col("tag") == tag) & (F.col("score") >= low) & (F.col("score") < high))
    best = band.groupBy("item_id").agg(F.max("score").alias("score"), F.min_by("model", F.struct((-F.col("score")).alias("s"), F.col("model").alias("m"))).alias("model"))
    return best.join(tags.where(F.lower("tag") == tag.lower()).select("item_id"), "item_id", "left_anti")


def coverage(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.count_distinct("item_id").alias("items"))


def distribution(scores: DataFrame, tag: str) -> DataFrame:
    """Count, mean, least and highest score of a tag by model."""
    mean = F.round(F.sum(F.col("score").cast("decimal(20,8)")) / F.count("*"), 4).cast("double")
    return scores.where(F.col("tag") == tag).groupBy("model").agg(F.count("*").alias("n"), mean.alias("mean"), F.max("score").alias("highest"), F.min("score").alias("lowest"))


def storage(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("items"), (F.count("*") * 60).alias("bytes"))


def replace_slice(scores: DataFrame, fresh: DataFrame, floor: float = STORE_FLOOR) -> DataFrame:
    """``scores`` with the (item, model) slices of ``fresh`` replaced; what is under the floor isn't
    stored, what is over 1 is stored as 1."""
    slices = fresh.select("item_id", "model").distinct()
    clean = fresh.where(F.col("score") >= floor).withColumn("score", F.least("score", F.lit(1.0)))
    return scores.join(slices, ["item_id", "model"], "left_anti").unionByName(clean)


def normalized(score: Column) -> Column:
    """A probability: not-a-number and what is outside 0 to 1 become 0."""
    return F.when(F.isnan(score) | (score < 0) | (score > 1) | score.isNull(), F.lit(0.0)).otherwise(score)
