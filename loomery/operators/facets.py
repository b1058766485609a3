"""Facets, health reports and per-item verdicts: aggregations that count before they join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import text


def frequency(frame: DataFrame, value: Column, name: str = "value", limit: int | None = None) -> DataFrame:
    """How often each non-blank value occurs, the most frequent first, ties by value."""
    out = frame.select(value.alias(name)).where(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "").groupBy(name).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), name).limit(limit) if limit else out


def relevance(value: Column, needle: str) -> Column:
    """0 exact, 1 prefix, 2 start of a later word or bracket, 3 contained, else null."""
    v, n = F.lower(value), needle.lower()
    word = F.lit(False)
    for before in (" ", "_", "(", "["):
        word = word | v.contains(before + n)
    return F.when(v == n, 0).when(v.startswith(n), 1).when(word, 2).when(v.contains(n), 3)


def search_facet(frame: DataFrame, value: str, needle: str, limit: int = 50) -> DataFrame:
    """Values that hold the needle: by relevance, then count, then value without case."""
    counts = frame.where(F.lower(value).contains(needle.lower())).groupBy(value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", relevance(F.col(value), needle))
    return ranked.orderBy("rank", F.desc("n"), F.lower(value), value).limit(limit)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two digits; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part / whole, 2))


#: What an item of each fault costs; 22 times the mean of it is taken from 100.
PENALTIES = (
    ("unreadable", 2.0), ("metadata_error", 2.0), ("missing_prompt", 1.4), ("missing_dimensions", 1.3), ("missing_checkpoint", 0.8),
    ("unknown_generator", 0.6), ("readable_untagged", 0.5), ("repeated_names", 0.5),
)


def health(items: DataFrame) -> DataFrame:
    """One row of conditional counts over all items in one pass, the items whose file name is not
    theirs alone, and a quality score from the weighted mean of penalties."""
    readable = F.coalesce("is_readable", F.lit(1)) == 1
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    counts = items.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("is_readable", F.lit(1)) == 0).alias("unreadable"),
        F.count_if(F.col("tagged_at").isNull()).alias("untagged"),
        F.count_if(blank("prompt")).alias("no_prompt"),
        F.count_if(F.col("generator").isNull()).alias("no_generator"),
        F.count_if(F.col("aesthetic_score").isNull()).alias("unscored"),
        F.count_if(blank("ai_caption") & blank("nl_caption")).alias("no_caption"),
        F.count_if(F.lower(F.coalesce("metadata_status", F.lit("complete"))) == "pending").alias("pending"),
        F.count_if(F.col("brightness").isNull()).alias("no_colour"),
        F.count_if(F.lower(F.coalesce("metadata_status", F.lit("complete"))) == "error").alias("metadata_error"),
        F.count_if(readable & blank("prompt")).alias("missing_prompt"),
        F.count_if(readable & ((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0))).alias("missing_dimensions"),
        F.count_if(readable & blank("checkpoint")).alias("missing_checkpoint"),
        F.count_if(readable & (F.col("generator") == "unknown")).alias("unknown_generator"),
        F.count_if(readable & F.col("tagged_at").isNull()).alias("readable_untagged"),
    )
    repeated = items.where(F.trim(F.coalesce("filename", F.lit(""))) != "").groupBy(F.lower("filename").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.join(F.broadcast(repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_names"))))  # one row each
    penalty = sum((F.col(c) * w for c, w in PENALTIES), F.lit(0.0)) / F.col("total")
    quality = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.round(100 - F.least(F.lit(90.0), penalty * 22), 1)))
    return counts.withColumn("quality", quality)


def duplicate_names(items: DataFrame) -> DataFrame:
    """File names that several items share without regard to case; the least spelling stands for all."""
    return items.groupBy(F.lower("filename").alias("name")).agg(F.min("filename").alias("filename"), F.count("*").alias("n")).where("n > 1")


def folders(items: DataFrame) -> DataFrame:
    """Items, bytes and gaps by folder."""
    return items.groupBy(text.folder_of(F.col("path")).alias("folder")).agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"),
        F.count_if(F.col("tagged_at").isNull()).alias("untagged"),
        F.count_if(F.trim(F.coalesce("prompt", F.lit(""))) == "").alias("no_prompt"),
    )


def deduped(tags: DataFrame) -> DataFrame:
    """One row for each item and tag without regard to case: the highest confidence, the first at ties."""
    w = Window.partitionBy("item_id", F.lower("tag")).orderBy(F.desc("confidence"), "pos", "tag", "source")
    return tags.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def verdict(tags: DataFrame, severity: list[str]) -> DataFrame:
    """The label of the highest confidence among ``severity`` (mildest first); ties go to the severest."""
    rank = F.array_position(F.array(*map(F.lit, severity)), F.col("tag"))
    return tags.where(F.col("tag").isin(*severity)).groupBy("item_id").agg(F.max_by("tag", F.struct("confidence", rank)).alias("verdict"))


def child_lists(tags: DataFrame) -> DataFrame:
    """Each item's tags, the most confident first, as one string; rows of an item are few."""
    entry = F.struct((-F.col("confidence")).alias("c"), F.col("tag").alias("t"))
    return tags.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), "|").alias("tags"))


def top_per_group(frame: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of each group; ties by value."""
    counts = frame.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def trimmed(tags: DataFrame, blacklist: list[str], most: int) -> DataFrame:
    """Each item's ``most`` tags of highest confidence; rating rows are exempt, black-listed ones go."""
    kept = tags.where(~F.lower("tag").isin(*[t.lower() for t in blacklist]))
    w = Window.partitionBy("item_id").orderBy(F.desc("confidence"), "tag", "pos")
    others = kept.where("category <> 'rating'").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return others.unionByName(kept.where("category = 'rating'"))


def streaks(days: DataFrame) -> DataFrame:
    """Runs of consecutive days of ``key`` (``key``, ``day``): first day, last day, length."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("day"))
    islands = days.select("key", "day").distinct().withColumn("island", F.date_sub("day", n))
    return islands.groupBy("key", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")


def newest(frame: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def collision_suffixes(frame: DataFrame, stem: str) -> DataFrame:
    """``name``: the stem, with ``_1``, ``_2`` and so on for repeats in order of id."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy("id")) - 1
    return frame.withColumn("name", F.when(n == 0, F.col(stem)).otherwise(F.concat_ws("_", F.col(stem), n.cast("string"))))


def daily_pick(items: DataFrame, day: str, seed: int) -> DataFrame:
    """The item at place (crc32(day) + seed) mod n in order of id. Ids are counted in 4,096 ranges of
    their values, and only the range that holds the place is sorted."""
    span = items.agg(F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    step = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / 4096), F.lit(1))
    place = F.pmod(F.crc32(F.lit(day).cast("binary")) + F.lit(seed), F.col("n"))
    held = items.where("id IS NOT NULL").select("id").join(F.broadcast(span.select("lo", step.alias("step"), place.alias("place"))))  # one row
    held = held.withColumn("range", F.floor((F.col("id") - F.col("lo")) / F.col("step")))
    sizes = held.groupBy("range").agg(F.count("*").alias("size"))  # at most 4,096 rows
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("range")) - F.col("size"))
    inside = held.join(F.broadcast(before), "range").where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("size")))
    n = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    return inside.withColumn("n", n).where(F.col("n") == F.col("place") - F.col("before")).select("id")


def compare_sets(tags: DataFrame, a: int, b: int) -> DataFrame:
    """Common tags of two items, and those of one alone."""
    of = lambda i: F.sort_array(F.collect_set(F.when(F.col("item_id") == i, F.col("tag"))))
    held = tags.where(F.col("item_id").isin(a, b)).agg(of(a).alias("a"), of(b).alias("b"))
    return held.select(F.array_join(F.array_intersect("a", "b"), ",").alias("common"), F.array_join(F.array_except("a", "b"), ",").alias("only_a"), F.array_join(F.array_except("b", "a"), ",").alias("only_b"))
