"""The consistency report of a training set: triggers, shots, ratings, rare tags, spellings, twins.

Everything follows from two grouped passes over one frame of folded tags: one row for each item and
one for each tag. Findings are counts over those; examples are the first few of each finding, cut in
each task before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import datasets
from .dealing import dealt

#: Shots by distance, and ratings.
SHOTS = ("close-up", "portrait", "upper body", "cowboy shot", "lower body", "full body", "wide shot")
WHOLE_FIGURE = ("full body", "wide shot")
RATINGS = datasets.RATINGS
#: Findings, their severity and its place in the report.
SEVERITY = {
    "trigger-missing": 1, "trigger-coverage": 1, "trigger-collision": 1, "composition-fullbody": 2, "rating-duplicates": 2,
    "spelling-variants": 2, "rating-missing": 3, "low-frequency-tags": 3, "cooccurring-duplicates": 3,
}
SEVERITIES = {1: "high", 2: "medium", 3: "info"}
#: Items from which rare tags and the balance of shots are judged, and from which twins are.
FEW, FEW_TWINS = 10, 3
#: Items whose tags meet in one task.
ITEMS = 250_000


def folded(c: Column) -> Column:
    """Lower case, underscores as blanks, white space as one blank."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" ")), r"\s+", " "))


def caption_tags(c: Column) -> Column:
    """The folded parts of a caption between commas and line ends."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,\r\n]"), folded), lambda t: t != "")


def by_item(items: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each item (``id``): its rating rows (``ratings``), and the first shot among its tags by ``pos``."""
    key = F.col("key")
    own = tags.groupBy("item_id").agg(F.count_if(key.isin(*RATINGS)).alias("ratings"), F.min_by(F.when(key.isin(*SHOTS), key), F.when(key.isin(*SHOTS), F.col("pos"))).alias("shot"))
    joined = items.select("id").join(own, F.col("id") == F.col("item_id"), "left")
    return joined.select("id", F.coalesce("ratings", F.lit(0)).alias("ratings"), F.coalesce("shot", F.lit("unspecified")).alias("shot"))


def by_tag(tags: DataFrame) -> DataFrame:
    """Of each folded tag (``key``): how many items hold it, and its spellings but for case."""
    items = tags.select("key", "item_id").distinct().groupBy("key").agg(F.count("item_id").alias("n"))
    written = tags.select("key", F.lower(F.trim("tag")).alias("t")).distinct().groupBy("key").agg(F.count("t").alias("spellings"))
    return items.join(written, "key")


def shots(items: DataFrame, tags: DataFrame) -> DataFrame:
    """Items of each shot (``shot``, ``n``), also of those that none has."""
    every = items.sparkSession.createDataFrame([(s,) for s in (*SHOTS, "unspecified")], "shot string")
    found = by_item(items, _folded(tags)).groupBy("shot").agg(F.count("*").alias("n"))
    return every.join(found, "shot", "left").select("shot", F.coalesce("n", F.lit(0)).alias("n"))


def _folded(tags: DataFrame) -> DataFrame:
    return tags.select("item_id", "tag", "pos", folded(F.col("tag")).alias("key")).where("key <> ''")


def report(items: DataFrame, tags: DataFrame, captions: DataFrame, vocabulary: DataFrame, trigger: str, purpose: str, jaccard: float = 0.9, most: int = 150, examples: int = 5) -> DataFrame:
    """Findings on the items (``id``), their tags (``item_id``, ``tag``, ``pos``) and captions (``id``, ``caption``;
    an item without one lacks the trigger): ``code``, ``severity``, ``n``, ``total`` and ``examples``.

    * trigger-missing: no trigger for a character or a concept; trigger-coverage: captions without it;
      trigger-collision: it is a word of the ``vocabulary`` (``tag``);
    * composition-fullbody: of a character's ten items or more, fewer than a tenth (rounded to even)
      show the whole figure;
    * rating-duplicates and rating-missing: items of several ratings, and of none where some have one;
    * low-frequency-tags: tags of a single item, where there are ten items; spelling-variants: tags
      that are written in several ways; cooccurring-duplicates: pairs among the ``most`` frequent tags,
      the trigger aside, of at least the Jaccard index.

    A finding without a case is left out; without items there is none. Null and blank tags count as none.
    """
    spark = items.sparkSession
    known = dealt(items.select(F.col("id").alias("item_id")), "item_id", ITEMS).hint("shuffle_hash")
    rows, word = _folded(tags.join(known, "item_id", "left_semi")), " ".join(trigger.replace("_", " ").lower().split())
    per_item, per_tag = by_item(items, rows), by_tag(rows)
    said = items.select("id").join(captions.select("id", caption_tags(F.col("caption")).alias("said")), "id", "left")
    lacks = said.where(~F.coalesce(F.array_contains("said", word), F.lit(False)))

    case = lambda frame, code, what: frame.select(F.lit(code).alias("code"), what.cast("string").alias("what"), F.col("id").alias("place") if "id" in frame.columns else F.lit(0).cast("long").alias("place"))
    cases = [
        case(per_item.where("ratings > 1"), "rating-duplicates", F.col("id")),
        case(per_item.where("ratings = 0"), "rating-missing", F.col("id")),
        case(per_tag.where("n = 1"), "low-frequency-tags", F.col("key")),
        case(per_tag.where("spellings > 1"), "spelling-variants", F.col("key")),
    ]
    if word:
        cases.append(case(lacks, "trigger-coverage", F.col("id")))
        cases.append(case(vocabulary.where(folded(F.col("tag")) == word).select("tag").distinct(), "trigger-collision", F.col("tag")))
    elif purpose in ("character", "concept"):
        cases.append(case(items.limit(1).select(F.lit("none").alias("tag")), "trigger-missing", F.col("tag")))
    pairs = datasets.co_occurrence(rows.where(F.col("key") != word).select("item_id", F.col("key").alias("tag")).distinct(), jaccard, 3, most)
    cases.append(case(pairs.select(F.concat_ws(" + ", "a", "b").alias("tag")), "cooccurring-duplicates", F.col("tag")))
    found = cases[0]
    for c in cases[1:]:
        found = found.unionByName(c)
    counts = found.groupBy("code").agg(F.count("*").alias("n"))
    first = found.withColumn("turn", F.row_number().over(Window.partitionBy("code").orderBy("place", "what"))).where(F.col("turn") <= examples)
    shown = first.groupBy("code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "what"))), lambda e: e["what"]), ", ").alias("examples"))
    listed = counts.join(shown, "code")

    total = per_item.agg(F.count("*").alias("total"), F.count_if(F.col("shot").isin(*WHOLE_FIGURE)).alias("figures"))
    few = F.col("figures") < F.greatest(F.lit(1), F.bround(F.col("total") * 0.1).cast("long"))
    if purpose == "character":
        scarce = total.where((F.col("total") >= FEW) & few).select(F.lit("composition-fullbody").alias("code"), F.col("figures").alias("n"), F.lit("").alias("examples"))
        listed = listed.unionByName(scarce)
    severity = spark.createDataFrame([(c, k, SEVERITIES[k]) for c, k in SEVERITY.items()], "code string, place int, severity string")
    out = listed.join(F.broadcast(severity), "code").join(F.broadcast(total))  # nine rows, and one
    judged = (
        F.when(F.col("code") == "low-frequency-tags", F.col("total") >= FEW)
        .when(F.col("code") == "cooccurring-duplicates", F.col("total") >= FEW_TWINS)
        .when(F.col("code") == "rating-missing", F.col("n") < F.col("total")).otherwise(F.lit(True))
    )
    return out.where(judged & (F.col("total") > 0)).select("code", "severity", "place", "n", "total", "examples")
