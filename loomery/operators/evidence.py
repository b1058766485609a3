"""The whole review queue: ten kinds of evidence about items, and fingerprints of what was reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import dealt

#: Kinds of evidence: what stops an export (0), what harms it (1) and what is worth a look (2).
SEVERITIES = {
    "file_missing": 0, "image_unreadable": 0, "empty_caption": 1, "rating_conflict": 1, "metadata_provenance_risk": 1,
    "low_tag_confidence": 2, "sidecar_metadata_dependency": 2, "small_image": 2, "low_aesthetic": 2, "duplicate_group": 2,
}
#: Kinds that are found among the items themselves, so that none of other items can be among them.
OWN = ("file_missing", "image_unreadable", "empty_caption", "small_image", "low_aesthetic")
#: Items that meet their evidence in one task.
ITEMS = 250_000
#: Sources of a field that only guess, and carriers that lie beside the picture.
FALLBACKS = ("global_candidate_fallback", "workflow_widget_fallback", "global_graph_fallback")
CARRIERS = ("txt", "json", "xmp")


def _fields(sources: DataFrame, held: tuple[str, ...]) -> DataFrame:
    """Of each item the fields (``id``, ``detail``) that come from one of some sources, by name."""
    return sources.where(F.col("source").isin(*held)).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("detail"))


def gathered(
    items: DataFrame, tags: DataFrame, captions: DataFrame, listing: DataFrame, sources: DataFrame, groups: DataFrame,
    ratings: tuple[str, ...], least_confidence: float, least_side: int, least_score: float, kinds: tuple[str, ...] = tuple(SEVERITIES),
) -> DataFrame:
    """One row (``id``, ``kind``, ``severity``, ``detail``) for each piece of evidence of the wanted kinds.

    ``captions`` has ``id``, ``caption`` (none counts as empty); ``listing`` the ``path`` of each file that is there;
    ``sources`` where each stored ``field`` of an item was read (``id``, ``field``, ``source``); ``groups`` losers
    and their keepers (``id``, ``keeper``). Details name the ratings in conflict, the number of tags under
    the least confidence, the fields in doubt, the sides, the score in hundredths, or the keeper. Only what the
    wanted kinds need is read.
    """
    c, none = F.col, F.lit(None).cast("string")
    items = items.where("id IS NOT NULL")
    rated = tags.where(c("tag").isin(*ratings)).groupBy(c("item_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("r"))
    doubted = tags.where(c("confidence") < least_confidence).groupBy(c("item_id").alias("id")).agg(F.count("*").cast("string").alias("detail"))
    said = captions.where(F.trim("caption") != "").select("id")
    known = dealt(items.select("id"), "id", ITEMS).hint("shuffle_hash")
    found = {
        "file_missing": lambda: items.join(listing.select("path").distinct(), "path", "left_anti").select("id", c("path").alias("detail")),
        "image_unreadable": lambda: items.where(F.coalesce("is_readable", F.lit(1)) == 0).select("id", none.alias("detail")),
        "empty_caption": lambda: known.join(said, "id", "left_anti").select("id", none.alias("detail")),
        "rating_conflict": lambda: rated.where(F.size("r") > 1).select("id", F.array_join("r", ",").alias("detail")),
        "low_tag_confidence": lambda: doubted,
        "metadata_provenance_risk": lambda: _fields(sources, FALLBACKS),
        "sidecar_metadata_dependency": lambda: _fields(sources, CARRIERS),
        "small_image": lambda: items.where(F.least("width", "height") < least_side).select("id", F.concat_ws("x", c("width").cast("string"), c("height").cast("string")).alias("detail")),
        "low_aesthetic": lambda: items.where(c("aesthetic_score") < least_score).select("id", F.round(c("aesthetic_score") * 100).cast("long").cast("string").alias("detail")),
        "duplicate_group": lambda: groups.select("id", c("keeper").cast("string").alias("detail")).union(groups.select(c("keeper").alias("id"), c("keeper").cast("string").alias("detail")).distinct()),
    }
    out = None
    for kind in kinds:
        rows = (found[kind]() if kind in OWN else found[kind]().join(known, "id", "left_semi")).select("id", F.lit(kind).alias("kind"), F.lit(SEVERITIES[kind]).alias("severity"), "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def _fingerprint(*parts: Column) -> Column:
    """Aggregate: one text for all rows, whatever their order: the sums of two parts of each row's digest."""
    own = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    half = lambda k: F.coalesce(F.sum(F.conv(F.substring(own, k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.concat_ws("-", half(1), half(13))


def report(items: DataFrame, found: DataFrame) -> DataFrame:
    """Readiness as one row: items, evidence, blockers, the items that no blocker names, and the
    fingerprints of the items and of the evidence, which change with any row of either."""
    scope = items.agg(F.count("*").alias("items"), _fingerprint(F.col("id")).alias("scope_hash"))
    seen = found.agg(F.count("*").alias("evidence"), F.count_if(F.col("severity") == 0).alias("blockers"), _fingerprint(*(F.col(c) for c in ("id", "kind", "severity", "detail"))).alias("input_hash"))
    ready = items.join(found.where("severity = 0"), "id", "left_anti").agg(F.count("*").alias("ready"))
    return scope.join(F.broadcast(seen)).join(F.broadcast(ready))  # one row each
