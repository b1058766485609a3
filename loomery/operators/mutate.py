"""Bulk changes as pure functions of frames: each gives the new rows; a report is a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facets import deduped


def find_replace(tags: DataFrame, find: str, replace: str, mode: str = "exact") -> DataFrame:
    """Tags renamed (``exact``, ``ci`` or ``regex`` on the whole tag); an empty replacement deletes.
    A renamed row becomes manual, and rows are deduplicated per item without regard to case."""
    tag = F.col("tag")
    hit = {"exact": tag == find, "ci": F.lower(tag) == find.lower(), "regex": tag.rlike(f"^(?:{find})$")}[mode]
    name = F.regexp_replace(tag, f"^(?:{find})$", replace) if mode == "regex" else F.lit(replace)
    out = tags.withColumn("__hit", hit).withColumn("tag", F.when(F.col("__hit"), name).otherwise(tag))
    out = out.withColumn("source", F.when(F.col("__hit"), F.lit("manual")).otherwise(F.col("source"))).drop("__hit")
    return deduped(out.where("tag <> ''"))


def bulk_add(tags: DataFrame, items: DataFrame, names: list[str]) -> DataFrame:
    """``names`` added to all ``items`` (``id``) that lack them without regard to case. The names
    are a constant list; nothing is crossed but that list."""
    wanted = items.select(F.col("id").alias("item_id"), F.explode(F.array(*map(F.lit, names))).alias("tag"))
    held = tags.select("item_id", F.lower("tag").alias("__low")).distinct()
    fresh = wanted.withColumn("__low", F.lower("tag")).join(held, ["item_id", "__low"], "left_anti").drop("__low")
    return tags.unionByName(fresh.select("item_id", "tag", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), F.lit("general").alias("category"), F.lit(0).cast("int").alias("pos")), allowMissingColumns=True)


def bulk_remove(tags: DataFrame, names: list[str], fold: bool = True) -> DataFrame:
    """Tags without ``names``; a null tag stays."""
    hit = F.lower("tag").isin(*[n.lower() for n in names]) if fold else F.col("tag").isin(*names)
    return tags.where(~F.coalesce(hit, F.lit(False)))


def cleanup(tags: DataFrame, least: float) -> DataFrame:
    """Tags at or over a confidence, deduplicated; manual ones stay whatever theirs."""
    return deduped(tags.where((F.col("confidence") >= least) | (F.col("source") == "manual")))


def digest(tags: DataFrame) -> DataFrame:
    """A digest of each item's set of tag names, for conflict checks before an undo."""
    return tags.groupBy("item_id").agg(F.sha1(F.to_json(F.sort_array(F.collect_set(F.lower("tag"))))).alias("digest"))


def undo(current: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tags with the rows ``before`` put back for each item whose names are still those of
    ``after``, and the items in conflict (``item_id``), which stay as they are."""
    state = digest(after).join(digest(current).withColumnRenamed("digest", "now"), "item_id", "full_outer")
    touched = before.select("item_id").union(after.select("item_id")).distinct()
    conflict = state.where(~F.col("digest").eqNullSafe(F.col("now"))).select("item_id").join(touched, "item_id", "left_semi")
    safe = touched.join(conflict, "item_id", "left_anti")
    kept = current.join(safe, "item_id", "left_anti")
    return kept.unionByName(before.join(safe, "item_id", "left_semi"), allowMissingColumns=True), conflict


def upsert(index: DataFrame, incoming: DataFrame, key: str, preserve: tuple[str, ...]) -> DataFrame:
    """``index`` with ``incoming`` rows (one per key) laid over: columns in ``preserve`` keep the old
    value where the new one is null, others take the new one. ``state``: new, updated or kept."""
    old, new = index.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()

    def column(name: str) -> Column:
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}") if name in incoming.columns else F.lit(None)
        return (F.coalesce(n, o) if name in preserve or name == key else F.when(fresh, n).otherwise(o)).alias(name)

    state = F.when(~fresh, "kept").when(F.col(f"o.{key}").isNull(), "new").otherwise("updated")
    return joined.select(*(column(c) for c in index.columns), state.alias("state"))


def invalidated(index: DataFrame, listing: DataFrame, derived: tuple[str, ...]) -> DataFrame:
    """Rows whose file (``path``, ``size``) changed lose their derived columns."""
    seen = listing.select("path", F.col("size").alias("__size"))
    out = index.join(seen, "path", "left").withColumn("changed", F.coalesce(F.col("__size") != F.col("size"), F.lit(False)))
    for c in derived:
        out = out.withColumn(c, F.when(~F.col("changed"), F.col(c)))
    return out.drop("__size")


def destination(base: str, by: Column) -> Column:
    """The folder of an item split by a column; blanks go to ``unknown``; unsafe characters to ``_``."""
    name = F.trim(F.regexp_replace(F.coalesce(by, F.lit("")), r'[<>:"/\\|?*]', "_"))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.when(name == "", F.lit("unknown")).otherwise(name))
