"""One filter contract for pages, counts, ids and bulk scopes.

All predicates are AND-ed; list values of one predicate are OR-ed, but for tags in ``and`` mode and
prompt terms. Predicates on the item become one condition that reaches the scan; those on child
frames become semi and anti joins, so an item is never repeated.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text

RATINGS = 4


@dataclass(frozen=True)
class Filter:
    """None and, for lists, () mean: no predicate. ``image_ids`` of () matches nothing."""

    generators: tuple = ()
    tags: tuple = ()
    tag_mode: str = "and"
    ratings: tuple = ()
    checkpoints: tuple = ()
    loras: tuple = ()
    search: str | None = None
    prompt_terms: tuple = ()
    prompt_match_mode: str = "contains"
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None
    aspect_ratio: str | None = None
    artist: str | None = None
    image_ids: tuple | None = None
    excluded_image_ids: tuple = ()
    min_aesthetic: float | None = None
    max_aesthetic: float | None = None
    aesthetic_unscored: bool = False
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    min_user_rating: int | None = None
    max_user_rating: int | None = None
    include_unreadable: bool = True
    brightness_min: float | None = None
    brightness_max: float | None = None
    color_temperature: str | None = None
    brightness_distribution: str | None = None
    color_hues: tuple = ()
    exclude_tags: tuple = ()
    exclude_generators: tuple = ()
    exclude_ratings: tuple = ()
    exclude_checkpoints: tuple = ()
    exclude_loras: tuple = ()
    exclude_prompts: tuple = ()
    exclude_colors: tuple = ()
    exclude_color_hues: tuple = ()
    collection_id: int | None = None
    scope: str | None = None
    folder: str | None = None
    has_metadata: bool | None = None
    no_caption: bool = False
    min_saturation: float | None = None
    max_saturation: float | None = None
    seed: int | None = None
    library_id: str | None = None


@dataclass
class Library:
    """The item frame and its child frames; a child that no predicate uses may be missing.

    tags (item_id, tag), artists (item_id, artist), members (collection_id, item_id), session (item_id).
    """

    items: DataFrame
    tags: DataFrame | None = None
    artists: DataFrame | None = None
    members: DataFrame | None = None
    session: DataFrame | None = None


def _folded(values) -> list[str]:
    return sorted({str(v).lower() for v in values})


def _range(c: Column, low, high) -> list[Column]:
    return ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])


def _hues() -> Column:
    return F.split("hues", ",")


def item_conditions(f: Filter) -> list[Column]:
    """The predicates that need the item's own columns only."""
    c = F.col
    out: list[Column] = []
    if f.library_id:
        out.append(F.coalesce(c("library_id"), F.lit("main")) == f.library_id)
    if not f.include_unreadable:
        out.append(F.coalesce(c("is_readable"), F.lit(1)) == 1)
    if f.generators:
        out.append(c("generator").isin(*f.generators))
    if f.ratings and len(set(f.ratings)) < RATINGS:
        out.append(c("ai_rating").isin(*f.ratings) | c("tagged_at").isNull())
    if f.checkpoints:
        out.append(F.lower("checkpoint").isin(*_folded(map(text.checkpoint_key, f.checkpoints))))
    if f.loras:
        out.append(F.arrays_overlap(text.lora_names(c("prompt")), F.array(*map(F.lit, _folded(f.loras)))))
    if f.search:
        needle = f.search.strip().lower()
        tokens = sorted({text.python_token(t) for t in needle.split(",")} - {""})[:8]
        held = text.prompt_tokens(c("prompt"))
        found = F.lower("filename").contains(needle) | F.coalesce(F.lower("checkpoint").contains(needle), F.lit(False))
        if tokens:
            found = found | F.exists(held, lambda x: F.exists(F.array(*map(F.lit, tokens)), lambda t: x.contains(t)))
        out.append(found)
    if f.folder:
        out.append(c("path").startswith(f.folder.rstrip("/") + "/"))
    for term in f.prompt_terms:
        t = text.python_token(term)
        out.append(F.array_contains(text.prompt_tokens(c("prompt")), t) if f.prompt_match_mode == "exact" else text.folded(c("prompt")).contains(t))
    for low, high, name in ((f.min_width, f.max_width, "width"), (f.min_height, f.max_height, "height")):
        out += _range(c(name), low or None, high or None)
    if f.aspect_ratio:
        ratio = F.when(c("height") > 0, c("width") / c("height"))
        out.append({"square": F.abs(ratio - 1) < 0.1, "landscape": ratio > 1.1, "portrait": ratio < 0.9}.get(f.aspect_ratio, F.lit(True)))
    out += [c("aesthetic_score").isNull()] if f.aesthetic_unscored else _range(c("aesthetic_score"), f.min_aesthetic, f.max_aesthetic)
    day = F.coalesce("order_time", "created_at")
    if f.date_from:
        out.append(day >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to:
        out.append(day < F.lit(f.date_to + dt.timedelta(days=1)).cast("timestamp"))
    out += _range(c("saturation"), f.min_saturation, f.max_saturation)
    if f.no_caption:
        out.append((F.coalesce("ai_caption", F.lit("")) == "") & (F.coalesce("nl_caption", F.lit("")) == ""))
    if f.seed is not None:
        value = lambda key: F.get_json_object("metadata_json", f"$.{key}").try_cast("bigint")
        out.append((value("seed") == f.seed) | (value("noise_seed") == f.seed))
    out += _range(c("user_rating"), f.min_user_rating or None, f.max_user_rating)
    if f.has_metadata is not None:
        known = F.coalesce(F.lower("generator") != "unknown", F.lit(False)) | (F.trim(F.coalesce("prompt", F.lit(""))) != "")
        out.append(known if f.has_metadata else ~known)
    out += _range(c("brightness"), f.brightness_min, f.brightness_max)
    if f.color_temperature in ("warm", "cool", "neutral"):
        out.append(c("color_temperature") == f.color_temperature)
    if f.brightness_distribution:
        out.append(c("brightness_distribution") == f.brightness_distribution)
    if f.color_hues:
        out.append(F.arrays_overlap(_hues(), F.array(*map(F.lit, f.color_hues))))
    if f.exclude_color_hues:
        out.append(c("hues").isNull() | ~F.arrays_overlap(_hues(), F.array(*map(F.lit, f.exclude_color_hues))))
    if f.exclude_generators:
        out.append(~F.lower("generator").isin(*_folded(f.exclude_generators)))
    if f.exclude_ratings:
        out.append(c("ai_rating").isNull() | ~c("ai_rating").isin(*f.exclude_ratings))
    if f.exclude_checkpoints:
        out.append(~F.lower("checkpoint").isin(*_folded(map(text.checkpoint_key, f.exclude_checkpoints))))
    if f.exclude_loras:
        out.append(~F.coalesce(F.arrays_overlap(text.lora_names(c("prompt")), F.array(*map(F.lit, _folded(f.exclude_loras)))), F.lit(False)))
    for term in f.exclude_prompts:
        t = text.python_token(term)
        held = F.array_contains(text.prompt_tokens(c("prompt")), t) if f.prompt_match_mode == "exact" else text.folded(c("prompt")).contains(t)
        out.append(~F.coalesce(held, F.lit(False)))
    if f.exclude_colors:
        out.append(c("color_temperature").isNull() | ~c("color_temperature").isin(*f.exclude_colors))
    return out


def _with_all_tags(tags: DataFrame, names) -> DataFrame:
    held = tags.where(F.col("tag").isin(*names)).groupBy("item_id").agg(F.count_distinct("tag").alias("n"))
    return held.where(F.col("n") == len(set(names))).select("item_id")


def apply(library: Library, f: Filter) -> DataFrame:
    """The items that the filter selects, each once."""
    out = library.items
    for condition in item_conditions(f):
        out = out.where(condition)
    on = lambda child: F.col("id") == child["item_id"]
    if f.image_ids is not None:
        out = _by_ids(out, f.image_ids, "left_semi") if f.image_ids else out.where(F.lit(False))
    if f.excluded_image_ids:
        out = _by_ids(out, f.excluded_image_ids, "left_anti")
    if f.tags:
        child = _with_all_tags(library.tags, f.tags) if f.tag_mode == "and" else library.tags.where(F.col("tag").isin(*f.tags))
        out = out.join(child, on(child), "left_semi")
    if f.exclude_tags:
        child = library.tags.where(F.lower("tag").isin(*_folded(f.exclude_tags)))
        out = out.join(child, on(child), "left_anti")
    if f.artist:
        child = library.artists.where(F.col("artist") == f.artist)
        out = out.join(child, on(child), "left_semi")
    if f.collection_id is not None:
        child = library.members.where(F.col("collection_id") == f.collection_id)
        out = out.join(child, on(child), "left_semi")
    if f.scope == "session":
        out = out.join(library.session, on(library.session), "left_semi")
    return out


def _by_ids(frame: DataFrame, ids, how: str) -> DataFrame:
    """Listed ids are a frame of their own, whatever their number; a null id is in no list."""
    listed = frame.sparkSession.createDataFrame([(int(i),) for i in ids], "item_id long").distinct()
    return frame.join(listed, F.col("id") == F.col("item_id"), how)


def count(library: Library, f: Filter) -> DataFrame:
    """The exact number of selected items, as ``total``."""
    return apply(library, f).agg(F.count("*").alias("total"))
