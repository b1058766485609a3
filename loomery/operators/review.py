"""Review queues, readiness, packages and the writes that keep items and their derived data in step."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions import colors, records, text

from . import library

#: Columns of the three widths of an item.
WIDTHS = {
    "light": ("id", "path", "filename", "width", "height", "generator", "ai_rating"),
    "prompt": ("id", "path", "filename", "width", "height", "generator", "ai_rating", "prompt", "checkpoint"),
}
#: Codes of caption problems, the worst first.
CODES = ("unpaired", "empty", "multiline", "missing_trigger", "conflicting_rating")
#: What stops an export (0), what harms it (1) and what is worth a look (2).
SEVERITIES = {"unreadable": 0, "no_caption": 1, "untagged": 1, "several_ratings": 1, "small": 2, "low_score": 2}


def projected(items: DataFrame, width: str) -> DataFrame:
    """``items`` in a width (``light``, ``prompt`` or, by any other name, full); the scan reads no more."""
    return items.select(*WIDTHS[width]) if width in WIDTHS else items


def roll_up(found: DataFrame) -> DataFrame:
    """Codes (``code``, ``n``, ``examples``) with their ``place``, the worst first."""
    return found.withColumn("place", F.array_position(F.array(*map(F.lit, CODES)), F.col("code")).cast("int"))


def issues(items: DataFrame, tags: DataFrame, ratings: list[str], least_side: int, least_score: float) -> DataFrame:
    """One row (``id``, ``kind``, ``severity``) for each thing to review about an item."""
    held = tags.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("tag").isin(*ratings), F.col("tag"))).alias("rated"))
    c = F.col
    holds = {
        "unreadable": F.coalesce("is_readable", F.lit(1)) == 0,
        "no_caption": (F.trim(F.coalesce("ai_caption", F.lit(""))) == "") & (F.trim(F.coalesce("nl_caption", F.lit(""))) == ""),
        "untagged": c("n").isNull(),
        "several_ratings": c("rated") > 1,
        "small": F.least("width", "height") < least_side,
        "low_score": c("aesthetic_score") < least_score,
    }
    found = F.array_compact(F.array(*(F.when(holds[k], F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s in SEVERITIES.items())))
    return items.join(held, "id", "left").select("id", F.explode(found).alias("f")).select("id", "f.kind", "f.severity")


def review_page(found: DataFrame, limit: int, after: tuple[int, str, int] | None = None) -> DataFrame:
    """The next ``limit`` issues after a key of severity, kind and id."""
    if after is not None:
        severity, kind, last = after
        c = F.col
        found = found.where((c("severity") > severity) | ((c("severity") == severity) & ((c("kind") > kind) | ((c("kind") == kind) & (c("id") > last)))))
    return found.orderBy("severity", "kind", "id").limit(limit)


def signature(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text under a key of the plan, as lower-case hex."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signed_cursors(page: DataFrame, key: bytes) -> DataFrame:
    """The cursor that goes on after each issue: its key, a bar, and the signature of the key."""
    payload = F.concat_ws(":", F.col("severity").cast("string"), "kind", F.col("id").cast("string"))
    return page.select("id", "kind", F.concat(payload, F.lit("|"), signature(payload, key)).alias("cursor"))


def readiness(found: DataFrame) -> DataFrame:
    """Issues by kind: how many, the least id as a sample, and whether they block the export."""
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n"), F.min("id").alias("sample")).withColumn("blocks", F.col("severity") == 0)


def sidecars(rows: DataFrame, ending: str = ".txt") -> DataFrame:
    """A file for each caption (``id``, ``filename``, ``caption``): the item's stem in lower case with an
    ending, and ``_2``, ``_3`` and so on by id where several items share it."""
    stem = F.lower(F.regexp_replace("filename", r"\.[^./]*$", ""))
    turn = F.row_number().over(Window.partitionBy("stem").orderBy("id"))
    name = F.concat(F.col("stem"), F.when(F.col("turn") > 1, F.concat(F.lit("_"), F.col("turn").cast("string"))).otherwise(""), F.lit(ending))
    return rows.withColumn("stem", stem).withColumn("turn", turn).select("id", name.alias("file"), "caption")


def write_sidecars(files: DataFrame, path: str) -> None:
    """Each caption as a text file in a folder of its file's name; Spark commits or drops all of them."""
    files.select("file", F.col("caption").alias("value")).write.partitionBy("file").text(path)


def package(files: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of a dataset package: picture, caption file, state (``unreadable``, ``no_caption``, ``ok``) and
    the digest of the caption of rows that are ``ok``."""
    both = files.join(items.select("id", "path", "is_readable"), "id")
    state = F.when(F.coalesce("is_readable", F.lit(1)) == 0, "unreadable").when(F.trim(F.coalesce("caption", F.lit(""))) == "", "no_caption").otherwise("ok")
    return both.select("id", "path", "file", state.alias("state"), F.when(state == "ok", F.sha2("caption", 256)).alias("digest"))


def workspace(items: DataFrame, library_id: str) -> DataFrame:
    """The index of a library as JSON lines by id (items without a library belong to ``main``)."""
    own = items.where(F.coalesce("library_id", F.lit("main")) == library_id)
    return own.select("id", F.to_json(F.struct("id", "path", "width", "height", "generator", "checkpoint")).alias("line"))


def tag_batch(items: DataFrame, tags: DataFrame, fresh: DataFrame, ratings: list[str], moment: Column) -> tuple[DataFrame, DataFrame]:
    """Items and tags after a batch of tag rows: rows are replaced (manual ones stay), and the items of
    the batch get ``moment`` as their time and the rating of the most confident rating row (ties: the
    severest, the last of ``ratings``), or none."""
    new = library.replace_rows(tags, fresh)
    rank = F.array_position(F.array(*map(F.lit, ratings)), F.col("tag"))
    rated = new.where(F.col("tag").isin(*ratings)).groupBy("item_id").agg(F.max_by("tag", F.struct("confidence", rank)).alias("__rating"))
    hit = fresh.select("item_id").distinct().join(rated, "item_id", "left").withColumn("__hit", F.lit(True))
    joined = items.join(hit, F.col("id") == F.col("item_id"), "left").drop("item_id")
    out = joined.withColumn("ai_rating", F.when(F.col("__hit"), F.col("__rating")).otherwise(F.col("ai_rating"))).withColumn("tagged_at", F.when(F.col("__hit"), moment).otherwise(F.col("tagged_at")))
    return out.drop("__rating", "__hit"), new


def patched(items: DataFrame, patch: DataFrame, *columns: str) -> DataFrame:
    """``items`` with the values of ``patch`` (``id`` and some ``columns``, one row for an id) where it has any."""
    named = patch.select("id", *(F.col(c).alias(f"__{c}") for c in columns))
    joined = items.join(named, "id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def reparsed(items: DataFrame, patch: DataFrame) -> DataFrame:
    """``patched`` prompts and checkpoints, with the tokens and LoRAs that follow from the new prompt."""
    out = patched(items, patch, "generator", "prompt", "checkpoint")
    return out.withColumn("tokens", text.prompt_tokens(F.col("prompt"))).withColumn("loras", text.lora_names(F.col("prompt")))


def repair(items: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Items without a prompt and a known generator, parsed anew from their stored chunks (``id``,
    ``meta``); items whose chunks tell nothing stay as they were."""
    lacking = items.where(F.trim(F.coalesce("prompt", F.lit(""))) == "").select("id")
    chunks = envelopes.join(lacking, "id", "left_semi").withColumn("g", records.generator(F.col("meta")))
    record = records.parsed(F.col("meta"), F.col("g"))
    patch = chunks.where("g <> 'unknown'").withColumn("r", record).select("id", F.col("g").alias("generator"), F.col("r.prompt").alias("prompt"), F.col("r.checkpoint").alias("checkpoint"))
    return patched(items, patch, "generator", "prompt", "checkpoint")


def copied_state(items: DataFrame, pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``items`` with the derived ``columns`` of their ``source`` (``pairs``: ``source``, ``target``, one row for
    a target), nulls included. A pair of an item with itself, or of an unknown source, changes nothing."""
    origin = items.select(F.col("id").alias("source"), *(F.col(c).alias(f"__{c}") for c in columns))
    found = pairs.where("source <> target").join(origin, "source").select(F.col("target").alias("id"), F.lit(True).alias("__hit"), *(f"__{c}" for c in columns))
    joined = items.join(found, "id", "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__hit", *(f"__{c}" for c in columns))


def settle(reviews: DataFrame, choices: DataFrame) -> DataFrame:
    """Reviews (``review``, ``path``, ``candidates``) after choices (``review``, ``chosen``): ``resolved`` if the
    choice is a candidate that no earlier review took, ``conflict`` if not, else ``pending``."""
    first = reviews.join(choices.where("chosen IS NOT NULL"), "review").where(F.array_contains("candidates", F.col("chosen")))
    taken = first.groupBy("chosen").agg(F.min("review").alias("review"))  # of each candidate the first review that chose it
    joined = reviews.join(choices, "review", "left").join(taken.select("review", F.col("chosen").alias("id")), "review", "left")
    state = F.when(F.col("chosen").isNull(), "pending").when(F.col("id").isNotNull(), "resolved").otherwise("conflict")
    return joined.select("review", "path", state.alias("state"), "id")


def moves(items: DataFrame, folder: Column) -> DataFrame:
    """Where items go: ``folder`` and their file name, with ``_2``, ``_3`` and so on before the ending where
    several go to one name (whatever its case); items that are there already stay."""
    planned = items.select("id", "path", folder.alias("folder"), F.regexp_replace("path", r"^.*/", "").alias("name")).where(text.folder_of(F.col("path")) != F.col("folder"))
    turn = F.row_number().over(Window.partitionBy("folder", F.lower("name")).orderBy("id"))
    stem, ending = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    name = F.when(F.col("turn") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("turn").cast("string"), ending))
    return planned.withColumn("turn", turn).select("id", "path", F.concat(F.col("folder"), F.lit("/"), name).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) that a key and a seed fix, the same wherever the row lies."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") + 1) / (2.0**48 + 1)


def weighted_picks(counts: DataFrame, seed: int, excluded: DataFrame) -> DataFrame:
    """A tag of each category, drawn with the chance of its share (``tag``, ``category``, ``n``) among those not
    ``excluded``: the first of exponential arrival times, so one partial aggregate decides."""
    left = counts.join(excluded.select("tag").distinct(), "tag", "left_anti")
    time = -F.log(draw(F.col("tag"), seed)) / F.col("n")
    return left.groupBy("category").agg(F.min_by("tag", F.struct(time, "tag")).alias("tag"))


def merged(*frames: DataFrame) -> DataFrame:
    """Rows (``tag``, ``n``) of several frames, each tag once, of the first frame that has it: its place
    (``bucket``, from 0) and the most ``n`` there."""
    ranked = [f.select(text.normalize_token(F.col("tag")).alias("tag"), F.lit(k).alias("bucket"), F.col("n")) for k, f in enumerate(frames)]
    every = ranked[0]
    for f in ranked[1:]:
        every = every.unionByName(f)
    return every.groupBy("tag").agg(F.min(F.struct("bucket", (-F.col("n")).alias("n"))).alias("b")).select("tag", F.col("b.bucket").alias("bucket"), (-F.col("b.n")).alias("n"))


def crop_boxes(pixels: DataFrame, sizes: DataFrame, least: int, padding: float) -> DataFrame:
    """The box of the pixels (``id``, ``x``, ``y``, ``level``) of at least a level, padded by a percentage of its sides
    (rounded up) and kept inside the picture (``id``, ``width``, ``height``); pictures without any drop out."""
    box = pixels.where(F.col("level") >= least).groupBy("id").agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"))
    dx, dy = F.ceil((F.col("r") - F.col("l")) * padding / 100), F.ceil((F.col("b") - F.col("t")) * padding / 100)
    low, high = lambda e, d: F.greatest(F.lit(0), F.col(e) - d), lambda e, d, most: F.least(F.col(most), F.col(e) + d)
    return box.join(sizes, "id").select("id", "width", "height", low("l", dx).alias("left"), low("t", dy).alias("top"), high("r", dx, "width").alias("right"), high("b", dy, "height").alias("bottom"))


def subject_buckets(boxes: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """The size nearest in aspect (ties: the first) whose crop holds the box, and the crop: as near to
    the middle as the box lets it be. Pictures whose box fits no size get nulls."""
    c = F.col
    options = []
    for k, (w, h) in enumerate(sizes):
        wide = c("width") * h > c("height") * w
        cw = F.when(wide, F.greatest(F.lit(1), F.floor(c("height") * w / h))).otherwise(c("width"))
        ch = F.when(wide, c("height")).otherwise(F.greatest(F.lit(1), F.floor(c("width") * h / w)))
        fits = (c("right") - c("left") <= cw) & (c("bottom") - c("top") <= ch)
        distance = F.abs(c("width") * h - c("height") * w) / F.lit(h)
        options.append(F.when(fits, F.struct(distance.alias("d"), F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(h).alias("h"), cw.cast("long").alias("cw"), ch.cast("long").alias("ch"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    place = lambda side, crop, low, high: F.least(F.greatest(F.floor((c(side) - crop) / 2), F.greatest(F.lit(0), c(high) - crop)), F.least(c(low), c(side) - crop)).cast("long")
    out = boxes.withColumn("o", best)
    return out.select("id", c("o.w").alias("bucket_width"), c("o.h").alias("bucket_height"), place("width", c("o.cw"), "left", "right").alias("crop_left"), place("height", c("o.ch"), "top", "bottom").alias("crop_top"))


def colour_records(pixels: DataFrame) -> DataFrame:
    """Of each picture's pixels (``id``, ``r``, ``g``, ``b``): mean brightness and saturation (0 to 255), the
    temperature of the mean hue, and the shape and skew of brightness in 16 steps."""
    h, s, _ = colors.hsv(F.col("r"), F.col("g"), F.col("b"))
    level = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int")
    rows = pixels.select("id", h.alias("h"), s.alias("s"), level.alias("level"))
    means = rows.groupBy("id").agg(F.avg("level").alias("brightness"), (F.avg("s") * 2.55).alias("saturation"), (F.avg("h") * 255 / 360).alias("hue"))
    shape = colors.brightness_shape(rows, "id", "level").select("id", "skew", "shape")
    return means.join(shape, "id").select("id", F.round("brightness", 6).alias("brightness"), F.round("saturation", 6).alias("saturation"), colors.temperature(F.col("hue"), F.col("saturation")).alias("temperature"), F.round("skew", 4).alias("skew"), "shape")
