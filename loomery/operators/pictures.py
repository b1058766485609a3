"""The whole colour record of a picture, as grouped aggregates over its pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import colors

#: Bits of a channel that a bin of colours shares, and the colours of a record.
SHARED_BITS, TOP = 2, 5
STEPS = 16


def bins(pixels: DataFrame) -> DataFrame:
    """Pixels (``id``, ``r``, ``g``, ``b``) counted by picture and by the leading bits of their channels, with the
    mean colour of each bin: 64 rows at most for a picture, which tasks add up before they meet."""
    low = 8 - SHARED_BITS
    part = lambda c: F.shiftright(F.col(c).cast("int"), low)
    key = F.shiftleft(part("r"), 2 * SHARED_BITS).bitwiseOR(F.shiftleft(part("g"), SHARED_BITS)).bitwiseOR(part("b"))
    mean = lambda c: F.round(F.avg(c)).cast("int").alias(c)
    return pixels.groupBy("id", key.alias("bin")).agg(F.count("*").alias("n"), mean("r"), mean("g"), mean("b"))


def _hex(c: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c[x]), 2, "0") for x in "rgb"))


def dominant(pixels: DataFrame) -> DataFrame:
    """Of each picture the most frequent colours (ties: the darker bin) as JSON of ``hex`` and ``pct``."""
    held = bins(pixels).groupBy("id").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "bin", "r", "g", "b"))).alias("all"))
    first = F.transform(F.slice("all", 1, TOP), lambda c: F.struct(_hex(c).alias("hex"), F.round(-100.0 * c["n"] / F.col("total"), 1).alias("pct")))
    return held.select("id", F.to_json(first).alias("dominant_colors"))


def records(pixels: DataFrame) -> DataFrame:
    """The eight fields of each picture's record: dominant colours and their names, mean value and
    saturation (0 to 255), temperature of the mean direction of hues, histogram of brightness in 16
    steps, its skew and its shape. Pixels of null channels are left out; a picture without any
    has no record."""
    fine = pixels.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    h, s, _ = colors.hsv(F.col("r"), F.col("g"), F.col("b"))
    level = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int")
    rows = fine.select("id", h.alias("h"), s.alias("s"), F.greatest("r", "g", "b").alias("v"), level.alias("level"))
    counts = [F.count_if(F.floor(F.col("level") / (256 // STEPS)) == k).cast("string") for k in range(STEPS)]
    means = rows.groupBy("id").agg(
        F.avg("v").alias("v"), (F.avg("s") * 2.55).alias("s"), (colors.circular_mean(F.col("h")) * 255 / 360).alias("h"),
        F.concat(F.lit("["), F.concat_ws(",", *counts), F.lit("]")).alias("histogram"),
    )
    shape = colors.brightness_shape(rows, "id", "level").select("id", "skew", "shape")
    out = means.join(shape, "id").join(dominant(fine), "id")
    return out.select(
        "id", "dominant_colors", colors.dominant_names(F.col("dominant_colors")).alias("dominant_color_tags"), F.round("v", 6).alias("avg_brightness"), colors.temperature(F.col("h"), F.col("s")).alias("color_temperature"),
        F.round("s", 6).alias("color_saturation"), F.col("histogram").alias("brightness_histogram"), (F.round("skew", 4) + 0.0).alias("brightness_skew"), F.col("shape").alias("brightness_distribution"),
    )
