"""Colour functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper hue bounds in degrees and their names; red goes on from 340.
HUES = ((15, "red"), (42, "orange"), (68, "yellow"), (165, "green"), (195, "cyan"), (255, "blue"), (315, "purple"), (340, "pink"))
#: Hue bounds of a mean hue of 0 to 255, and the least saturation that has a temperature.
WARM_BELOW, COOL_FROM, WARM_FROM, COLOURLESS = 43, 85, 213, 30
#: Fixed value: the least share in percent of a dominant colour.
LEAST_SHARE = 15


def _bound(value: Column, of) -> Column:
    """``of(value)``, where ``value`` is computed once however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def rgb(hex_color: Column) -> tuple[Column, Column, Column]:
    """Channels (0-255) of ``#rrggbb``; null if malformed."""
    digits = F.regexp_extract(F.lower(hex_color), r"^#?([0-9a-f]{6})$", 1)
    part = lambda k: F.when(digits != "", F.conv(F.substring(digits, k, 2), 16, 10).cast("int"))
    return part(1), part(3), part(5)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in percent."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, 60 * (g - b) / d).when(top == g, 60 * (b - r) / d + 120).otherwise(60 * (r - g) / d + 240)
    return F.when(hue < 0, hue + 360).otherwise(hue), F.when(top == 0, F.lit(0.0)).otherwise(100.0 * d / top), top / 2.55


def hue_name(hex_color: Column) -> Column:
    """The name of a colour, in this order: black, white and gray by value and saturation; null for
    skin tones (warm, pale and bright), which tell nothing; brown for dark warm hues; pink for pale
    reds; else by hue. Null if malformed."""
    channels = _bound(hex_color, lambda c: F.struct(*(x.alias(n) for x, n in zip(rgb(c), "rgb"))))
    measured = _bound(channels, lambda c: F.struct(*(x.alias(n) for x, n in zip(hsv(c["r"], c["g"], c["b"]), "hsv"))))
    return _bound(measured, lambda m: _named(m["h"], m["s"], m["v"]))


def _named(h: Column, s: Column, v: Column) -> Column:
    reddish = (h >= 340) | (h < 15)
    none = F.lit(None).cast("string")
    out = F.when(h.isNull(), none).when(v < 14, "black").when((s < 10) & (v > 82), "white").when(s < 10, "gray")
    out = out.when(h.between(15, 45) & (s <= 45) & (v > 72), none).when(h.between(15, 50) & (v <= 62), "brown").when(reddish & (s <= 45) & (v > 75), "pink")
    for bound, name in HUES:
        out = out.when(h < bound, name)
    return out.otherwise("red")


def dominant_names(colors_json: Column) -> Column:
    """The distinct names of the colours of a JSON list of ``hex`` and ``pct`` that take their share, in
    order, each between commas (",red,white,"); empty if there are none or the JSON is malformed."""
    entries = F.coalesce(F.from_json(colors_json, "array<struct<hex:string,pct:double>>"), F.array().cast("array<struct<hex:string,pct:double>>"))
    names = F.array_distinct(F.array_compact(F.transform(F.filter(entries, lambda e: e["pct"] >= LEAST_SHARE), lambda e: hue_name(e["hex"]))))
    return F.when(F.size(names) == 0, "").otherwise(F.concat(F.lit(","), F.array_join(names, ","), F.lit(",")))


def temperature(hue: Column, saturation: Column) -> Column:
    """neutral under a least saturation, else warm or cool by the mean hue (0 to 255); null of nulls."""
    return (
        F.when(hue.isNull() | saturation.isNull(), F.lit(None).cast("string"))
        .when(saturation < COLOURLESS, "neutral")
        .when((hue < WARM_BELOW) | (hue >= WARM_FROM), "warm")
        .when(hue >= COOL_FROM, "cool")
        .otherwise("neutral")
    )


def brightness_shape(pixels: DataFrame, key: str, level: str) -> DataFrame:
    """Per ``key`` of pixel levels (0 to 255): their number, population skew, and the shape of the
    histogram: both ends, the lower or upper quarter, the middle half, or balanced."""
    share = lambda lo, hi: F.count_if(F.col(level).between(lo * 16, hi * 16 + 15)) / F.count("*")
    sums = pixels.groupBy(key).agg(
        F.count("*").alias("n"), F.coalesce(F.skewness(level), F.lit(0.0)).alias("skew"),
        share(0, 1).alias("low"), share(14, 15).alias("high"), share(0, 3).alias("lower"), share(12, 15).alias("upper"), share(4, 11).alias("middle"),
    )
    shape = (
        F.when((F.col("low") > 0.2) & (F.col("high") > 0.2) & (F.col("low") + F.col("high") > 0.5), "edge_heavy")
        .when(F.col("lower") > 0.5, "left_heavy")
        .when(F.col("upper") > 0.5, "right_heavy")
        .when(F.col("middle") > 0.5, "middle_heavy")
        .otherwise("balanced")
    )
    return sums.select(key, "n", "skew", shape.alias("shape"))


def circular_mean(degrees: Column) -> Column:
    """Aggregate: the mean direction in degrees, 0 to 360."""
    mean = F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))
    return F.when(mean < 0, mean + 360).otherwise(mean)
