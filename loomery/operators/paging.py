"""Stable sorts, offset and keyset pages, cursors, selection tokens and the search language."""

from __future__ import annotations

import base64
import dataclasses
import datetime as dt
import json
import re
import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import Filter

#: The order of ratings.
RATING_ORDER = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


def _rating() -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, name in enumerate(RATING_ORDER, start=1):
        out = out.when(F.col("ai_rating") == name, F.lit(k))
    return out.otherwise(F.lit(len(RATING_ORDER) + 1))


def _or(name, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


#: sort -> (key, whether it falls, whether ids fall at ties); what stands for a null is a fixed value
KEYS = {
    "newest": (lambda: F.coalesce("order_time", "created_at"), True, True),
    "oldest": (lambda: F.coalesce("order_time", "created_at"), False, False),
    "aesthetic_desc": (lambda: _or("aesthetic_score", 0.0), True, True),
    "aesthetic_asc": (lambda: _or("aesthetic_score", 0.0), False, False),
    "name_asc": (lambda: F.col("filename"), False, False),
    "name_desc": (lambda: F.col("filename"), True, True),
    "size_desc": (lambda: _or("file_size", 0), True, True),
    "size_asc": (lambda: _or("file_size", 0), False, False),
    "stars_desc": (lambda: _or("user_rating", 0), True, True),
    "stars_asc": (lambda: _or("user_rating", 0), False, False),
    "saturation_desc": (lambda: _or("saturation", -1.0), True, True),
    "saturation_asc": (lambda: _or("saturation", 999.0), False, False),
    "brightness_desc": (lambda: _or("brightness", -1.0), True, True),
    "brightness_asc": (lambda: _or("brightness", 999.0), False, False),
    "width_desc": (lambda: _or("width", 0), True, True),
    "pixels_desc": (lambda: F.coalesce(F.col("width") * F.col("height"), F.lit(0)), True, True),
    "generator": (lambda: F.lower("generator"), False, True),
    "checkpoint": (lambda: F.lower("checkpoint"), False, True),
    "generator_desc": (lambda: F.lower("generator"), True, True),
    "prompt_length": (lambda: F.char_length(_or("prompt", "")), True, True),
    "prompt_length_asc": (lambda: F.char_length(_or("prompt", "")), False, False),
    "rating": (_rating, False, False),
    "rating_desc": (_rating, True, True),
    "tag_count": (lambda: F.col("n_tags"), True, True),
    "tag_count_asc": (lambda: F.col("n_tags"), False, False),
    "skew_desc": (lambda: _or("brightness_skew", -999.0), True, True),
    "skew_asc": (lambda: _or("brightness_skew", 999.0), False, False),
    "random": (lambda: (F.col("id") * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), False, False),
}


def sort_key(sort: str) -> Column:
    return KEYS[sort][0]()


def order(sort: str) -> list[Column]:
    """Nulls come first where keys rise and last where they fall, unless the key puts a value in
    their place; ids decide ties, and among equal generators library order comes before them."""
    key, falls, ids_fall = KEYS[sort]
    between = [F.coalesce("order_time", "created_at").desc_nulls_last()] if sort.startswith("generator") else []
    return [key().desc_nulls_last() if falls else key().asc_nulls_first(), *between, F.desc("id") if ids_fall else F.asc("id")]


def page(frame: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the sort: a top-k, not a whole sort."""
    ordered = frame.orderBy(*order(sort))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def numbered(rows: DataFrame, sort: str) -> DataFrame:
    """A page's ids with their places; a page is a bounded number of rows."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order(sort))).cast("long")).select("id", "place", *(["n_tags"] if "n_tags" in rows.columns else []))


def with_tag_count(frame: DataFrame, tags: DataFrame) -> DataFrame:
    """``n_tags`` of each item: distinct tags, 0 where it has none; tags are counted before the join."""
    counts = tags.groupBy("item_id").agg(F.count_distinct("tag").alias("n_tags"))
    return frame.join(counts, F.col("id") == F.col("item_id"), "left").drop("item_id").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))


#: The version of cursors.
CURSOR_VERSION = 1
_CURSOR = "v string, id string, sort_value string"


def cursors(item_id: Column, key: Column) -> Column:
    """The cursor of each row's place: its id and sort value (text or null) as URL-safe base64 of compact JSON."""
    held = F.to_json(F.struct(item_id.alias("id"), key.cast("string").alias("sort_value"), F.lit(CURSOR_VERSION).alias("v")), {"ignoreNullFields": "false"})
    return F.rtrim(F.translate(F.base64(F.encode(held, "utf-8")), "+/=\r\n", "-_ "))


def read_cursors(cursor: Column) -> Column:
    """``id`` and ``sort_value`` of each cursor as a struct, null where it isn't one; a bare number is an id
    without a value."""
    plain = F.trim(cursor)
    raw = F.rpad(F.translate(plain, "-_", "+/"), F.ceil(F.char_length(plain) / 4).cast("int") * 4, F.lit("="))
    json = F.when(raw.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.decode(F.try_to_binary(raw, F.lit("base64")), "utf-8"))
    held = F.from_json(json, _CURSOR)
    value = F.get_json_object(json, "$.sort_value")
    number = F.try_to_number(F.when(held["id"].rlike(r"^-?\d{1,18}$"), held["id"]), F.lit("S999999999999999999")).cast("long")
    given = F.struct(number.alias("id"), value.alias("sort_value"))
    opaque = F.when((held["v"] == str(CURSOR_VERSION)) & number.isNotNull(), given)
    bare = F.struct(F.when(plain.rlike(r"^\d{1,18}$"), plain).cast("long").alias("id"), F.lit(None).cast("string").alias("sort_value"))
    return F.when(plain.rlike(r"^\d{1,18}$"), bare).otherwise(opaque)


def encode_cursor(item_id: int, key) -> str:
    """The cursor of one place, as ``cursors`` gives it."""
    value = key.isoformat() if isinstance(key, dt.datetime) else key
    held = json.dumps({"id": item_id, "sort_value": value, "v": CURSOR_VERSION}, separators=(",", ":"))
    return base64.urlsafe_b64encode(held.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, str | None]:
    """Id and sort value; a bare number is an id without a value."""
    if re.fullmatch(r"\d+", cursor):
        return int(cursor), None
    held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return held["id"], held["sort_value"]


def keyset_page(frame: DataFrame, sort: str, limit: int, cursor: str | None = None) -> DataFrame:
    """The page after a cursor, for ``newest`` and ``oldest``: one row comparison, no offset."""
    if cursor:
        key, falls, _ = KEYS[sort]
        item_id, value = decode_cursor(cursor)
        if value is None:
            frame = frame.where(F.col("id") < item_id if falls else F.col("id") > item_id)
        else:
            k, v = key(), F.lit(value).cast("timestamp")
            later = (k < v) | k.isNull() if falls else k > v
            tie = (k == v) & (F.col("id") < item_id if falls else F.col("id") > item_id)
            frame = frame.where(later | tie)
    return page(frame, sort, limit)


def encode_selection(f: Filter) -> str:
    """The filter as a token from which the same selection can be rebuilt."""
    plain = {k: v for k, v in dataclasses.asdict(f).items() if v != getattr(Filter(), k)}
    return base64.urlsafe_b64encode(json.dumps(plain, default=str, sort_keys=True).encode()).decode()


def decode_selection(token: str) -> Filter:
    held = json.loads(base64.urlsafe_b64decode(token))
    for k, v in held.items():
        if isinstance(v, list):
            held[k] = tuple(v)
        elif k in ("date_from", "date_to"):
            held[k] = dt.date.fromisoformat(v)
    return Filter(**held)


#: Search keys: of lists (with the list that excludes) and of numbers (with both bounds).
LISTS = {
    "tag": ("tags", "exclude_tags"),
    "generator": ("generators", "exclude_generators"),
    "rating": ("ratings", "exclude_ratings"),
    "checkpoint": ("checkpoints", "exclude_checkpoints"),
    "lora": ("loras", "exclude_loras"),
    "prompt": ("prompt_terms", "exclude_prompts"),
    "hue": ("color_hues", "exclude_color_hues"),
}
NUMBERS = {
    "width": ("min_width", "max_width", int),
    "height": ("min_height", "max_height", int),
    "aesthetic": ("min_aesthetic", "max_aesthetic", float),
    "saturation": ("min_saturation", "max_saturation", float),
    "brightness": ("brightness_min", "brightness_max", float),
    "stars": ("min_user_rating", "max_user_rating", int),
}
_TERM = re.compile(r"(-?)(\w+)(!=|>=|<=|:|>|<|=)(.+)")


def parse_search(raw: str) -> Filter:
    """A filter from terms: ``key:value``, ``-key:value``, ``key!=value``, ``key>=n``, ``key:a..b``,
    ``date:2024`` (or a month, a day, a range); what has no key is searched for. ``<`` and ``>`` on
    numbers keep the bound itself; on dates they mean before and after the whole period."""
    held: dict = {}
    words = []
    for term in shlex.split(raw):
        m = _TERM.fullmatch(term)
        key = m[2].lower() if m else ""
        if key in LISTS:
            name = LISTS[key][m[1] == "-" or m[3] == "!="]
            held[name] = (*held.get(name, ()), m[4])
        elif key in NUMBERS:
            low, high, kind = NUMBERS[key]
            a, dots, b = m[4].partition("..")
            bounds = (a, b) if dots else (a, a) if m[3] in ":=" else (a, "") if ">" in m[3] else ("", a)
            for name, value in zip((low, high), bounds):
                if value:
                    held[name] = kind(value)
        elif key == "date":
            a, dots, b = m[4].partition("..")
            first, last = _period(a)
            if dots:
                held |= {"date_from": first, "date_to": _period(b)[1]}
            elif m[3] in ":=":
                held |= {"date_from": first, "date_to": last}
            elif m[3] == ">":
                held["date_from"] = last + dt.timedelta(days=1)
            elif m[3] == ">=":
                held["date_from"] = first
            elif m[3] == "<":
                held["date_to"] = first - dt.timedelta(days=1)
            else:
                held["date_to"] = last
        elif key in ("folder", "artist", "seed"):
            held[key] = int(m[4]) if key == "seed" else m[4]
        else:
            words.append(term)
    if words:
        held["search"] = " ".join(words)
    return Filter(**held)


def _period(text: str) -> tuple[dt.date, dt.date]:
    parts = [int(x) for x in text.split("-")]
    first = dt.date(*(parts + [1, 1])[:3])
    if len(parts) == 1:
        return first, dt.date(parts[0], 12, 31)
    if len(parts) == 2:
        return first, (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    return first, first
