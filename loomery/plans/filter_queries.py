"""Filtered pages, counts and ids: each predicate of the filter contract as a query of its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loomery.operators import filters, paging
from loomery.operators.filters import Filter, Library

from . import catalog

#: Members of collection 1: items of one customer residue, or those whose path is a favourite.
MEMBER = ("CAST(o_custkey % 4 AS BIGINT) AS collection_id", "o_orderkey AS item_id")
TOKENS = "list_distinct(list_filter(list_transform(string_split(regexp_replace(coalesce(prompt, ''), '<[^<>]*>', '', 'g'), ','), lambda t: trim(replace(lower(regexp_replace(regexp_replace(trim(t), '^[(\\[{\\s]+|[)\\]}\\s]+$', '', 'g'), ':\\s*-?[0-9]+(\\.[0-9]+)?$', '')), '_', ' '))), lambda t: length(t) > 1))"
#: The same in order, for prompts that repeat no token, as those of the mapping.
ORDERED = TOKENS[len("list_distinct(") : -1]
LORAS = "list_transform(regexp_extract_all(coalesce(prompt, ''), '<lora:([^:>]+)', 1), lambda t: lower(t))"
DAY = "coalesce(order_time, created_at)"


def library(spark, sf_dir) -> Library:
    tags = catalog.unique_tags(spark, sf_dir)
    artists = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("artist_"), (F.col("o_custkey") % 6).cast("string")).alias("artist"))
    members = catalog.table(spark, sf_dir, "orders").selectExpr(*MEMBER)
    session = catalog.table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("item_id"))
    return Library(catalog.items(spark, sf_dir), tags, artists, members, session)


#: name -> (filter, WHERE over items)
CASES = {
    "f01_tags_and": (Filter(tags=("brand_N1", "brand_N2")), "id IN (SELECT item_id FROM utags WHERE tag = 'brand_N1') AND id IN (SELECT item_id FROM utags WHERE tag = 'brand_N2')"),
    "f02_tags_or": (Filter(tags=("brand_N1", "Brand_R2"), tag_mode="or"), "id IN (SELECT item_id FROM utags WHERE tag IN ('brand_N1', 'Brand_R2'))"),
    "f03_generators": (Filter(generators=("O", "P")), "generator IN ('O', 'P')"),
    "f04_ratings_or_untagged": (Filter(ratings=("1-URGENT", "2-HIGH")), "ai_rating IN ('1-URGENT', '2-HIGH') OR tagged_at IS NULL"),
    "f05_checkpoints": (Filter(checkpoints=("models/MODEL_3.safetensors", "model_4 [abc123]")), "lower(checkpoint) IN ('model_3', 'model_4')"),
    "f06_loras": (Filter(loras=("Style1", "style3")), f"list_has_any({LORAS}, ['style1', 'style3'])"),
    "f07_search": (Filter(search="Look3"), f"lower(filename) LIKE '%look3%' OR lower(checkpoint) LIKE '%look3%' OR len(list_filter({TOKENS}, lambda t: contains(t, 'look3'))) > 0"),
    "f08_folder": (Filter(folder="/lib/3/"), "starts_with(path, '/lib/3/')"),
    "f09_prompt_contains": (Filter(prompt_terms=("blue_eyes", "look2")), "contains(replace(lower(prompt), '_', ' '), 'blue eyes') AND contains(replace(lower(prompt), '_', ' '), 'look2')"),
    "f10_prompt_exact": (Filter(prompt_terms=("smile", "look2"), prompt_match_mode="exact"), f"list_contains({TOKENS}, 'smile') AND list_contains({TOKENS}, 'look2')"),
    "f11_dimensions": (Filter(min_width=800, max_width=1400, min_height=0, max_height=1000), "width >= 800 AND width <= 1400 AND height <= 1000"),
    "f12_aspect_square": (Filter(aspect_ratio="square"), "height > 0 AND abs(width / height - 1) < 0.1"),
    "f12_aspect_portrait": (Filter(aspect_ratio="portrait"), "height > 0 AND width / height < 0.9"),
    "f12_aspect_landscape": (Filter(aspect_ratio="landscape"), "height > 0 AND width / height > 1.1"),
    "f13_aesthetic_range": (Filter(min_aesthetic=1.0, max_aesthetic=3.5), "aesthetic_score BETWEEN 1.0 AND 3.5"),
    "f13_unscored": (Filter(aesthetic_unscored=True, min_aesthetic=2.0), "aesthetic_score IS NULL"),
    "f14_days": (Filter(date_from=dt.date(1995, 3, 1), date_to=dt.date(1996, 2, 10)), f"{DAY} >= DATE '1995-03-01' AND {DAY} < DATE '1996-02-11'"),
    "f15_saturation": (Filter(min_saturation=20, max_saturation=60), "saturation BETWEEN 20 AND 60"),
    "f16_no_caption": (Filter(no_caption=True), "coalesce(ai_caption, '') = '' AND coalesce(nl_caption, '') = ''"),
    "f17_seed": (Filter(seed=7), "CASE WHEN json_valid(metadata_json) THEN (TRY_CAST(json_extract_string(metadata_json, '$.seed') AS BIGINT) = 7) IS TRUE OR (TRY_CAST(json_extract_string(metadata_json, '$.noise_seed') AS BIGINT) = 7) IS TRUE ELSE false END"),
    "f18_stars": (Filter(min_user_rating=4), "user_rating >= 4"),
    "f19_has_metadata": (Filter(has_metadata=True), "(lower(generator) <> 'unknown') IS TRUE OR trim(coalesce(prompt, '')) <> ''"),
    "f19_no_metadata": (Filter(has_metadata=False), "NOT ((lower(generator) <> 'unknown') IS TRUE OR trim(coalesce(prompt, '')) <> '')"),
    "f20_colour": (Filter(brightness_min=50, brightness_max=200, color_temperature="warm", brightness_distribution="high"), "brightness BETWEEN 50 AND 200 AND color_temperature = 'warm' AND brightness_distribution = 'high'"),
    "f21_hues_any": (Filter(color_hues=("white", "blue")), "list_has_any(string_split(hues, ','), ['white', 'blue'])"),
    "f21_hues_none": (Filter(exclude_color_hues=("white", "blue")), "hues IS NULL OR NOT list_has_any(string_split(hues, ','), ['white', 'blue'])"),
    "f22_artist": (Filter(artist="artist_2"), "id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 6 = 2)"),
    "f23_ids": (Filter(image_ids=tuple(range(1, 200, 3))), "id < 200 AND id % 3 = 1 AND id > 0"),
    "f23_no_ids": (Filter(image_ids=()), "false"),
    "f24_excluded_ids": (Filter(generators=("F",), excluded_image_ids=tuple(range(1, 200, 3))), "generator = 'F' AND NOT (id < 200 AND id % 3 = 1 AND id > 0)"),
    "f25_collection": (Filter(collection_id=1), "id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1)"),
    "f26_workspace": (Filter(library_id="main"), "coalesce(library_id, 'main') = 'main'"),
    "f27_session": (Filter(scope="session"), "id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)"),
    "f28_readable": (Filter(include_unreadable=False), "coalesce(is_readable, 1) = 1"),
    "f29_exclude_tags": (Filter(exclude_tags=("BRAND_N1", "brand_R2")), "id NOT IN (SELECT item_id FROM utags WHERE lower(tag) IN ('brand_n1', 'brand_r2'))"),
    "f30_exclude_generators": (Filter(exclude_generators=("o",)), "lower(generator) NOT IN ('o')"),
    "f31_exclude_ratings": (Filter(exclude_ratings=("1-URGENT",)), "ai_rating IS NULL OR ai_rating NOT IN ('1-URGENT')"),
    "f32_exclude_checkpoints": (Filter(exclude_checkpoints=("Model_3",)), "lower(checkpoint) NOT IN ('model_3')"),
    "f33_exclude_loras": (Filter(exclude_loras=("style2",)), f"NOT list_has_any({LORAS}, ['style2'])"),
    "f34_exclude_prompts": (Filter(exclude_prompts=("look2",)), "NOT contains(replace(lower(coalesce(prompt, '')), '_', ' '), 'look2')"),
    "f34_exclude_prompts_exact": (Filter(exclude_prompts=("look2", "smile"), prompt_match_mode="exact"), f"NOT list_contains({TOKENS}, 'look2') AND NOT list_contains({TOKENS}, 'smile')"),
    "f35_exclude_temperature": (Filter(exclude_colors=("warm",)), "color_temperature IS NULL OR color_temperature NOT IN ('warm')"),
    "f40_missing_colour": (None, "brightness IS NULL"),
    "f41_missing_prompt": (None, "trim(coalesce(prompt, '')) = '' AND coalesce(is_readable, 1) = 1"),
    "s02_point_lookup": (Filter(image_ids=(7,)), "id = 7"),
    "s15_folder_scope": (Filter(folder="/lib/2/sub1"), "starts_with(path, '/lib/2/sub1/')"),
    "f43_direct_children": (None, "regexp_matches(path, '^/lib/2/sub1/[^/]*$')"),
}
_PLAIN = {
    "f40_missing_colour": lambda: F.col("brightness").isNull(),
    "f41_missing_prompt": lambda: (F.trim(F.coalesce("prompt", F.lit(""))) == "") & (F.coalesce("is_readable", F.lit(1)) == 1),
    "f43_direct_children": lambda: F.col("path").startswith("/lib/2/sub1/") & ~F.substring("path", len("/lib/2/sub1/") + 1, 1 << 20).contains("/"),
}


def _case(name):
    f = CASES[name][0]

    def query(spark, sf_dir):
        if f is None:
            return catalog.items(spark, sf_dir).where(_PLAIN[name]()).select("id")
        return filters.apply(library(spark, sf_dir), f).select("id")

    return query


BUSY = Filter(generators=("O", "F"), exclude_tags=("brand_a3",), min_width=640, date_from=dt.date(1993, 1, 1), exclude_ratings=("5-LOW",), include_unreadable=False)
BUSY_SQL = "generator IN ('O', 'F') AND id NOT IN (SELECT item_id FROM utags WHERE lower(tag) IN ('brand_a3')) AND width >= 640 AND coalesce(order_time, created_at) >= DATE '1993-01-01' AND (ai_rating IS NULL OR ai_rating NOT IN ('5-LOW')) AND coalesce(is_readable, 1) = 1"

#: sort name -> ORDER BY in DuckDB; every key ends with the id.
SORTS = {
    "newest": f"{DAY} DESC NULLS LAST, id DESC",
    "oldest": f"{DAY} ASC NULLS FIRST, id ASC",
    "aesthetic_desc": "coalesce(aesthetic_score, 0) DESC, id DESC",
    "aesthetic_asc": "coalesce(aesthetic_score, 0) ASC, id ASC",
    "name_asc": "filename ASC, id ASC",
    "name_desc": "filename DESC, id DESC",
    "size_asc": "coalesce(file_size, 0) ASC, id ASC",
    "stars_asc": "coalesce(user_rating, 0) ASC, id ASC",
    "saturation_asc": "coalesce(saturation, 999) ASC, id ASC",
    "brightness_desc": "coalesce(brightness, -1) DESC, id DESC",
    "brightness_asc": "coalesce(brightness, 999) ASC, id ASC",
    "generator": "lower(generator) ASC NULLS FIRST, coalesce(order_time, created_at) DESC NULLS LAST, id DESC",
    "generator_desc": "lower(generator) DESC NULLS LAST, coalesce(order_time, created_at) DESC NULLS LAST, id DESC",
    "prompt_length": "length(coalesce(prompt, '')) DESC, id DESC",
    "prompt_length_asc": "length(coalesce(prompt, '')) ASC, id ASC",
    "rating_desc": "CASE ai_rating WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END DESC, id DESC",
    "skew_desc": "coalesce(brightness_skew, -999) DESC, id DESC",
    "skew_asc": "coalesce(brightness_skew, 999) ASC, id ASC",
    "size_desc": "coalesce(file_size, 0) DESC, id DESC",
    "stars_desc": "coalesce(user_rating, 0) DESC, id DESC",
    "saturation_desc": "coalesce(saturation, -1) DESC, id DESC",
    "random": "(id * 1103515245 + 12345) & 2147483647, id",
    "rating": "CASE ai_rating WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END, id ASC",
}
_NUMBERED = "SELECT id, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS place FROM items WHERE {where} ORDER BY {order} LIMIT {limit}{offset}"


def _sorted(sort):
    def query(spark, sf_dir):
        return paging.numbered(paging.page(filters.apply(library(spark, sf_dir), BUSY), sort, 50), sort)

    return query


def _tag_count(spark, sf_dir):
    return paging.numbered(paging.page(paging.with_tag_count(filters.apply(library(spark, sf_dir), BUSY), catalog.unique_tags(spark, sf_dir)), "tag_count", 20), "tag_count").select("id", "n_tags", "place")


def _character_count(spark, sf_dir):
    tags = catalog.unique_tags(spark, sf_dir).where("category = 'character'")
    return paging.numbered(paging.page(paging.with_tag_count(filters.apply(library(spark, sf_dir), BUSY), tags), "tag_count", 20), "tag_count").select("id", "n_tags", "place")


_COUNTED = "SELECT id, coalesce(n, 0) AS n_tags, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, id DESC) AS BIGINT) AS place FROM items LEFT JOIN (SELECT item_id, count(DISTINCT tag) AS n FROM utags{which} GROUP BY 1) ON id = item_id WHERE {where} ORDER BY place LIMIT 20"


def _keyset(spark, sf_dir):
    """Pages one after the other, each from the last row's cursor: three of 40 rows."""
    frame, cursor, out = filters.apply(library(spark, sf_dir), BUSY), None, None
    for k in range(3):
        rows = paging.keyset_page(frame, "newest", 40, cursor).select("id", paging.sort_key("newest").alias("key"))
        last = rows.orderBy("key", "id").first()
        cursor = paging.encode_cursor(last["id"], last["key"]) if last else cursor
        out = rows.select("id", F.lit(k).alias("page")) if out is None else out.unionByName(rows.select("id", F.lit(k).alias("page")))
    return out


def queries():
    out = {name: _case(name) for name in CASES} | {f"o01_sort_{s}": _sorted(s) for s in SORTS}
    return out | {
        "flagship_page": _tag_count,
        "a38_filtered_count": lambda spark, sf: filters.count(library(spark, sf), BUSY),
        "o03_character_count_sort": _character_count,
        "o06_keyset_pages": _keyset,
        "o08_offset_page": lambda spark, sf: paging.page(filters.apply(library(spark, sf), BUSY), "newest", 30, 60).select("id"),
        "s33_selection_token": lambda spark, sf: filters.apply(library(spark, sf), paging.decode_selection(paging.encode_selection(BUSY))).select("id"),
        "f38_search_language": lambda spark, sf: filters.apply(library(spark, sf), paging.parse_search('generator:O tag:brand_N1 -rating:5-LOW width>=640 stars:2..4 "look3"')).select("id"),
        "s03_multi_get": lambda spark, sf: catalog.items(spark, sf).join(catalog.table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id")), "id", "left_semi").select("id", "path", "width"),
        "f39_already_tagged": lambda spark, sf: catalog.items(spark, sf).where("tagged_at IS NOT NULL").select("id"),
        "s07_untagged_ids": lambda spark, sf: catalog.items(spark, sf).where("tagged_at IS NULL").select("id"),
        "f42_unscored_count": lambda spark, sf: catalog.items(spark, sf).agg(F.count_if(F.col("aesthetic_score").isNull()).alias("n")),
    }


def oracle_sql():
    out = {name: f"SELECT id FROM items WHERE {where}" for name, (_, where) in CASES.items()}
    out |= {f"o01_sort_{s}": _NUMBERED.format(order=o, where=BUSY_SQL, limit=50, offset="") for s, o in SORTS.items()}
    out |= {
        "flagship_page": _COUNTED.format(which="", where=BUSY_SQL),
        "a38_filtered_count": f"SELECT count(*) AS total FROM items WHERE {BUSY_SQL}",
        "o03_character_count_sort": _COUNTED.format(which=" WHERE category = 'character'", where=BUSY_SQL),
        "o06_keyset_pages": f"SELECT id, CAST(floor((n - 1) / 40) AS INTEGER) AS page FROM (SELECT id, row_number() OVER (ORDER BY {SORTS['newest']}) AS n FROM items WHERE {BUSY_SQL}) WHERE n <= 120",
        "o08_offset_page": f"SELECT id FROM items WHERE {BUSY_SQL} ORDER BY {SORTS['newest']} LIMIT 30 OFFSET 60",
        "s33_selection_token": f"SELECT id FROM items WHERE {BUSY_SQL}",
        "f38_search_language": f"SELECT id FROM items WHERE generator = 'O' AND id IN (SELECT item_id FROM utags WHERE tag = 'brand_N1') AND (ai_rating IS NULL OR ai_rating <> '5-LOW') AND width >= 640 AND user_rating BETWEEN 2 AND 4 AND (contains(lower(filename), 'look3') OR contains(lower(checkpoint), 'look3') OR len(list_filter({TOKENS}, lambda t: contains(t, 'look3'))) > 0)",
        "s03_multi_get": "SELECT id, path, width FROM items WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
        "f39_already_tagged": "SELECT id FROM items WHERE tagged_at IS NOT NULL",
        "s07_untagged_ids": "SELECT id FROM items WHERE tagged_at IS NULL",
        "f42_unscored_count": "SELECT count(*) FILTER (aesthetic_score IS NULL) AS n FROM items",
    }
    return {k: catalog.with_frames(v) for k, v in out.items()}
