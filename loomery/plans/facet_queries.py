"""Facets, windows, set operations and score analytics as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import facets, library, scores

from . import catalog

C, I, T, S = catalog.table, catalog.items, catalog.unique_tags, catalog.scores
ALL = catalog.tags
#: Paths some of which are variants of others, in SQL of both engines.
VARIANT = "'/lib/' || CAST(id % 9 AS STRING) || '/Img_' || CAST(id % 997 AS STRING) || CASE WHEN id % 4 = 3 THEN '_censored' ELSE '' END || '.png'"
SEVERITY = ["brand_N9", "Brand_N9", "brand_R9", "brand_A9"]


def _days(spark, sf):
    return C(spark, sf, "events").select(F.col("event_type").alias("key"), F.to_date("ts").alias("day"))


def _model_tags(spark, sf):
    return scores.rethreshold(S(spark, sf), 0.35, 0.85, 0.6, keys=("item_id", "model"))


def _favourites(spark, sf):
    """Items of a path that is a favourite as it stands, or else without regard to case."""
    items = I(spark, sf)
    liked = items.where("user_rating = 5").select(F.col("path").alias("liked"))
    exact = items.join(liked, items["path"] == liked["liked"], "left_semi").select("id")
    folded = items.join(liked, F.lower("path") == F.lower("liked"), "left_semi").select("id")
    return exact.unionByName(folded).distinct()


QUERIES = {
    "a01_tag_frequency": lambda s, d: facets.frequency(T(s, d), F.col("tag"), "tag"),
    "a02_tag_search": lambda s, d: facets.search_facet(T(s, d), "tag", "n1", 20),
    "a03_token_facet": lambda s, d: facets.frequency(I(s, d).select(F.explode(text.prompt_tokens(F.col("prompt"))).alias("token")), F.col("token"), "token"),
    "a03_lora_facet": lambda s, d: facets.frequency(I(s, d).select(F.explode(text.lora_names(F.col("prompt"))).alias("lora")), F.col("lora"), "lora"),
    "a04_generator_facet": lambda s, d: facets.frequency(I(s, d).where("coalesce(is_readable, 1) = 1"), F.coalesce("generator", F.lit("unknown")), "generator"),
    "a05_checkpoint_facet": lambda s, d: facets.frequency(I(s, d), text.checkpoint_name(F.col("checkpoint")), "checkpoint"),
    "a06_status_counts": lambda s, d: facets.frequency(I(s, d), F.lower(F.coalesce("metadata_status", F.lit("complete"))), "status"),
    "a07_health": lambda s, d: facets.health(I(s, d)),
    "a08_duplicate_names": lambda s, d: facets.duplicate_names(I(s, d)),
    "a09_folders": lambda s, d: facets.folders(I(s, d)),
    "s16_directories": lambda s, d: I(s, d).where("coalesce(is_readable, 1) = 1").select(text.folder_of(F.col("path")).alias("folder")).distinct(),
    "a10_case_dedupe": lambda s, d: facets.deduped(ALL(s, d)).select("item_id", F.lower("tag").alias("tag"), F.round("confidence", 6).alias("confidence")),
    "a11_verdict": lambda s, d: facets.verdict(ALL(s, d), SEVERITY),
    "a12_model_coverage": lambda s, d: scores.coverage(S(s, d)),
    "a13_score_distribution": lambda s, d: scores.distribution(S(s, d), "tag_N3"),
    "a14_score_storage": lambda s, d: scores.storage(S(s, d)),
    "a15_analytics": lambda s, d: facets.frequency(T(s, d), F.col("tag"), "value", 10).withColumn("facet", F.lit("tag")).unionByName(facets.frequency(I(s, d), F.col("checkpoint"), "value", 10).withColumn("facet", F.lit("checkpoint"))),
    "a17_checkpoint_leaders": lambda s, d: I(s, d).where("checkpoint IS NOT NULL AND aesthetic_score IS NOT NULL").groupBy("checkpoint").agg(F.count("*").alias("n"), F.round(F.avg(F.col("aesthetic_score").cast("decimal(20,8)")), 4).cast("double").alias("mean")).where("n >= 3"),
    "a17_recipes": lambda s, d: facets.top_per_group(I(s, d).where("checkpoint IS NOT NULL").join(T(s, d), F.col("id") == F.col("item_id")), "checkpoint", "tag", 3),
    "a17_prompt_length": lambda s, d: I(s, d).where("prompt IS NOT NULL").agg(F.round(F.avg(F.char_length("prompt")), 6).alias("mean"), F.max(F.char_length("prompt")).cast("long").alias("longest"), F.min(F.char_length("prompt")).cast("long").alias("shortest")),
    "a18_compare_items": lambda s, d: facets.compare_sets(T(s, d), 1, 3),
    "a20_coverage": lambda s, d: C(s, d, "embeddings").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), facets.percent(F.count("embedding"), F.count("*")).alias("percent")),
    "a21_streaks": lambda s, d: facets.streaks(_days(s, d)).withColumn("first_day", F.col("first_day").cast("string")).withColumn("last_day", F.col("last_day").cast("string")),
    "a22_activity": lambda s, d: _days(s, d).groupBy(F.col("day").cast("string").alias("day"), "key").agg(F.count("*").alias("n")),
    "a36_favourites": lambda s, d: _favourites(s, d).agg(F.count("*").alias("n")),
    "a39_health_by_generator": lambda s, d: I(s, d).groupBy(F.coalesce("generator", F.lit("unknown")).alias("generator")).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("prompt", F.lit(""))) == "").alias("no_prompt")),
    "j07_collection_counts": lambda s, d: C(s, d, "nation").join(C(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n")),
    "j09_favourites_union": _favourites,
    "j11_gaps": lambda s, d: scores.gaps(S(s, d), ALL(s, d), "tag_N3", 0.3, 0.8),
    "j20_artist_page": lambda s, d: I(s, d).join(T(s, d).where("tag = 'brand_A4'"), F.col("id") == F.col("item_id")).orderBy(F.desc("confidence"), F.desc("created_at"), "id").limit(25).select("id", F.round("confidence", 6).alias("confidence")),
    "j23_variant_pairs": lambda s, d: library.variant_pairs(I(s, d).selectExpr("id", f"{VARIANT} AS path"), "_censored").select("id", "other"),
    "s05_tag_lists": lambda s, d: facets.child_lists(T(s, d)),
    "s21_tag_export": lambda s, d: facets.child_lists(T(s, d)).join(I(s, d).where("tagged_at IS NOT NULL"), F.col("item_id") == F.col("id")).select("id", "path", "tags"),
    "w03_trimmed": lambda s, d: facets.trimmed(ALL(s, d), ["brand_n1"], 2).select("item_id", "tag", "pos"),
    "w05_collisions": lambda s, d: facets.collision_suffixes(I(s, d).select("id", "filename"), "filename").select("id", "name"),
    "w07_heads": lambda s, d: facets.newest(C(s, d, "conversations"), "conv_id", [F.desc("turn"), "role"], 1).select("conv_id", "turn", "role"),
    "w08_newest": lambda s, d: facets.newest(C(s, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 5).select("event_type", "event_id"),
    "w09_daily_pick": lambda s, d: facets.daily_pick(I(s, d), "2024-05-01", 3),
    "u02_union": lambda s, d: I(s, d).where("width > 1500").select("id").union(I(s, d).where("height > 1200").select("id")).distinct(),
    "u03_intersect": lambda s, d: I(s, d).where("width > 1000").select("id").intersect(I(s, d).where("height > 1000").select("id")),
    "u03_difference": lambda s, d: I(s, d).where("width > 1000").select("id").subtract(I(s, d).where("height > 1000").select("id")),
    "a28_consensus": lambda s, d: scores.consensus(_model_tags(s, d), {"model_O": 0.6, "model_F": 0.5}, 0.6),
    "a29_rethreshold": lambda s, d: scores.rethreshold(S(s, d), 0.35, 0.85, 0.6),
    "a30_rethreshold_diff": lambda s, d: scores.difference(scores.rethreshold(S(s, d), 0.35, 0.85, 0.6), scores.rethreshold(S(s, d), 0.5, 0.5, 0.5)),
    "s29_replace_scores": lambda s, d: scores.replace_slice(S(s, d), S(s, d).where("model = 'model_O' AND item_id % 5 = 0").withColumn("score", F.col("score") * 1.5)).select("item_id", "model", "tag", F.round("score", 6).alias("score")),
    "s35_item_scores": lambda s, d: S(s, d).where("model = 'model_O'").join(I(s, d).where("width > 1400"), F.col("item_id") == F.col("id"), "left_semi").select("item_id", "tag", "score"),
    "x45_probabilities": lambda s, d: S(s, d).select("item_id", "model", "tag", F.round(scores.normalized(F.col("score") * 3 - 0.5), 6).alias("p")),
}

_RETHRESHOLD = """(SELECT item_id{k}, tag, category, score FROM scores WHERE category <> 'rating' AND score >= CASE category WHEN 'character' THEN {c} WHEN 'copyright' THEN {r} ELSE {t} END
 UNION ALL SELECT item_id{k}, tag, category, score FROM scores WHERE category = 'rating' QUALIFY row_number() OVER (PARTITION BY item_id{k} ORDER BY score DESC, tag) = 1)"""


def _re(t, c, r, k=""):
    return _RETHRESHOLD.format(t=t, c=c, r=r, k=k)


_BLANK = "trim(coalesce({}, '')) = ''"
_TOKENS = "FROM (SELECT unnest({}) AS {} FROM items)"
_FAV = "SELECT DISTINCT id FROM items WHERE lower(path) IN (SELECT lower(path) FROM items WHERE user_rating = 5)"


def oracle_sql():
    import zlib

    _duck_variant = VARIANT.replace("STRING", "VARCHAR")
    day = zlib.crc32(b"2024-05-01") + 3
    from .filter_queries import LORAS, TOKENS

    out = {
        "a01_tag_frequency": "SELECT tag, count(*) AS n FROM utags GROUP BY 1",
        "a02_tag_search": "SELECT tag, count(*) AS n, CASE WHEN lower(tag) = 'n1' THEN 0 WHEN starts_with(lower(tag), 'n1') THEN 1 WHEN regexp_matches(lower(tag), '[ _(\\[]n1') THEN 2 ELSE 3 END AS rank FROM utags WHERE contains(lower(tag), 'n1') GROUP BY tag ORDER BY rank, n DESC, lower(tag), tag LIMIT 20",
        "a03_token_facet": f"SELECT token, count(*) AS n {_TOKENS.format(TOKENS, 'token')} GROUP BY 1",
        "a03_lora_facet": f"SELECT lora, count(*) AS n {_TOKENS.format(f'list_distinct({LORAS})', 'lora')} GROUP BY 1",
        "a04_generator_facet": "SELECT coalesce(generator, 'unknown') AS generator, count(*) AS n FROM items WHERE coalesce(is_readable, 1) = 1 GROUP BY 1",
        "a05_checkpoint_facet": "SELECT checkpoint, count(*) AS n FROM items WHERE checkpoint IS NOT NULL GROUP BY 1",
        "a06_status_counts": "SELECT lower(coalesce(metadata_status, 'complete')) AS status, count(*) AS n FROM items GROUP BY 1",
        "a07_health": f"SELECT c.*, greatest(0.0, round(100 - least(90.0, (2.0 * unreadable + 2.0 * metadata_error + 1.4 * missing_prompt + 1.3 * missing_dimensions + 0.8 * missing_checkpoint + 0.6 * unknown_generator + 0.5 * readable_untagged + 0.5 * repeated_names)::DOUBLE / total * 22), 1)) AS quality FROM (SELECT count(*) AS total, count(*) FILTER (coalesce(is_readable, 1) = 0) AS unreadable, count(*) FILTER (tagged_at IS NULL) AS untagged, count(*) FILTER ({_BLANK.format('prompt')}) AS no_prompt, count(*) FILTER (generator IS NULL) AS no_generator, count(*) FILTER (aesthetic_score IS NULL) AS unscored, count(*) FILTER ({_BLANK.format('ai_caption')} AND {_BLANK.format('nl_caption')}) AS no_caption, count(*) FILTER (lower(coalesce(metadata_status, 'complete')) = 'pending') AS pending, count(*) FILTER (brightness IS NULL) AS no_colour, count(*) FILTER (lower(coalesce(metadata_status, 'complete')) = 'error') AS metadata_error, count(*) FILTER (coalesce(is_readable, 1) = 1 AND {_BLANK.format('prompt')}) AS missing_prompt, count(*) FILTER (coalesce(is_readable, 1) = 1 AND (width <= 0 OR height <= 0)) AS missing_dimensions, count(*) FILTER (coalesce(is_readable, 1) = 1 AND {_BLANK.format('checkpoint')}) AS missing_checkpoint, count(*) FILTER (coalesce(is_readable, 1) = 1 AND generator = 'unknown') AS unknown_generator, count(*) FILTER (coalesce(is_readable, 1) = 1 AND tagged_at IS NULL) AS readable_untagged, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM items GROUP BY lower(filename) HAVING count(*) > 1)) AS repeated_names FROM items) c",
        "a08_duplicate_names": "SELECT lower(filename) AS name, min(filename) AS filename, count(*) AS n FROM items GROUP BY 1 HAVING count(*) > 1",
        "a09_folders": f"SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n, CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS bytes, count(*) FILTER (tagged_at IS NULL) AS untagged, count(*) FILTER ({_BLANK.format('prompt')}) AS no_prompt FROM items GROUP BY 1",
        "s16_directories": "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM items WHERE coalesce(is_readable, 1) = 1",
        "a10_case_dedupe": "SELECT item_id, lower(tag) AS tag, round(max(confidence), 6) AS confidence FROM tags GROUP BY item_id, lower(tag)",
        "a11_verdict": "SELECT item_id, tag AS verdict FROM tags WHERE tag IN ('brand_N9', 'Brand_N9', 'brand_R9', 'brand_A9') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, list_position(['brand_N9', 'Brand_N9', 'brand_R9', 'brand_A9'], tag) DESC) = 1",
        "a12_model_coverage": "SELECT model, count(DISTINCT item_id) AS items FROM scores GROUP BY 1",
        "a13_score_distribution": "SELECT model, count(*) AS n, CAST(round(sum(CAST(score AS DECIMAL(20,8))) / count(*), 4) AS DOUBLE) AS mean, max(score) AS highest, min(score) AS lowest FROM scores WHERE tag = 'tag_N3' GROUP BY 1",
        "a14_score_storage": "SELECT count(*) AS rows, count(DISTINCT item_id) AS items, count(*) * 60 AS bytes FROM scores",
        "a15_analytics": "(SELECT tag AS value, count(*) AS n, 'tag' AS facet FROM utags GROUP BY 1 ORDER BY n DESC, value LIMIT 10) UNION ALL (SELECT checkpoint AS value, count(*) AS n, 'checkpoint' AS facet FROM items WHERE checkpoint IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10)",
        "a17_checkpoint_leaders": "SELECT checkpoint, count(*) AS n, CAST(round(sum(CAST(aesthetic_score AS DECIMAL(20,8))) / count(*), 4) AS DOUBLE) AS mean FROM items WHERE checkpoint IS NOT NULL AND aesthetic_score IS NOT NULL GROUP BY 1 HAVING count(*) >= 3",
        "a17_recipes": "SELECT checkpoint, tag, n, CAST(row_number() OVER (PARTITION BY checkpoint ORDER BY n DESC, tag) AS BIGINT) AS place FROM (SELECT checkpoint, tag, count(*) AS n FROM items JOIN utags ON id = item_id WHERE checkpoint IS NOT NULL GROUP BY 1, 2) QUALIFY place <= 3",
        "a17_prompt_length": "SELECT round(avg(length(prompt)), 6) AS mean, max(length(prompt)) AS longest, min(length(prompt)) AS shortest FROM items WHERE prompt IS NOT NULL",
        "a18_compare_items": "SELECT coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (n = 2), '') AS common, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (n = 1 AND least_id = 1), '') AS only_a, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (n = 1 AND least_id = 3), '') AS only_b FROM (SELECT tag, count(*) AS n, min(item_id) AS least_id FROM utags WHERE item_id IN (1, 3) GROUP BY 1)",
        "a20_coverage": "SELECT count(*) AS total, count(embedding) AS embedded, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count(embedding) / count(*), 2) END AS percent FROM embeddings",
        "a21_streaks": "SELECT key, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM (SELECT key, day, day - CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT event_type AS key, CAST(ts AS DATE) AS day FROM events)) GROUP BY key, island",
        "a22_activity": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2",
        "a36_favourites": f"SELECT count(*) AS n FROM ({_FAV})",
        "a39_health_by_generator": f"SELECT coalesce(generator, 'unknown') AS generator, count(*) AS n, count(*) FILTER ({_BLANK.format('prompt')}) AS no_prompt FROM items GROUP BY 1",
        "j07_collection_counts": "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
        "j09_favourites_union": _FAV,
        "j11_gaps": "SELECT item_id, score, model FROM scores WHERE tag = 'tag_N3' AND score >= 0.3 AND score < 0.8 AND item_id NOT IN (SELECT item_id FROM tags WHERE lower(tag) = 'tag_n3') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, model) = 1",
        "j20_artist_page": "SELECT id, round(confidence, 6) AS confidence FROM items JOIN utags ON id = item_id WHERE tag = 'brand_A4' ORDER BY utags.confidence DESC, created_at DESC, id LIMIT 25",
        "w09_daily_pick": f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS c FROM items) WHERE n = {day} % c",
        "j23_variant_pairs": f"SELECT a.id, b.id AS other FROM (SELECT id, {_duck_variant} AS path FROM items) a LEFT JOIN (SELECT id, {_duck_variant} AS path FROM items) b ON b.path = replace(a.path, '.png', '_censored.png') WHERE NOT contains(a.path, '_censored')",
        "s05_tag_lists": "SELECT item_id, string_agg(tag, '|' ORDER BY confidence DESC, tag) AS tags FROM utags GROUP BY 1",
        "s21_tag_export": "SELECT id, path, string_agg(tag, '|' ORDER BY confidence DESC, tag) AS tags FROM items JOIN utags ON id = item_id WHERE tagged_at IS NOT NULL GROUP BY 1, 2",
        "w03_trimmed": "SELECT item_id, tag, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id, category = 'rating' ORDER BY confidence DESC, tag, pos) AS k FROM tags WHERE lower(tag) <> 'brand_n1') WHERE category = 'rating' OR k <= 2",
        "w05_collisions": "SELECT id, CASE WHEN k = 0 THEN filename ELSE filename || '_' || k END AS name FROM (SELECT id, filename, row_number() OVER (PARTITION BY filename ORDER BY id) - 1 AS k FROM items)",
        "w07_heads": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1",
        "w08_newest": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5",
        "u02_union": "SELECT id FROM items WHERE width > 1500 UNION SELECT id FROM items WHERE height > 1200",
        "u03_intersect": "SELECT id FROM items WHERE width > 1000 INTERSECT SELECT id FROM items WHERE height > 1000",
        "u03_difference": "SELECT id FROM items WHERE width > 1000 EXCEPT SELECT id FROM items WHERE height > 1000",
        "a28_consensus": f"SELECT * FROM (SELECT item_id, lower(trim(tag)) AS tag, round(sum(CASE model WHEN 'model_O' THEN 0.6 WHEN 'model_F' THEN 0.5 ELSE 1 END)::DOUBLE, 6) AS weight, count(*) AS votes, round(max(score), 4) AS confidence, arg_min(category, (CASE model WHEN 'model_O' THEN 0 WHEN 'model_F' THEN 1 ELSE 2 END, model, list_position(['general', 'copyright', 'character'], category))) AS category FROM {_re(0.35, 0.85, 0.6, ', model')} WHERE category <> 'rating' GROUP BY 1, 2) WHERE weight >= 1 OR category IN ('character', 'copyright')",
        "a29_rethreshold": f"SELECT * FROM {_re(0.35, 0.85, 0.6)}",
        "a30_rethreshold_diff": f"SELECT item_id, CAST(sum(1 - o) AS BIGINT) AS added, CAST(sum(1 - n) AS BIGINT) AS removed FROM (SELECT item_id, tag, max(o) AS o, max(n) AS n FROM (SELECT item_id, lower(tag) AS tag, 1 AS o, 0 AS n FROM {_re(0.35, 0.85, 0.6)} UNION ALL SELECT item_id, lower(tag), 0, 1 FROM {_re(0.5, 0.5, 0.5)}) GROUP BY 1, 2) GROUP BY 1 HAVING sum(2 - o - n) > 0",
        "s29_replace_scores": "SELECT item_id, model, tag, round(score, 6) AS score FROM scores WHERE NOT (model = 'model_O' AND item_id % 5 = 0) UNION ALL SELECT item_id, model, tag, round(least(score * 1.5, 1.0), 6) FROM scores WHERE model = 'model_O' AND item_id % 5 = 0 AND score * 1.5 >= 0.1",
        "s35_item_scores": "SELECT item_id, tag, score FROM scores WHERE model = 'model_O' AND item_id IN (SELECT id FROM items WHERE width > 1400)",
        "x45_probabilities": "SELECT item_id, model, tag, round(CASE WHEN score * 3 - 0.5 BETWEEN 0 AND 1 THEN score * 3 - 0.5 ELSE 0 END, 6) AS p FROM scores",
    }
    return {k: catalog.with_frames(v) for k, v in out.items()}


def queries():
    return QUERIES
