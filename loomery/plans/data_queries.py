"""Text, colours, vectors, dataset reports, bulk changes and event counts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import colors, text
from loomery.operators import datasets, facets, mutate, neighbours, vectors
from loomery.streaming import activity

from . import catalog

C, I, T, ALL = catalog.table, catalog.items, catalog.unique_tags, catalog.tags
TERMS = ["the of", "license", "einer", "ouch"]
SIZES = datasets.buckets()
#: Tags and the family that they belong to.
TRAITS = (
    ("long_hair", "hair"), ("wet hair", None), ("Ponytail", "hair"), ("blue eyes", "eyes"), ("closed_eyes", None), ("slit_pupils", "eyes"), ("tareme", "eyes"), ("pale skin", "skin"),
    ("shiny_skin", None), ("tan", "skin"), ("cat ears", "body"), ("mole_under_eye", "body"), ("scar on face", "body"), ("wings", "body"), ("freckles", "body"), ("smile", None), ("", None),
)
#: Captions that have each problem, in SQL of both engines.
CAPTION = "CASE id % 8 WHEN 0 THEN 'look3, general, Explicit' WHEN 1 THEN '(look3, cut' WHEN 2 THEN 'look3' || chr(10) || 'more' WHEN 3 THEN 'look3, [a' WHEN 4 THEN 'general, general, look3' ELSE prompt END"
_RATED = "len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(c), '[,\\n]'), lambda w: trim(w)), lambda w: list_contains(['general', 'sensitive', 'questionable', 'explicit'], w))))"
_UNEVEN = "length(replace(c, '{}', '')) <> length(replace(c, '{}', ''))"
_VALIDATION = f"SELECT code, count(*) AS n, array_to_string((list(id ORDER BY id))[1:3], ',') AS examples FROM (SELECT id, unnest(list_filter([CASE WHEN trim(c) = '' THEN 'empty' END, CASE WHEN contains(trim(c), chr(10)) THEN 'multiline' END, CASE WHEN NOT contains(lower(c), 'look3') THEN 'missing_trigger' END, CASE WHEN {_RATED} > 1 THEN 'conflicting_rating' END, CASE WHEN {_UNEVEN.format('(', ')')} OR {_UNEVEN.format('[', ']')} THEN 'unpaired' END], lambda x: x IS NOT NULL)) AS code FROM (SELECT id, coalesce({CAPTION}, '') AS c FROM items)) GROUP BY 1"


def _hex(spark, sf):
    return C(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))).alias("c"))


def _near(spark, sf):
    """Neighbours of the vector of the least id."""
    rows = C(spark, sf, "embeddings")
    query = rows.where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()["embedding"]
    return vectors.nearest(rows, query, 0.1, 20)


def _cosines(spark, sf):
    """Of every vector: the cosine with the vector of the least id."""
    rows = C(spark, sf, "embeddings")
    query = rows.where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()["embedding"]
    return rows.select("vec_id", F.round(vectors.cosine_to(query), 6).alias("similarity"))


def _words(c="text"):
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^a-z]+"), lambda w: w != "")


def _edges(spark, sf):
    """Tag implications: brand_X1 to brand_X2 to brand_X3."""
    out = [(f"brand_{x}{k}", f"brand_{x}{k + 1}") for x in "ANR" for k in (1, 2)]
    return spark.createDataFrame(out, "child string, parent string")


def _name(spark, sf, f):
    return C(spark, sf, "part").select("p_partkey", f(F.col("p_name")).alias("x"))


def _hashes(spark, sf):
    return C(spark, sf, "part").select((F.col("p_partkey") * 2654435761 % 4096).alias("h"))


def _undo(spark, sf):
    before = ALL(spark, sf)
    after = mutate.bulk_remove(before, ["brand_n1"])
    current = after.where("NOT (item_id % 5 = 0 AND pos = 1)")
    restored, _ = mutate.undo(current, before, after)
    return restored.select("item_id", "tag", "pos")


QUERIES = {
    "x01_normalize_token": lambda s, d: T(s, d).select("tag").distinct().select("tag", text.normalize_token(F.col("tag")).alias("x")),
    "x02_prompt_tokens": lambda s, d: I(s, d).select("id", F.array_join(text.prompt_tokens(F.col("prompt")), "|").alias("x")),
    "x04_lora_names": lambda s, d: I(s, d).select("id", F.array_join(text.lora_names(F.col("prompt")), "|").alias("x")),
    "x05_checkpoint_name": lambda s, d: _name(s, d, lambda c: text.checkpoint_name(F.concat(F.lit("models/sd\\"), c, F.lit(".safetensors  [a1b2]")))),
    "x06_path_key": lambda s, d: _name(s, d, lambda c: text.path_key(F.concat(F.lit("D:\\pics\\\\"), c, F.lit("\\")))),
    "x09_trait_family": lambda s, d: C(s, d, "part").select("p_partkey", F.element_at(F.array(*(F.lit(t) for t, _ in TRAITS)), (F.col("p_partkey") % len(TRAITS) + 1).cast("int")).alias("tag")).select("p_partkey", text.trait_family(F.col("tag")).alias("x")),
    "x10_hue_names": lambda s, d: _hex(s, d).select("p_partkey", colors.hue_name(F.col("c")).alias("x")),
    "x12_temperature": lambda s, d: I(s, d).select("id", colors.temperature(F.col("brightness"), F.col("saturation")).alias("x")),
    "x14_circular_mean": lambda s, d: I(s, d).where("color_temperature IS NOT NULL AND brightness IS NOT NULL").groupBy("color_temperature").agg(F.round(colors.circular_mean(F.col("brightness") * 0.5), 4).alias("x")),
    "x20_parameters": lambda s, d: I(s, d).select("id", F.concat(F.lit("a cat\nSteps: 20, Sampler: \"Euler, a\", Seed: "), F.col("id").cast("string"), F.lit(", CFG scale: 7")).alias("p")).select("id", text.parameter(F.col("p"), "Seed").alias("seed"), text.parameter(F.col("p"), "Sampler").alias("sampler"), text.parameter(F.col("p"), "Size").alias("size")),
    "x28_tag_pipeline": lambda s, d: T(s, d).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "tag"))).alias("t")).select("item_id", F.array_join(text.processed_tags(F.transform("t", lambda e: e["tag"]), ["brand n1"], {"brand_n2": "renamed"}, 3, ["extra"]), "|").alias("x")),
    "x29_underscores": lambda s, d: T(s, d).select("tag").distinct().unionByName(s.createDataFrame([(t,) for t in ("^_^", "score_9_up", "o_o", "long_hair", ">_<")], "tag string")).select("tag", text.underscored(F.col("tag")).alias("x")),
    "x31_captions": lambda s, d: I(s, d).select("id", text.caption("trig", text.prompt_tokens(F.col("prompt")), F.col("nl_caption")).alias("x")),
    "x33_quality_words": lambda s, d: I(s, d).select("id", text.quality_word(F.col("aesthetic_score")).alias("x")),
    "x39_leaks": lambda s, d: datasets.leaks(C(s, d, "documents"), TERMS),
    "x44_buckets": lambda s, d: datasets.bucket_plan(I(s, d), SIZES),
    "x55_one_line": lambda s, d: C(s, d, "documents").select("doc_id", F.md5(text.one_line(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E]+", " "))).alias("x")),
    "x63_slugs": lambda s, d: _name(s, d, text.slug),
    "x18_hash_links": lambda s, d: neighbours.hash_pairs(_hashes(s, d), 2),
    "x15_pair_cosine": _cosines,
    "j14_nearest": _near,
    "a23_vocabulary": lambda s, d: datasets.vocabulary(C(s, d, "documents"), _words()),
    "a24_traits": lambda s, d: datasets.trait_candidates(T(s, d), 0.05),
    "a25_spellings": lambda s, d: datasets.spelling_variants(T(s, d)).select("folded", "spellings", "n", F.lower("first").alias("first")),
    "a26_audit": lambda s, d: datasets.flags(I(s, d), ALL(s, d).withColumn("item_id", F.col("item_id") + F.col("item_id") % 2), 1.5, 640),
    "a45_validation": lambda s, d: datasets.validation(I(s, d).selectExpr("id", f"{CAPTION} AS caption"), "caption", "look3"),
    "j16_co_occurrence": lambda s, d: datasets.co_occurrence(T(s, d), 0.02),
    "x37_implications": lambda s, d: datasets.without_implied(T(s, d), datasets.closure(_edges(s, d))).select("item_id", "tag"),
    "s25_manifest": lambda s, d: datasets.manifest(I(s, d)),
    "s26_verify": lambda s, d: datasets.verify(I(s, d).where("id % 3 > 0").select(F.col("id").cast("string").alias("path"), F.col("file_size").alias("size")), I(s, d).where("id % 5 > 0").select(F.col("id").cast("string").alias("path"), (F.col("file_size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("size"))),
    "b01_find_replace": lambda s, d: mutate.find_replace(ALL(s, d), "brand_([AN])1", "found_$1", "regex").select("item_id", F.lower("tag").alias("tag"), F.round("confidence", 6).alias("confidence")),
    "b02_bulk_add": lambda s, d: mutate.bulk_add(ALL(s, d), I(s, d).where("width > 1000"), ["BRAND_N1", "fresh"]).select("item_id", "tag", "source"),
    "b03_bulk_remove": lambda s, d: mutate.bulk_remove(ALL(s, d), ["BRAND_N1", "brand_a2"]).select("item_id", "tag", "pos"),
    "b04_cleanup": lambda s, d: mutate.cleanup(ALL(s, d), 0.95).groupBy("item_id").agg(F.count("*").alias("n")),
    "b05_undo": _undo,
    "b06_destinations": lambda s, d: I(s, d).select("id", mutate.destination("/out/", F.when(F.col("id") % 3 == 0, F.concat(F.lit(" a/b:"), F.col("generator"))).when(F.col("id") % 3 == 1, F.lit("  ")).otherwise(F.col("generator"))).alias("x")),
    "s28_upsert": lambda s, d: mutate.upsert(I(s, d).where("id % 3 > 0").select("id", "prompt", "width"), I(s, d).where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.lit("new")).alias("prompt"), (F.col("width") + 1).alias("width")), "id", ("prompt",)),
    "b07_invalidated": lambda s, d: mutate.invalidated(I(s, d).select(F.col("id").cast("string").alias("path"), F.col("file_size").alias("size"), "ai_caption", "aesthetic_score"), I(s, d).where("id % 2 = 0").select(F.col("id").cast("string").alias("path"), (F.col("file_size") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("size")), ("ai_caption", "aesthetic_score")).select("path", "changed", "ai_caption", F.round("aesthetic_score", 6).alias("aesthetic_score")),
    "s31_delete": lambda s, d: ALL(s, d).join(I(s, d).where("width > 1200").select(F.col("id").alias("item_id")), "item_id", "left_anti").select("item_id", "tag", "pos"),
    "t06_daily_counts": lambda s, d: activity.daily_counts(C(s, d, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd")),
    "t06_sliding_counts": lambda s, d: activity.sliding_counts(C(s, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
    "t06_sessions": lambda s, d: activity.sessions(C(s, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"),
}

_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))"
_NEAR = f"SELECT vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) q WHERE {_COS.format(a='e.embedding', b='q.embedding')} >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 20"
_HSV = "WITH c AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS c FROM part), r AS (SELECT p_partkey, c // 65536 AS r, c // 256 % 256 AS g, c % 256 AS b FROM c), m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM r), h AS (SELECT p_partkey, t / 2.55 AS v, CASE WHEN t = 0 THEN 0 ELSE 100.0 * d / t END AS s, CASE WHEN d = 0 THEN 0 WHEN t = r THEN 60 * (g - b) / d WHEN t = g THEN 60 * (b - r) / d + 120 ELSE 60 * (r - g) / d + 240 END AS h0 FROM m), k AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM h)"
_OPTION = ", ".join(f"{{'d': abs(width * {h} - height * {w}) / CAST({h} AS DOUBLE), 'k': {k}, 'w': {w}, 'h': {h}}}" for k, (w, h) in enumerate(SIZES))
_LEAK = "contains(' ' || regexp_replace(replace(lower(text), '_', ' '), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' ' || term || ' ')"


def queries():
    return QUERIES


def oracle_sql():
    from .filter_queries import LORAS, ORDERED

    same = lambda k: f"WHERE lower(tag) {k}"
    out = {
        "x01_normalize_token": "SELECT DISTINCT tag, trim(replace(lower(tag), '_', ' ')) AS x FROM utags",
        "x02_prompt_tokens": f"SELECT id, array_to_string({ORDERED}, '|') AS x FROM items",
        "x04_lora_names": f"SELECT id, coalesce(array_to_string({LORAS}, '|'), '') AS x FROM items",
        "x05_checkpoint_name": "SELECT p_partkey, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS x FROM part",
        "x06_path_key": "SELECT p_partkey, regexp_replace('/mnt/d/pics/' || p_name, '/$', '') AS x FROM part",
        "x09_trait_family": f"SELECT p_partkey, CASE p_partkey % {len(TRAITS)} {' '.join(f"WHEN {k} THEN '{f}'" for k, (_, f) in enumerate(TRAITS) if f)} END AS x FROM part",
        "x10_hue_names": f"{_HSV} SELECT p_partkey, CASE WHEN v < 14 THEN 'black' WHEN s < 10 AND v > 82 THEN 'white' WHEN s < 10 THEN 'gray' WHEN h >= 15 AND h <= 45 AND s <= 45 AND v > 72 THEN NULL WHEN h >= 15 AND h <= 50 AND v <= 62 THEN 'brown' WHEN (h >= 340 OR h < 15) AND s <= 45 AND v > 75 THEN 'pink' WHEN h >= 315 AND h < 340 THEN 'pink' WHEN h >= 340 OR h < 15 THEN 'red' WHEN h < 42 THEN 'orange' WHEN h < 68 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 195 THEN 'cyan' WHEN h < 255 THEN 'blue' ELSE 'purple' END AS x FROM k",
        "x12_temperature": "SELECT id, CASE WHEN brightness IS NULL OR saturation IS NULL THEN NULL WHEN saturation < 30 THEN 'neutral' WHEN brightness < 43 OR brightness >= 213 THEN 'warm' WHEN brightness >= 85 THEN 'cool' ELSE 'neutral' END AS x FROM items",
        "x14_circular_mean": "SELECT color_temperature, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 4) AS x FROM (SELECT color_temperature, degrees(atan2(avg(sin(radians(brightness * 0.5))), avg(cos(radians(brightness * 0.5))))) AS m FROM items WHERE color_temperature IS NOT NULL AND brightness IS NOT NULL GROUP BY 1)",
        "x20_parameters": "SELECT id, CAST(id AS VARCHAR) AS seed, 'Euler, a' AS sampler, CAST(NULL AS VARCHAR) AS size FROM items",
        "x28_tag_pipeline": "SELECT item_id, CASE WHEN len(t) = 0 THEN 'extra' ELSE array_to_string(list_append(t[1:3], 'extra'), '|') END AS x FROM (SELECT item_id, list_transform(list_filter(list(tag ORDER BY confidence DESC, tag), lambda t: lower(t) <> 'brand_n1'), lambda t: CASE WHEN lower(t) = 'brand_n2' THEN 'renamed' ELSE t END) AS t0, list_filter(t0, lambda x, i: list_position(t0, x) = i) AS t FROM utags GROUP BY 1)",
        "x29_underscores": "SELECT DISTINCT tag, replace(tag, '_', ' ') AS x FROM utags UNION ALL SELECT * FROM (VALUES ('^_^', '^_^'), ('score_9_up', 'score_9_up'), ('o_o', 'o_o'), ('long_hair', 'long hair'), ('>_<', '>_<'))",
        "x31_captions": f"SELECT id, array_to_string(list_prepend('trig', {ORDERED}), ', ') || CASE WHEN nl_caption IS NULL THEN '' ELSE '. ' || nl_caption END AS x FROM items",
        "x33_quality_words": "SELECT id, CASE WHEN aesthetic_score IS NULL THEN NULL WHEN aesthetic_score >= 7 THEN 'masterpiece, best quality' WHEN aesthetic_score >= 6 THEN 'best quality' WHEN aesthetic_score >= 5 THEN 'good quality' WHEN aesthetic_score >= 4 THEN '' WHEN aesthetic_score >= 3 THEN 'low quality' ELSE 'worst quality' END AS x FROM items",
        "x39_leaks": f"SELECT doc_id, term FROM documents, (SELECT unnest({TERMS}) AS term) WHERE {_LEAK}",
        "x44_buckets": f"SELECT id, CAST(b.w AS INTEGER) AS bucket_width, CAST(b.h AS INTEGER) AS bucket_height FROM (SELECT id, list_min([{_OPTION}]) AS b FROM items)",
        "x55_one_line": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS x FROM documents",
        "x63_slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM part",
        "x18_hash_links": "WITH h AS (SELECT DISTINCT p_partkey * 2654435761 % 4096 AS h FROM part) SELECT x.h AS a, y.h AS b FROM h x, h y WHERE x.h < y.h AND bit_count(xor(x.h, y.h)) <= 2",
        "x15_pair_cosine": f"SELECT vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) q",
        "j14_nearest": _NEAR,
            "a23_vocabulary": "SELECT token, count(*) AS n, min(doc_id) AS sample FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> ''))) AS token FROM documents) GROUP BY 1",
        "a24_traits": "SELECT tag, n, round(n / total, 6) AS share FROM (SELECT tag, count(DISTINCT item_id) AS n FROM utags GROUP BY 1), (SELECT count(DISTINCT item_id) AS total FROM utags) WHERE n >= greatest(1, floor(0.05 * total + 0.5))",
        "a25_spellings": "SELECT replace(lower(tag), '_', ' ') AS folded, count(DISTINCT tag) AS spellings, count(*) AS n, lower(min(tag)) AS first FROM utags GROUP BY 1 HAVING count(DISTINCT tag) > 1",
        "a26_audit": "SELECT id, flags FROM (SELECT id, concat_ws(',', CASE WHEN aesthetic_score < 1.5 THEN 'low_quality' END, CASE WHEN id NOT IN (SELECT item_id + item_id % 2 FROM tags) THEN 'untagged' END, CASE WHEN width < 640 OR height < 640 THEN 'small' END, CASE WHEN coalesce(is_readable, 1) = 0 THEN 'unreadable' END) AS flags FROM items) WHERE flags <> ''",
        "a45_validation": _VALIDATION,
        "j16_co_occurrence": "WITH c AS (SELECT tag, count(DISTINCT item_id) AS n FROM utags GROUP BY 1 HAVING n >= 3 ORDER BY n DESC, tag LIMIT 150), z AS (SELECT * FROM utags SEMI JOIN c USING (tag)), p AS (SELECT x.tag AS a, y.tag AS b, count(*) AS ab FROM z x JOIN z y ON x.item_id = y.item_id AND x.tag < y.tag GROUP BY 1, 2) SELECT a, b, ab, round(ab / (ca.n + cb.n - ab), 6) AS jaccard FROM p JOIN c ca ON a = ca.tag JOIN c cb ON b = cb.tag WHERE round(ab / (ca.n + cb.n - ab), 6) >= 0.02",
        "x37_implications": "SELECT u.item_id, u.tag FROM utags u WHERE NOT EXISTS (SELECT 1 FROM utags v WHERE v.item_id = u.item_id AND regexp_matches(v.tag, '^brand_[ANR][12]$') AND regexp_matches(u.tag, '^brand_[ANR][23]$') AND v.tag[7] = u.tag[7] AND v.tag[8] < u.tag[8])",
        "s25_manifest": "SELECT count(*) AS n, count(*) FILTER (trim(coalesce(prompt, '')) = '') AS empty, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) AS digest FROM (SELECT *, md5(concat_ws('|', CAST(id AS VARCHAR), path, CAST(file_size AS VARCHAR))) AS h FROM items)",
        "b05_undo": "SELECT item_id, tag, pos FROM tags WHERE item_id IN (SELECT a.item_id FROM (SELECT item_id, list_sort(list_distinct(list(lower(tag)))) AS n FROM tags GROUP BY 1) z JOIN (SELECT item_id, list_sort(list_distinct(list(lower(tag)) FILTER (lower(tag) <> 'brand_n1'))) AS n, list_sort(list_distinct(list(lower(tag)) FILTER (lower(tag) <> 'brand_n1' AND NOT (item_id % 5 = 0 AND pos = 1)))) AS m FROM tags GROUP BY 1) a USING (item_id) WHERE a.n IS NOT DISTINCT FROM a.m) UNION ALL SELECT item_id, tag, pos FROM tags WHERE lower(tag) <> 'brand_n1' AND NOT (item_id % 5 = 0 AND pos = 1) AND item_id NOT IN (SELECT a.item_id FROM (SELECT item_id, list_sort(list_distinct(list(lower(tag)) FILTER (lower(tag) <> 'brand_n1'))) AS n, list_sort(list_distinct(list(lower(tag)) FILTER (lower(tag) <> 'brand_n1' AND NOT (item_id % 5 = 0 AND pos = 1)))) AS m FROM tags GROUP BY 1) a WHERE a.n IS NOT DISTINCT FROM a.m)",
            "s26_verify": "SELECT CAST(id AS VARCHAR) AS path, CASE WHEN id % 3 > 0 THEN file_size END AS expected, CASE WHEN id % 5 > 0 THEN file_size + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END END AS observed, CASE WHEN id % 5 = 0 THEN 'missing' WHEN id % 3 = 0 THEN 'unexpected' ELSE 'size' END AS code FROM items WHERE (id % 3 > 0 OR id % 5 > 0) AND NOT (id % 3 > 0 AND id % 5 > 0 AND id % 7 > 0)",
        "b01_find_replace": "SELECT item_id, tag, round(max(confidence), 6) AS confidence FROM (SELECT item_id, confidence, lower(regexp_replace(tag, '^brand_([AN])1$', 'found_\\1')) AS tag FROM tags) GROUP BY 1, 2",
        "b02_bulk_add": "SELECT item_id, tag, source FROM tags UNION ALL SELECT id, n, 'manual' FROM items, (SELECT unnest(['BRAND_N1', 'fresh']) AS n) WHERE width > 1000 AND (id, lower(n)) NOT IN (SELECT item_id, lower(tag) FROM tags)",
        "b03_bulk_remove": f"SELECT item_id, tag, pos FROM tags {same('NOT IN')} ('brand_n1', 'brand_a2')",
        "b04_cleanup": "SELECT item_id, count(DISTINCT lower(tag)) AS n FROM tags WHERE confidence >= 0.95 OR source = 'manual' GROUP BY 1",
        "b06_destinations": "SELECT id, '/out/' || CASE id % 3 WHEN 0 THEN coalesce('a_b_' || generator, 'unknown') WHEN 1 THEN 'unknown' ELSE coalesce(generator, 'unknown') END AS x FROM items",
        "s28_upsert": "SELECT id, CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 3 > 0 THEN prompt END AS prompt, CASE WHEN id % 2 = 0 THEN width + 1 ELSE width END AS width, CASE WHEN id % 2 = 1 THEN 'kept' WHEN id % 3 = 0 THEN 'new' ELSE 'updated' END AS state FROM items WHERE id % 3 > 0 OR id % 2 = 0",
        "b07_invalidated": "SELECT CAST(id AS VARCHAR) AS path, id % 6 = 0 AS changed, CASE WHEN id % 6 > 0 THEN ai_caption END AS ai_caption, CASE WHEN id % 6 > 0 THEN round(aesthetic_score, 6) END AS aesthetic_score FROM items",
        "s31_delete": "SELECT item_id, tag, pos FROM tags WHERE item_id NOT IN (SELECT id FROM items WHERE width > 1200)",
        "t06_daily_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "t06_sliding_counts": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 2 HOURS, ts) - to_hours(2 * k) AS s FROM events, range(3) r(k)) GROUP BY 1, 2",
        "t06_sessions": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s",
    }
    return {k: catalog.with_frames(v) if not v.startswith("WITH") else (f"WITH {catalog.TAGS_SQL}, {v[5:]}" if "utags" in v else v) for k, v in out.items()}
