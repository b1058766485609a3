"""Metadata records, captions, reviews, packages and writes as queries, each beside its SQL.

Where a rule reads text of many shapes, the items carry literal cases in turn (by id), and the SQL
states what each case must give.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomery.functions import captions, categories, records, text
from loomery.operators import datasets, library, mutate, paging, review, vectors
from loomery.operators.dealing import dealt
from loomery.sources import readers
from loomery.streaming import activity

from . import catalog
from .data_queries import _VALIDATION as VALIDATION_SQL
from .data_queries import CAPTION
from .filter_queries import SORTS
from .filter_queries import library as filtered

C, I, T, ALL = catalog.table, catalog.items, catalog.unique_tags, catalog.tags
#: Pictures whose pixels one task reads.
PICTURES = 5_000
KEY = b"review"

#: Chunks of a file, and generator, prompt, negative prompt, checkpoint and LoRAs that they hold.
_STEPS = "a cat {id} <lora:Soft:0.7>\nNegative prompt: blurry\nSteps: 20, Sampler: Euler, Seed: 7, Model: base_v1"
_GRAPH = {
    "1": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "sub/anima.safetensors"}}, "2": {"class_type": "LoraLoader", "inputs": {"model": ["1", 0], "lora_name": "Glow.safetensors"}},
    "3": {"class_type": "CLIPTextEncode", "inputs": {"text": "a fox {id}", "clip": ["2", 1]}}, "4": {"class_type": "CLIPTextEncode", "inputs": {"text": "bad [\"1\", 0]", "clip": ["2", 1]}},
    "5": {"class_type": "KSampler", "inputs": {"model": ["2", 0], "positive": ["3", 0], "negative": ["4", 0]}}, "6": {"class_type": "SaveImage", "inputs": {"images": ["5", 0]}},
}
_NOVEL = {
    "prompt": "girl {id}", "uc": "lowres", "steps": 28, "scale": 5.5, "ucPreset": 2, "width": 832, "height": 1216, "other": 1,
    "v4_prompt": {"character_prompts": [{"prompt": "red", "ucPrompt": "x", "center": {"x": 0.1}}, {"prompt": "blue", "uc": "y"}]},
}
CASES = (
    ({"parameters": _STEPS}, ("webui", "a cat {id} <lora:Soft:0.7>", "blurry", "base_v1", "soft")),
    ({"parameters": _STEPS + ", Version: f2.0.1v1.10.1"}, ("forge", "a cat {id} <lora:Soft:0.7>", "blurry", "base_v1", "soft")),
    ({"parameters": _STEPS, "Software": "sd-webui-reForge"}, ("reforge", "a cat {id} <lora:Soft:0.7>", "blurry", "base_v1", "soft")),
    ({"UserComment": json.dumps(_NOVEL)}, ("nai", "girl {id}", "lowres", None, "")),
    ({"Comment": json.dumps({"v4_prompt": {"caption": {"base_caption": "deep {id}"}}}), "Source": "NAI v4"}, ("nai", "deep {id}", None, "NAI v4", "")),
    ({"Comment": json.dumps({"prompt": "foo {id}", "negative_prompt": "bar", "base_model": "m.ckpt", "loras": ["A.pt"]})}, ("fooocus", "foo {id}", "bar", "m", "a")),
    ({"Description": "told {id}", "Software": "NovelAI"}, ("nai", "told {id}", None, None, "")),
    ({"prompt": json.dumps(_GRAPH)}, ("comfyui", "a fox {id}", 'bad ["1", 0]', "anima", "glow")),
    ({"workflow": "{}"}, ("comfyui", None, None, None, "")),
    ({"ImageDescription": _STEPS}, ("webui", "a cat {id} <lora:Soft:0.7>", "blurry", "base_v1", "soft")),
    ({"parameters": json.dumps({"sui_image_params": {"prompt": "swarm {id}", "negativeprompt": "n", "model": "w"}})}, ("swarmui", "swarm {id}", "n", "w", "")),
    ({"invokeai_metadata": json.dumps({"positive_prompt": "inv {id}", "negative_prompt": "", "model": {"name": "iv"}})}, ("invokeai", "inv {id}", None, "iv", "")),
    ({"prompt": "plain words {id}"}, ("others", "plain words {id}", None, None, "")),
    ({"Software": "ComfyUI"}, ("comfyui", None, None, None, "")),
    ({"Comment": "not json {"}, ("unknown", None, None, None, "")),
    ({}, ("unknown", None, None, None, "")),
)
_CHUNKS = sorted({k for meta, _ in CASES for k in meta})
ANSWERS = (
    ('{"description": "A cat {id}.", "tags": ["cat", "long hair"]}', "A cat {id}.", "cat, long hair"),
    ('```json\n{"caption": "Fenced", "tags": "a1, b2"}\n```', "Fenced", "a1, b2"),
    ("<nl>Said.</nl> and <TAGS>sky, # no, see: this</TAGS>", "Said.", "sky, # no, see: this"),
    ("Description: Two\nlines.\nTags: one; 1. Then more\ntwo", "Two\nlines.", "one; 1. Then more\ntwo"),
    ("nothing of the kind", "", ""),
    (None, "", ""),
)
#: A tag each, and its category.
NAMED = (
    ("Rating:safe", "rating"), ("score_9", "quality"), ("3girls", "character"), ("@someone", "artist"), ("1998", "meta"), ("wide_shot", "angle"), ("from behind", "angle"), ("red_background", "background"),
    ("anime_coloring", "style"), (":d", "expression"), ("open_mouth", "expression"), ("arms crossed", "pose"), ("night_sky", "background"), ("Blue Hair", "body"), ("holding_sword", "action"),
    ("pleated_skirt", "outfit"), ("catgirl", "character"), ("no_humans", "character"), ("no_text", "meta"), ("text_focus", "meta"), ("face_focus", "angle"), ("6+boys", "character"), ("bad_anatomy", "quality"), ("zzz", "unknown"), ("my_word", "mine"), (None, None),
)
MODELS = (
    ('{"a": {"b": "Civitai resources: [{\\"air\\":\\"urn:air:sd1:lora:civitai:12@34\\",\\"modelName\\":\\"Soft\\",\\"versionName\\":\\"v1\\",\\"weight\\":0.8},{\\"air\\":\\"none\\"}]"}}', "Soft/v1/0.8/12/34"),
    ('["Civitai resources: [{\\"air\\":\\"urn:air:x:civitai:5@6\\"},{\\"air\\":\\"urn:air:x:civitai:5@6\\"}]"]', "model 5///5/6"),
    ('{"a": 1}', ""),
)
LINES = ("cat_{id},0,12,kitty", "dog,x,1.5,", " ,1,2,", "# note", "bird,4,70,fowl")
EDGES = ("cat,animal", "# a,b", "dog , animal", "same,same", "tag{id},", "")
SAID = ("tag,中文", "cat,猫", "猫咪,cat", "dog,dog", "name,translation", "fox,狐")
STYLE_CASES = (("Blue_Eyes", "masterpiece", "smile", "blue eyes"), ("look", "", "Look", "score_9"), ("trig", "x", "trig", "1girl"))


def _turn(values):
    """The value whose turn it is by the item's id; ``{id}`` in it is that id."""
    listed = F.array(*(F.lit(v).cast("string") for v in values))
    return F.replace(F.element_at(listed, (F.col("id") % len(values) + 1).cast("int")), F.lit("{id}"), F.col("id").cast("string"))


def _quoted(v):
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _turn_sql(values):
    return f"replace(([{', '.join(map(_quoted, values))}]::VARCHAR[])[CAST(id % {len(values)} + 1 AS INTEGER)], '{{id}}', CAST(id AS VARCHAR))"


def _envelopes(spark, sf):
    pairs = [(F.lit(k), _turn([meta.get(k) for meta, _ in CASES])) for k in _CHUNKS]
    return I(spark, sf).select("id", F.map_filter(F.create_map(*(x for p in pairs for x in p)), lambda k, v: v.isNotNull()).alias("meta"))


def _record(spark, sf):
    rows = _envelopes(spark, sf).withColumn("generator", records.generator(F.col("meta")))
    r = records.parsed(F.col("meta"), F.col("generator"))
    return rows.select("id", "generator", r.alias("r")).select("id", "generator", "r.prompt", "r.negative_prompt", "r.checkpoint", F.array_join("r.loras", ",").alias("loras"))


_EXPECTED = ", ".join(f"{_turn_sql([want[k] for _, want in CASES])} AS {name}" for k, name in enumerate(("generator", "prompt", "negative_prompt", "checkpoint", "loras")))


def _hops(spark, sf):
    """Hops in a chain of twelve or fewer nodes that the item's id fixes, and in its two oddities."""
    node = lambda k: F.concat(F.lit(f'"{k}":{{"class_type":"' + ("KSampler" if k == 0 else "Node") + '","inputs":{"text":"[9, 0]","in":[["'), F.lit(str(k + 1)), F.lit('",0],["gone",1]]}}'))
    rows = dealt(I(spark, sf).select("id"), "id").select("id", F.concat(F.lit("{"), F.array_join(F.slice(F.array(*(node(k) for k in range(8))), F.lit(1), (F.col("id") % 8 + 1).cast("int")), ","), F.lit("}")).alias("graph"))
    return rows.select("id", F.explode(records.upstream(F.col("graph"))).alias("node", "hops"))


def _issues(spark, sf):
    return review.issues(I(spark, sf), ALL(spark, sf), ["brand_N9", "brand_R9"], 600, 2.0)


_ISSUES = """found AS (SELECT id, unnest([CASE WHEN coalesce(is_readable, 1) = 0 THEN '0unreadable' END, CASE WHEN trim(coalesce(ai_caption, '')) = '' AND trim(coalesce(nl_caption, '')) = '' THEN '1no_caption' END, CASE WHEN n IS NULL THEN '1untagged' END, CASE WHEN rated > 1 THEN '1several_ratings' END, CASE WHEN least(width, height) < 600 THEN '2small' END, CASE WHEN aesthetic_score < 2.0 THEN '2low_score' END]) AS f
FROM items LEFT JOIN (SELECT item_id, count(*) AS n, count(DISTINCT tag) FILTER (tag IN ('brand_N9', 'brand_R9')) AS rated FROM tags GROUP BY 1) ON id = item_id), issue AS (SELECT id, f[2:] AS kind, CAST(f[1] AS INTEGER) AS severity FROM found WHERE f IS NOT NULL)"""


def _signed(spark, sf):
    return review.signed_cursors(review.review_page(_issues(spark, sf), 40, (1, "no_caption", 100)), KEY)


def _pads(x):
    return "'" + "".join(f"\\x{b ^ x:02X}" for b in KEY.ljust(64, b"\0")) + "'::BLOB"


def _captions(spark, sf):
    return I(spark, sf).select("id", "filename", text.caption("trig", F.array(F.lit("cat")), F.col("nl_caption")).alias("caption"))


def _files(spark, sf):
    return review.sidecars(_captions(spark, sf))


_FILES = "files AS (SELECT id, lower(replace(filename, '.png', '')) || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.txt' AS file, caption FROM (SELECT id, filename, 'trig, cat' || coalesce('. ' || nl_caption, '') AS caption, row_number() OVER (PARTITION BY lower(filename) ORDER BY id) AS n FROM items))"


def _fresh(spark, sf):
    rows = T(spark, sf).where("item_id % 5 = 0 AND category <> 'character'")
    return rows.select("item_id", F.concat("tag", F.lit("_new")).alias("tag"), "confidence", F.lit("tagger").alias("source"))


def _batch(spark, sf):
    items, _ = review.tag_batch(I(spark, sf), T(spark, sf), _fresh(spark, sf), ["brand_N9_new", "brand_R9_new", "brand_A9_new"], F.lit("2024-01-01").cast("timestamp"))
    return items.select("id", "ai_rating", F.date_format("tagged_at", "yyyy-MM-dd").alias("day"))


def _patch(spark, sf):
    return I(spark, sf).where("id % 3 = 0").selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'webui' END AS generator", "CASE WHEN id % 4 = 0 THEN 'new one, <lora:Fresh:1>' END AS prompt", "'New_' || CAST(id % 5 AS STRING) AS checkpoint")


def _pairs(spark, sf):
    return I(spark, sf).where("id % 4 = 0").selectExpr("id AS target", "id - id % 8 + 1 AS source")


def _reviews(spark, sf):
    return C(spark, sf, "part").selectExpr("p_partkey AS review", "'/f/' || CAST(p_partkey AS STRING) AS path", "array(p_partkey % 50, p_partkey % 70 + 100) AS candidates")


def _choices(spark, sf):
    return C(spark, sf, "part").where("p_partkey % 3 > 0").selectExpr("p_partkey AS review", "CASE WHEN p_partkey % 5 = 0 THEN 1000 ELSE p_partkey % 50 END AS chosen")


def _pixels(spark, sf):
    """A picture for each part: an eight by eight patch of it."""
    p = dealt(C(spark, sf, "part").select("p_partkey"), "p_partkey", PICTURES)
    return p.select(F.col("p_partkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).selectExpr("id", "k % 8 * 40 + id % 30 AS x", "k DIV 8 * 50 + id % 20 AS y", "id * 7 * (k + 1) % 256 AS level", "id * 3 * (k + 2) % 256 AS r", "id * 5 * (k + 3) % 256 AS g", "id * 11 * (k + 1) % 256 AS b")


def _sizes(spark, sf):
    return C(spark, sf, "part").selectExpr("p_partkey AS id", "400 + p_partkey % 7 * 60 AS width", "440 + p_partkey % 5 * 90 AS height")


def _boxes(spark, sf):
    return review.crop_boxes(_pixels(spark, sf), _sizes(spark, sf), 200, 10.0)


_PIXELS = "pixels AS (SELECT id, k % 8 * 40 + id % 30 AS x, k // 8 * 50 + id % 20 AS y, id * 7 * (k + 1) % 256 AS level, id * 3 * (k + 2) % 256 AS r, id * 5 * (k + 3) % 256 AS g, id * 11 * (k + 1) % 256 AS b FROM (SELECT p_partkey AS id, unnest(range(64)) AS k FROM part)), sizes AS (SELECT p_partkey AS id, 400 + p_partkey % 7 * 60 AS width, 440 + p_partkey % 5 * 90 AS height FROM part)"
_BOXES = f"WITH {_PIXELS}, box AS (SELECT id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM pixels WHERE level >= 200 GROUP BY 1), boxes AS (SELECT id, width, height, CAST(greatest(0, l - ceil((r - l) * 10.0 / 100)) AS BIGINT) AS \"left\", CAST(greatest(0, t - ceil((b - t) * 10.0 / 100)) AS BIGINT) AS top, CAST(least(width, r + ceil((r - l) * 10.0 / 100)) AS BIGINT) AS \"right\", CAST(least(height, b + ceil((b - t) * 10.0 / 100)) AS BIGINT) AS bottom FROM box JOIN sizes USING (id))"
GRID = datasets.buckets(512, 64, 256, 1024)
_GRID = ", ".join(f"({k}, {w}, {h})" for k, (w, h) in enumerate(GRID))
_SUBJECT = f"""{_BOXES}, o AS (SELECT boxes.*, k, w, h, abs(width * h - height * w) / h AS d, CASE WHEN width * h > height * w THEN greatest(1, height * w // h) ELSE width END AS cw, CASE WHEN width * h > height * w THEN height ELSE greatest(1, width * h // w) END AS ch FROM boxes, (VALUES {_GRID}) g(k, w, h)),
best AS (SELECT id, arg_min({{'w': w, 'h': h, 'cw': cw, 'ch': ch}}, (d, k)) AS o FROM o WHERE "right" - "left" <= cw AND bottom - top <= ch GROUP BY 1)
SELECT id, o.w AS bucket_width, o.h AS bucket_height, CASE WHEN o IS NOT NULL THEN least(greatest(floor((width - o.cw) / 2), greatest(0, "right" - o.cw)), least("left", width - o.cw)) END AS crop_left, CASE WHEN o IS NOT NULL THEN least(greatest(floor((height - o.ch) / 2), greatest(0, bottom - o.ch)), least(top, height - o.ch)) END AS crop_top FROM boxes LEFT JOIN best USING (id)"""
_SHAPE = "CASE WHEN low > 0.2 AND high > 0.2 AND low + high > 0.5 THEN 'edge_heavy' WHEN lower > 0.5 THEN 'left_heavy' WHEN upper > 0.5 THEN 'right_heavy' WHEN middle > 0.5 THEN 'middle_heavy' ELSE 'balanced' END"
_COLOURS = f"""WITH {_PIXELS}, hsv AS (SELECT id, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS v, greatest(r, g, b) AS hi, least(r, g, b) AS lo, CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN (360 + 60 * (g - b) / (greatest(r, g, b) - least(r, g, b))) % 360 WHEN greatest(r, g, b) = g THEN 60 * (b - r) / (greatest(r, g, b) - least(r, g, b)) + 120 ELSE 60 * (r - g) / (greatest(r, g, b) - least(r, g, b)) + 240 END AS h FROM pixels),
m AS (SELECT id, avg(v) AS brightness, avg(CASE WHEN hi = 0 THEN 0 ELSE 100.0::DOUBLE * (hi - lo) / hi END) * 2.55::DOUBLE AS saturation, avg(h) * 255 / 360 AS hue, avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * avg(v) ** 3 AS m3, var_pop(v) AS s2, count(*) FILTER (v < 32) / count(*) AS low, count(*) FILTER (v >= 224) / count(*) AS high, count(*) FILTER (v < 64) / count(*) AS lower, count(*) FILTER (v >= 192) / count(*) AS upper, count(*) FILTER (v BETWEEN 64 AND 191) / count(*) AS middle FROM hsv GROUP BY 1)
SELECT id, round(brightness, 6) AS brightness, round(saturation, 6) AS saturation, CASE WHEN saturation < 30 THEN 'neutral' WHEN hue < 43 OR hue >= 213 THEN 'warm' WHEN hue >= 85 THEN 'cool' ELSE 'neutral' END AS temperature, round(CASE WHEN s2 > 0 THEN m3 / s2 ** 1.5 ELSE 0 END, 4) AS skew, {_SHAPE} AS shape FROM m"""



def _modes(spark, sf):
    item = {"id": F.col("id"), "prompt": F.col("prompt"), "negative": F.when(F.col("id") % 2 == 0, "bad"), "caption": F.col("ai_caption"), "prose": F.col("nl_caption"), "values": {"Model": F.col("checkpoint")}}
    tags = F.array(F.lit("blue_eyes"), F.lit("Hat"), F.lit("score_9"))
    said = F.array(*(F.struct(F.lit(m).alias("mode"), captions.sidecar(m, item, tags, "pre", ["hat"] if m != "nl_caption" else [], "{prompt}, by {caption}, {tags}").alias("content")) for m in captions.MODES))
    rows = dealt(I(spark, sf).select("id", "prompt", "ai_caption", "nl_caption", "checkpoint"), "id")
    return rows.select("id", F.explode(said).alias("s")).select("id", "s.*")


_PROMPTED = "(id % 12 > 1)"
_SAID = "'1girl, Blue_Eyes, (smile:1.2), look' || id % 8 || ' <lora:style' || id % 5 || ':0.8>'"
_PIC, _PROSE = "CASE WHEN id % 4 > 1 THEN 'a picture' END", "CASE WHEN id % 3 = 0 THEN 'words' WHEN id % 4 > 1 THEN 'a picture' END"
_MODES = f"""SELECT id, unnest([{', '.join(map(_quoted, captions.MODES))}]) AS mode, unnest(['blue eyes, score_9', p, n, concat_ws(chr(10), nullif(p, ''), 'Negative prompt: ' || nullif(n, '')), concat_ws(chr(10), nullif(p, ''), 'Negative prompt: ' || nullif(n, ''), 'Model: ' || checkpoint),
concat_ws(', ', 'pre', c, 'blue eyes, score_9'), concat_ws(', ', 'pre', c, nullif(p, ''), 'blue eyes, score_9'), concat_ws(', ', 'pre', w), concat_ws(', ', 'pre', 'blue eyes, score_9', w), concat_ws(chr(10), 'pre', CASE WHEN p <> '' THEN replace(p, ', ', chr(10)) END, w),
concat_ws(', ', nullif(p, ''), trim('by ' || coalesce(c, '')), 'blue eyes, score_9'), '{{"id":' || id || ',"prompt":"' || p || '","negative_prompt":"' || n || '","ai_caption":"' || coalesce(c, '') || '","tags":["blue_eyes","score_9"]}}']) AS content
FROM (SELECT id, checkpoint, CASE WHEN {_PROMPTED} THEN {_SAID} ELSE '' END AS p, CASE WHEN id % 2 = 0 THEN 'bad' ELSE '' END AS n, {_PIC} AS c, {_PROSE} AS w FROM items)"""


def _ingested(spark, sf):
    """Events read as a stream of files, ingested in batches, and the newest row of each id."""
    schema = C(spark, sf, "events").schema
    folder = activity.scratch(spark, "ingest")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    activity.ingest(stream, f"{folder}/rows", f"{folder}/state", "event_id").awaitTermination()
    return activity.latest(spark.read.parquet(f"{folder}/rows"), "event_id", "ts").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def _likeness(spark, sf):
    rows = I(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.col("prompt")).when(F.col("id") % 3 == 1, F.lit("worst quality, lowres, blurry, x")).otherwise(F.lit("one long line of plain words that says nothing")).alias("t"))
    return records.prompt_likeness(rows, "id", "t", spark.createDataFrame([("1girl",), ("Blue_Eyes",), ("lowres",)], "tag string")).select("id", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"), "negative")


def _hashes(spark, sf):
    return C(spark, sf, "part").selectExpr("CAST(p_partkey * 7919 % 4096 AS BIGINT) AS h")


def _top(spark, sf):
    """Places 11 to 30 by cosine with the vector of the least id, and whether more follow."""
    rows = C(spark, sf, "embeddings")
    query = rows.where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()["embedding"]
    scored = rows.select("vec_id", vectors.cosine_to(query).alias("s")).where("s IS NOT NULL")
    return scored.orderBy(F.desc("s"), "vec_id").offset(10).limit(20).select("vec_id")


def _lines(values):
    return lambda s, d: I(s, d).select(_turn(values).alias("value"))


def _counts(spark, sf):
    return T(spark, sf).groupBy("tag", "category").agg(F.count("*").alias("n"))


_DRAW = "(CAST('0x' || substr(md5('7:' || tag), 1, 12) AS BIGINT)::DOUBLE + 1) / (2.0::DOUBLE ** 48 + 1)"
_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_HUB = "coalesce(library_id, 'main')"
_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
_TAG_TURN = [t for t, _ in NAMED]


def _vectors_back(spark, sf):
    """Vectors as little-endian bytes and back: how many bytes, and whether all components are the same."""
    rows = C(spark, sf, "embeddings")
    packed = vectors.unpacked(vectors.packed(rows, "embedding", "bytes"), "bytes", "again")
    return packed.select("vec_id", F.octet_length("bytes").alias("n"), (F.col("embedding").cast("array<float>") == F.col("again")).alias("same"))


def _ruled(spark, sf):
    """Tags less those that a user's rule takes from their item."""
    rules = [{"conditions": [("brand_n", "present"), ("brand_a", "absent")], "targets": ["brand_r1", "brand_r2"]}]
    gone = library.exclusion_targets(T(spark, sf), rules).withColumnRenamed("target", "low")
    return T(spark, sf).select("item_id", "tag", F.lower("tag").alias("low")).join(gone, ["item_id", "low"], "left_anti").select("item_id", "tag")


ENTRIES = {
    "p01_light": (lambda s, d: review.projected(I(s, d), "light"), "SELECT id, path, filename, width, height, generator, ai_rating FROM items"),
    "p01_with_prompt": (lambda s, d: review.projected(I(s, d), "prompt"), "SELECT id, path, filename, width, height, generator, ai_rating, prompt, checkpoint FROM items"),
    "s11_files": (lambda s, d: readers.files(s, d, "*.parquet").select(F.regexp_extract("path", r"/([a-z]+)\.parquet(/[^/]*)?$", 1).alias("name"), (F.col("size") > 0).alias("filled")).distinct(), f"SELECT unnest([{', '.join(map(_quoted, _TABLES))}]) AS name, true AS filled"),
    "s12_records": (_record, f"SELECT id, {_EXPECTED} FROM items"),
    "s22_sidecars": (_files, f"@{_FILES} SELECT id, file, caption FROM files"),
    "s23_combined": (lambda s, d: _captions(s, d).orderBy("id").select("id", "caption"), "SELECT id, 'trig, cat' || coalesce('. ' || nl_caption, '') AS caption FROM items"),
    "s24_package": (lambda s, d: review.package(_files(s, d).withColumn("caption", F.when(F.col("id") % 10 > 0, F.col("caption"))), I(s, d)), f"@{_FILES} SELECT id, path, file, CASE WHEN coalesce(is_readable, 1) = 0 THEN 'unreadable' WHEN id % 10 = 0 THEN 'no_caption' ELSE 'ok' END AS state, CASE WHEN coalesce(is_readable, 1) > 0 AND id % 10 > 0 THEN sha256(caption) END AS digest FROM files JOIN items USING (id)"),
    "s27_workspace": (lambda s, d: review.workspace(I(s, d), "main"), f"SELECT id, '{{\"id\":' || id || ',\"path\":\"' || path || '\",\"width\":' || width || ',\"height\":' || height || coalesce(',\"generator\":\"' || generator || '\"', '') || coalesce(',\"checkpoint\":\"' || checkpoint || '\"', '') || '}}' AS line FROM items WHERE {_HUB} = 'main'"),
    "s37_tag_batch": (_batch, """@fresh AS (SELECT item_id, tag || '_new' AS tag, confidence FROM utags WHERE item_id % 5 = 0 AND category <> 'character'), every AS (SELECT item_id, tag, confidence, 0 AS manual FROM fresh UNION ALL SELECT item_id, tag, confidence, 1 FROM utags WHERE source = 'manual'),
one AS (SELECT item_id, tag, confidence FROM every WHERE item_id IN (SELECT item_id FROM fresh) QUALIFY row_number() OVER (PARTITION BY item_id, lower(tag) ORDER BY manual DESC, confidence DESC, tag) = 1),
r AS (SELECT item_id, arg_max(tag, (confidence, list_position(['brand_N9_new', 'brand_R9_new', 'brand_A9_new'], tag))) AS rating FROM one WHERE tag IN ('brand_N9_new', 'brand_R9_new', 'brand_A9_new') GROUP BY 1)
SELECT id, CASE WHEN id IN (SELECT item_id FROM fresh) THEN rating ELSE ai_rating END AS ai_rating, CASE WHEN id IN (SELECT item_id FROM fresh) THEN '2024-01-01' ELSE strftime(tagged_at, '%Y-%m-%d') END AS day FROM items LEFT JOIN r ON id = item_id"""),
    "s40_reparse": (lambda s, d: review.reparsed(I(s, d), _patch(s, d)).select("id", "generator", "prompt", "checkpoint", F.array_join("tokens", "|").alias("tokens"), F.array_join("loras", "|").alias("loras")), "SELECT id, CASE WHEN id % 6 = 0 THEN 'webui' ELSE generator END AS generator, CASE WHEN id % 12 = 0 THEN 'new one, <lora:Fresh:1>' ELSE prompt END AS prompt, CASE WHEN id % 3 = 0 THEN 'New_' || id % 5 ELSE checkpoint END AS checkpoint, CASE WHEN id % 12 = 0 THEN 'new one' WHEN id % 12 = 1 THEN '' ELSE '1girl|blue eyes|smile|look' || id % 8 END AS tokens, CASE WHEN id % 12 = 0 THEN 'fresh' WHEN id % 12 = 1 THEN '' ELSE 'style' || id % 5 END AS loras FROM items"),
    "s41_attributes": (lambda s, d: review.patched(I(s, d), I(s, d).where("id % 2 = 0").selectExpr("id", "'said' AS ai_caption", "CASE WHEN id % 4 = 0 THEN 'told' END AS nl_caption"), "ai_caption", "nl_caption").select("id", "ai_caption", "nl_caption"), "SELECT id, CASE WHEN id % 2 = 0 THEN 'said' ELSE ai_caption END AS ai_caption, CASE WHEN id % 4 = 0 THEN 'told' ELSE nl_caption END AS nl_caption FROM items"),
    "f37_exact_page": (lambda s, d: paging.page(filtered(s, d).items.where(F.array_contains(text.prompt_tokens(F.col("prompt")), "look3")), "newest", 25, 50).select("id"), f"SELECT id FROM items WHERE id % 8 = 3 AND id % 12 > 1 ORDER BY {SORTS['newest']} LIMIT 25 OFFSET 50"),
    "a27_review_queue": (lambda s, d: review.review_page(_issues(s, d), 50, (1, "no_caption", 100)), f"@{_ISSUES} SELECT id, kind, severity FROM issue WHERE (severity, kind, id) > (1, 'no_caption', 100) ORDER BY severity, kind, id LIMIT 50"),
    "a37_roll_up": (lambda s, d: review.roll_up(datasets.validation(I(s, d).select("id", F.expr(CAPTION).alias("c")), "c", "look3")), f"SELECT *, CAST(list_position([{', '.join(map(_quoted, review.CODES))}], code) AS INTEGER) AS place FROM ({VALIDATION_SQL})"),
    "a46_readiness": (lambda s, d: review.readiness(_issues(s, d)), f"@{_ISSUES} SELECT kind, severity, count(*) AS n, min(id) AS sample, severity = 0 AS blocks FROM issue GROUP BY 1, 2"),
    "o11_signed_cursor": (_signed, f"@{_ISSUES} SELECT id, kind, p || '|' || sha256({_pads(0x5C)} || unhex(sha256({_pads(0x36)} || encode(p)))) AS cursor FROM (SELECT id, kind, severity || ':' || kind || ':' || id AS p FROM issue WHERE (severity, kind, id) > (1, 'no_caption', 100) ORDER BY severity, kind, id LIMIT 40)"),
    "o02_tag_count_order": (lambda s, d: paging.with_tag_count(I(s, d), T(s, d)).orderBy(F.desc("n_tags"), F.desc("id")).limit(60).select("id", "n_tags"), "SELECT id, coalesce(n, 0) AS n_tags FROM items LEFT JOIN (SELECT item_id, count(DISTINCT tag) AS n FROM utags GROUP BY 1) ON id = item_id ORDER BY 2 DESC, 1 DESC LIMIT 60"),
    "o04_rating_order": (lambda s, d: paging.page(I(s, d), "rating", 60, 30).select("id", "ai_rating"), f"SELECT id, ai_rating FROM items ORDER BY {SORTS['rating']} LIMIT 60 OFFSET 30"),
    "o09_top_k": (_top, f"SELECT a.vec_id FROM embeddings a, (SELECT embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) b WHERE a.embedding IS NOT NULL ORDER BY {_COSINE} DESC, a.vec_id LIMIT 20 OFFSET 10"),
    "u04_merged": (lambda s, d: review.merged(T(s, d).where("category = 'character'").groupBy("tag").agg(F.count("*").alias("n")), T(s, d).groupBy("tag").agg(F.count("*").alias("n")), s.createDataFrame([("brand_a1", 5), ("New Tag", 9)], "tag string, n long")), "SELECT tag, CAST(arg_min(bucket, (bucket, -n)) AS INTEGER) AS bucket, arg_min(n, (bucket, -n)) AS n FROM (SELECT replace(lower(tag), '_', ' ') AS tag, 0 AS bucket, count(*) AS n FROM utags WHERE category = 'character' GROUP BY utags.tag UNION ALL SELECT replace(lower(tag), '_', ' '), 1, count(*) FROM utags GROUP BY utags.tag UNION ALL VALUES ('brand a1', 2, 5), ('new tag', 2, 9)) GROUP BY 1"),
    "x08_category": (lambda s, d: categories.categorized(I(s, d).select("id", _turn(_TAG_TURN).alias("tag")), s.createDataFrame([("My Word", "mine"), ("my_word", "other")], "tag string, category string")), f"SELECT id, {_turn_sql(_TAG_TURN)} AS tag, {_turn_sql([c for _, c in NAMED])} AS category FROM items"),
    "x16_vector_bytes": (_vectors_back, "SELECT vec_id, 4 * len(embedding) AS n, CASE WHEN embedding IS NOT NULL THEN true END AS same FROM embeddings"),
    "x21_generator": (lambda s, d: _envelopes(s, d).select("id", records.generator(F.col("meta")).alias("generator")), f"SELECT id, {_turn_sql([w[0] for _, w in CASES])} AS generator FROM items"),
    "x22_other_programs": (lambda s, d: _record(s, d).where("generator IN ('fooocus', 'swarmui', 'invokeai')"), f"SELECT id, {_EXPECTED} FROM items WHERE id % {len(CASES)} IN (5, 10, 11)"),
    "x23_graph_hops": (_hops, "SELECT id, CAST(unnest(range(id % 8 + 1)) AS VARCHAR) AS node, CAST(unnest(range(id % 8 + 1)) AS INTEGER) AS hops FROM items"),
    "x24_prompt_likeness": (_likeness, "SELECT id, CASE WHEN id % 3 = 0 AND id % 12 = 0 THEN 0.0 WHEN id % 3 = 0 THEN 0.8 WHEN id % 3 = 1 THEN 0.44 ELSE 0.405 END AS score, CASE WHEN id % 3 = 0 AND id % 12 > 1 THEN 0.5 WHEN id % 3 = 1 THEN 0.25 ELSE 0.0 END AS share, id % 3 = 1 AS negative FROM items"),
    "x35_caption_modes": (_modes, _MODES),
    "x42_model_answers": (lambda s, d: I(s, d).select("id", records.answer(_turn([a for a, _, _ in ANSWERS])).alias("a")).select("id", "a.prose", "a.tags", F.array_join(records.tag_list(F.col("a.tags")), "|").alias("listed")), f"SELECT id, {_turn_sql([p for _, p, _ in ANSWERS])} AS prose, {_turn_sql([t for _, _, t in ANSWERS])} AS tags, {_turn_sql(['cat|long hair', 'a1|b2', 'sky', 'one|two', '', ''])} AS listed FROM items"),
    "x47_weighted_picks": (lambda s, d: review.weighted_picks(_counts(s, d), 7, T(s, d).where("tag LIKE '%A%'")), f"SELECT category, arg_min(tag, -ln({_DRAW}) / n) AS tag FROM (SELECT tag, category, count(*) AS n FROM utags WHERE tag NOT LIKE '%A%' GROUP BY 1, 2) GROUP BY 1"),
    "x51_model_references": (lambda s, d: I(s, d).select("id", records.model_references(_turn([m for m, _ in MODELS])).alias("m")).select("id", F.array_join(F.transform("m", lambda e: F.concat_ws("/", e["model"], F.coalesce(e["version"], F.lit("")), F.coalesce(e["weight"].cast("string"), F.lit("")), e["model_id"].cast("string"), e["version_id"].cast("string"))), "|").alias("x")), f"SELECT id, {_turn_sql([x for _, x in MODELS])} AS x FROM items"),
    "x53_assembled": (lambda s, d: I(s, d).select("id", captions.assembled("Trig", F.array(_turn([c[0] for c in STYLE_CASES]), _turn([c[1] for c in STYLE_CASES])), F.array(_turn([c[2] for c in STYLE_CASES]), _turn([c[3] for c in STYLE_CASES])), F.col("nl_caption")).alias("x")), f"SELECT id, {_turn_sql(['trig, blue eyes, smile', 'trig, look', 'trig, x, 1girl'])} || coalesce(', ' || nl_caption, '') AS x FROM items"),
    "x57_crop_boxes": (_boxes, f"{_BOXES} SELECT * FROM boxes"),
    "x58_subject_buckets": (lambda s, d: review.subject_buckets(_boxes(s, d), GRID), _SUBJECT),
    "x60_colour_records": (lambda s, d: review.colour_records(_pixels(s, d)), _COLOURS),
    "x61_novel_params": (lambda s, d: I(s, d).select("id", F.explode(records.novel_params(F.when(F.col("id") % 2 == 0, json.dumps(_NOVEL)).otherwise("no"))).alias("key", "value")), "SELECT id, unnest(['steps', 'cfg_scale', 'uc_preset', 'size']) AS key, unnest(['28', '5.5', '2', '832x1216']) AS value FROM items WHERE id % 2 = 0"),
    "x61_characters": (lambda s, d: I(s, d).select("id", F.inline(records.character_prompts(F.when(F.col("id") % 2 == 0, json.dumps(_NOVEL))))), "SELECT id, unnest([0, 1]) AS index, unnest(['red', 'blue']) AS prompt, unnest(['x', 'y']) AS negative_prompt, unnest([0.1, NULL]::DOUBLE[]) AS x, unnest([0.5, NULL]::DOUBLE[]) AS y FROM items WHERE id % 2 = 0"),
    "b08_copied_state": (lambda s, d: review.copied_state(I(s, d), _pairs(s, d), ("ai_caption", "nl_caption", "aesthetic_score")).select("id", "ai_caption", "nl_caption", F.round("aesthetic_score", 6).alias("aesthetic_score")), "SELECT i.id, CASE WHEN o.id IS NULL THEN i.ai_caption ELSE o.ai_caption END AS ai_caption, CASE WHEN o.id IS NULL THEN i.nl_caption ELSE o.nl_caption END AS nl_caption, round(CASE WHEN o.id IS NULL THEN i.aesthetic_score ELSE o.aesthetic_score END, 6) AS aesthetic_score FROM items i LEFT JOIN items o ON i.id % 4 = 0 AND o.id = i.id - i.id % 8 + 1"),
    "b15_repair": (lambda s, d: review.repair(I(s, d), _envelopes(s, d)).select("id", "generator", "prompt", "checkpoint"), f"SELECT id, CASE WHEN hit THEN g ELSE generator END AS generator, CASE WHEN hit THEN coalesce(p, prompt) ELSE prompt END AS prompt, CASE WHEN hit THEN coalesce(c, checkpoint) ELSE checkpoint END AS checkpoint FROM (SELECT *, {_turn_sql([w[0] for _, w in CASES])} AS g, {_turn_sql([w[1] for _, w in CASES])} AS p, {_turn_sql([w[3] for _, w in CASES])} AS c, id % 12 < 2 AND g <> 'unknown' AS hit FROM items)"),
    "b16_reviews": (lambda s, d: review.settle(_reviews(s, d), _choices(s, d)), """WITH r AS (SELECT p_partkey AS review, '/f/' || p_partkey AS path, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 1000 ELSE p_partkey % 50 END END AS chosen FROM part), f AS (SELECT *, chosen IS NOT NULL AND chosen < 1000 AS fits FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY chosen, fits ORDER BY review) AS turn FROM f)
SELECT review, path, CASE WHEN chosen IS NULL THEN 'pending' WHEN fits AND turn = 1 THEN 'resolved' ELSE 'conflict' END AS state, CASE WHEN fits AND turn = 1 THEN chosen END AS id FROM n"""),
    "b17_moves": (lambda s, d: review.moves(I(s, d), F.concat(F.lit("/lib/2/sub"), (F.col("id") % 3).cast("string"))), "SELECT id, path, folder || '/' || CASE WHEN n = 1 THEN filename ELSE replace(filename, '.png', '') || '_' || n || '.png' END AS target FROM (SELECT *, row_number() OVER (PARTITION BY folder, lower(filename) ORDER BY id) AS n FROM (SELECT *, '/lib/2/sub' || id % 3 AS folder FROM items) WHERE regexp_replace(path, '/[^/]*$', '') <> folder)"),
    "t01_ingest": (_ingested, "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1"),
    "g01_user_rules": (_ruled, "SELECT item_id, tag FROM utags WHERE NOT (lower(tag) IN ('brand_r1', 'brand_r2') AND item_id IN (SELECT item_id FROM utags GROUP BY 1 HAVING bool_or(contains(lower(tag), 'brand_n')) AND NOT bool_or(contains(lower(tag), 'brand_a'))))"),
    "g02_overrides": (lambda s, d: library.with_overrides(_counts(s, d).groupBy("tag").agg(F.sum("n").alias("n")).where("n >= 2"), categories.by_rule(F.col("tag")), s.createDataFrame([("BRAND_N1", "mine")], "tag string, category string")), "SELECT tag, CAST(sum(n) AS BIGINT) AS n, CASE WHEN lower(tag) = 'brand_n1' THEN 'mine' ELSE 'unknown' END AS category FROM (SELECT tag, count(*) AS n FROM utags GROUP BY 1) GROUP BY 1 HAVING sum(n) >= 2"),
    "g03_templates": (lambda s, d: I(s, d).select("id", captions.rendered("{a},, {b}  {b}, {none}, end", {"a": F.col("generator"), "b": F.col("width")}).alias("x")), "SELECT id, concat_ws(', ', generator, width || ' ' || width, 'end') AS x FROM items"),
    "g04_regex_replace": (lambda s, d: mutate.find_replace(ALL(s, d), r"[Bb]rand_([A-Z])([0-4])", "$2-$1", "regex").select("item_id", F.lower("tag").alias("tag"), F.round("confidence", 6).alias("confidence")), "SELECT item_id, tag, round(max(confidence), 6) AS confidence FROM (SELECT item_id, confidence, lower(regexp_replace(tag, '^[Bb]rand_([A-Z])([0-4])$', '\\2-\\1')) AS tag FROM tags) GROUP BY 1, 2"),
}


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def _whole(sql: str) -> str:
    """``sql`` after the frames that it names; a leading @ marks more frames of its own."""
    if not sql.startswith("@"):
        return sql if sql.startswith("WITH ") else catalog.with_frames(sql)
    return catalog.with_frames("@" + sql[1:]).replace(" @", ", ", 1)


def oracle_sql():
    return {name: _whole(sql) for name, (_, sql) in ENTRIES.items()}
