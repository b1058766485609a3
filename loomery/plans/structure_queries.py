"""Stored indexes, staged ingests and packages, drawn prompts, colour records and word categories as
queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import captions, categories, records
from loomery.operators import draws, evidence, pictures, review, vector_index, vectors
from loomery.operators.dealing import dealt
from loomery.sources import packages, readers
from loomery.streaming import activity, two_phase

from . import catalog
from .record_queries import _FILES, _PIXELS, _files, _pixels

C, I, T, ALL = catalog.table, catalog.items, catalog.unique_tags, catalog.tags
NEAREST = 20
SEEDS = (1, 2, 3, 5, 8, 13)
ORDER = (("general", 3), ("character", 2), ("rating", 1))
#: Rules among tags, in SQL of both engines: some general tags bar a character, some characters a rating.
BARS = "CASE WHEN substr(tag, 8, 1) IN ('3', '4', '5') THEN substr(tag, 1, 7) || '1' WHEN substr(tag, 8, 1) IN ('0', '1') THEN substr(tag, 1, 7) || '9' END"


def _index(spark, sf):
    rows = C(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    return rows, rows.where("vec_id % 50 = 0"), vector_index.build(rows, activity.scratch(spark, "vector-index"), NEAREST)


def _candidates(spark, sf):
    """The nearest of every fiftieth vector among those that the index proposes."""
    rows, asks, index = _index(spark, sf)
    return vector_index.search(index, asks, NEAREST).select("query_id", "id", F.round("similarity", 4).alias("similarity"), "place")


def _recall(spark, sf):
    """How many vectors searched, how many neighbours the exact way finds, and whether the index finds nine in ten."""
    rows, asks, index = _index(spark, sf)
    truth = vector_index.exact(rows, asks, NEAREST).select("query_id", "id", F.lit(1).alias("true"))
    both = truth.join(vector_index.search(index, asks, NEAREST).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("searches"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def _exact(spark, sf):
    rows = C(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    return vector_index.exact(rows, rows.where("vec_id % 50 = 0"), NEAREST).select("query_id", "id", F.round("similarity", 4).alias("similarity"), "place")


def _two_phase(spark, sf):
    """Events as files: some never read, some read in vain."""
    folder = activity.scratch(spark, "two-phase")
    events = C(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    value = F.when(F.col("event_id") % 7 > 0, F.get_json_object("props", "$.k"))
    parse = lambda seen: seen.where("event_type <> 'signup'").select("event_id", value.alias("k"))
    two_phase.start(stream, f"{folder}/rows", f"{folder}/state", "event_id", parse).awaitTermination()
    return two_phase.state(spark, f"{folder}/rows", "event_id", "k")


def _written(spark, sf):
    """A package on disk, read back: every row of the manifest, and the caption of its pair."""
    said = _files(spark, sf).withColumn("caption", F.when(F.col("id") % 10 > 0, F.col("caption")))
    rows = review.package(said, I(spark, sf)).join(said.select("id", "caption"), "id").checkpoint()
    path = packages.write(rows, activity.scratch(spark, "package"))
    pairs, manifest = packages.read(spark, path)
    return manifest.join(pairs.select("id", "caption"), "id", "left").select("id", "path", "file", "state", "digest", "caption")


def _prompts(spark, sf):
    counts = T(spark, sf).groupBy("tag", "category").agg(F.count("*").alias("n"))
    rules = T(spark, sf).select("tag").distinct().select(F.col("tag").alias("condition"), F.expr(BARS).alias("target")).where("target IS NOT NULL")
    always = spark.createDataFrame([("masterpiece", "quality")], "tag string, category string")
    return draws.drawn(counts, list(SEEDS), list(ORDER), rules, always)


_TIME = "-ln((CAST('0x' || substr(md5(seed || ':' || tag), 1, 12) AS BIGINT)::DOUBLE + 1) / (2.0::DOUBLE ** 48 + 1)) / n"


def _drawn_sql() -> str:
    """Each category after the one before it."""
    parts = [f"WITH {catalog.TAGS_SQL}, counts AS MATERIALIZED (SELECT tag, category, count(*) AS n FROM utags GROUP BY 1, 2), rules AS (SELECT DISTINCT tag AS condition, {BARS} AS target FROM utags WHERE {BARS} IS NOT NULL)", f"p0 AS (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed, 'quality' AS category, 'masterpiece' AS tag, 1 AS place)"]
    for k, (category, most) in enumerate(ORDER):
        parts.append(f"f{k} AS (SELECT s.seed, c.tag, {_TIME} AS t FROM counts c, (SELECT seed FROM p0) s WHERE category = '{category}' AND (s.seed, c.tag) NOT IN (SELECT seed, target FROM p{k} JOIN rules ON tag = condition) AND (s.seed, c.tag) NOT IN (SELECT seed, tag FROM p{k}))")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT seed, '{category}', tag, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY t, tag) AS place FROM f{k}) WHERE place <= {most})")
    return ", ".join(parts)


_LAST = f"p{len(ORDER)}"
_HUE = "CASE WHEN v < 14 THEN 'black' WHEN s < 10 AND v > 82 THEN 'white' WHEN s < 10 THEN 'gray' WHEN h >= 15 AND h <= 45 AND s <= 45 AND v > 72 THEN NULL WHEN h >= 15 AND h <= 50 AND v <= 62 THEN 'brown' WHEN (h >= 340 OR h < 15) AND s <= 45 AND v > 75 THEN 'pink' WHEN h >= 315 AND h < 340 THEN 'pink' WHEN h >= 340 OR h < 15 THEN 'red' WHEN h < 42 THEN 'orange' WHEN h < 68 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 195 THEN 'cyan' WHEN h < 255 THEN 'blue' ELSE 'purple' END"
_HSV = "CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (360 + 60.0::DOUBLE * (g - b) / (hi - lo)) % 360 WHEN hi = g THEN 60.0::DOUBLE * (b - r) / (hi - lo) + 120 ELSE 60.0::DOUBLE * (r - g) / (hi - lo) + 240 END AS h, CASE WHEN hi = 0 THEN 0 ELSE 100.0::DOUBLE * (hi - lo) / hi END AS s"
_STEPS = " || ',' || ".join(f"count(*) FILTER (level // 16 = {k})" for k in range(16))
_RECORDS = f"""WITH {_PIXELS}, tops AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS level FROM (SELECT id, r, g, b FROM pixels)),
hsv AS (SELECT *, {_HSV} FROM tops),
m AS (SELECT id, avg(hi) AS v, avg(s) * 2.55::DOUBLE AS s, degrees(atan2(avg(sin(radians(h))), avg(cos(radians(h))))) AS h, '[' || {_STEPS} || ']' AS histogram, avg(level ** 3) - 3 * avg(level) * avg(level ** 2) + 2 * avg(level) ** 3 AS m3, var_pop(level) AS s2,
  count(*) FILTER (level < 32) / count(*) AS low, count(*) FILTER (level >= 224) / count(*) AS high, count(*) FILTER (level < 64) / count(*) AS lower, count(*) FILTER (level >= 192) / count(*) AS upper, count(*) FILTER (level BETWEEN 64 AND 191) / count(*) AS middle FROM hsv GROUP BY 1),
binned AS (SELECT id, r // 64 * 16 + g // 64 * 4 + b // 64 AS bin, count(*) AS n, CAST(round(avg(r)) AS INTEGER) AS r, CAST(round(avg(g)) AS INTEGER) AS g, CAST(round(avg(b)) AS INTEGER) AS b FROM pixels GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, bin) AS place, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY id), 1) AS pct FROM binned),
five AS (SELECT *, {_HSV} FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM placed WHERE place <= 5)),
named AS (SELECT id, place, hex, pct, CASE WHEN pct >= 15 THEN {_HUE} END AS name FROM (SELECT *, hi / 2.55::DOUBLE AS v FROM five)),
listed AS (SELECT id, '[' || string_agg('{{"hex":"' || hex || '","pct":' || pct || '}}', ',' ORDER BY place) || ']' AS colours, list(name ORDER BY place) FILTER (name IS NOT NULL) AS names FROM named GROUP BY 1)
SELECT id, colours AS dominant_colors, CASE WHEN len(coalesce(names, [])) = 0 THEN '' ELSE ',' || array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') || ',' END AS dominant_color_tags, round(m.v, 6) AS avg_brightness,
CASE WHEN m.s < 30 THEN 'neutral' WHEN (CASE WHEN m.h < 0 THEN m.h + 360 ELSE m.h END) * 255 / 360 < 43 OR (CASE WHEN m.h < 0 THEN m.h + 360 ELSE m.h END) * 255 / 360 >= 213 THEN 'warm' WHEN (CASE WHEN m.h < 0 THEN m.h + 360 ELSE m.h END) * 255 / 360 >= 85 THEN 'cool' ELSE 'neutral' END AS color_temperature,
round(m.s, 6) AS color_saturation, histogram AS brightness_histogram, round(CASE WHEN s2 > 0 THEN m3 / s2 ** 1.5 ELSE 0 END, 4) + 0.0 AS brightness_skew,
CASE WHEN low > 0.2 AND high > 0.2 AND low + high > 0.5 THEN 'edge_heavy' WHEN lower > 0.5 THEN 'left_heavy' WHEN upper > 0.5 THEN 'right_heavy' WHEN middle > 0.5 THEN 'middle_heavy' ELSE 'balanced' END AS brightness_distribution FROM m JOIN listed USING (id)"""
_COSINE = "list_cosine_similarity(q.e, e.e)"
_UNITS = "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)"

#: Tags of three words and a word list of whole names, last words and first words, in SQL of both engines.
TAGGED = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN p_type || ' ' || p_name WHEN 3 THEN p_name || '_' || p_type ELSE p_type || '_' || p_brand END"
_WORDS = "SELECT DISTINCT p_name AS word, 'whole' AS category FROM part WHERE p_partkey % 7 = 0 UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'kind' FROM part WHERE p_size % 4 > 0 UNION SELECT DISTINCT p_type, 'type' FROM part WHERE p_size > 25"


def _words(spark, sf):
    C(spark, sf, "part").createOrReplaceTempView("loomery_part")
    return spark.sql(_WORDS.replace("FROM part", "FROM loomery_part"))


_BY_WORDS = f"""WITH known AS (SELECT replace(lower(trim(word)), ' ', '_') AS word, min(category) AS category FROM ({_WORDS}) GROUP BY 1),
t AS (SELECT DISTINCT {TAGGED} AS tag FROM part), w AS (SELECT tag, list_filter(string_split(replace(lower(trim(tag)), ' ', '_'), '_'), lambda x: x <> '') AS ws FROM t WHERE tag IS NOT NULL),
runs AS (SELECT tag, k, len(ws) - k AS turn, array_to_string(ws[len(ws) - k + 1:], '_') AS word FROM (SELECT tag, ws, unnest(range(1, len(ws) + 1)) AS k FROM w) UNION ALL SELECT tag, k, 2 * len(ws) - k, array_to_string(ws[:k], '_') FROM (SELECT tag, ws, unnest(range(1, len(ws))) AS k FROM w)),
best AS (SELECT tag, arg_min({{'word': runs.word, 'category': category}}, turn) AS b FROM runs JOIN known ON known.word = runs.word GROUP BY 1)
SELECT w.tag, b.word AS word, b.category AS category FROM w LEFT JOIN best USING (tag)"""

#: Records of every item, made of its own prompt, sizes and checkpoint in the form of a program (by id), in
#: SQL of both engines: chunks by name, and what must be read back from them.
_P = "CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'plain words ' || CAST(id AS STRING) ELSE prompt END"
_N = "'bad ' || CAST(width AS STRING)"
_M = "'mix_' || CAST(id % 37 AS STRING)"
_TEXT = f"{_P} || chr(10) || 'Negative prompt: ' || {_N} || chr(10) || 'Steps: ' || CAST(id % 50 + 1 AS STRING) || ', Sampler: Euler, Seed: ' || CAST(id AS STRING) || ', Model: ' || {_M}"
_NODES = f"""'{{"' || CAST(id AS STRING) || '":{{"class_type":"CLIPTextEncode","inputs":{{"text":"' || {_P} || '"}}}},"n' || CAST(id AS STRING) || '":{{"class_type":"CLIPTextEncode","inputs":{{"text":"' || {_N} || '"}}}},"load":{{"class_type":"CheckpointLoaderSimple","inputs":{{"ckpt_name":"' || {_M} || '.safetensors"}}}},"extra":{{"class_type":"LoraLoader","inputs":{{"lora_name":"Glow' || CAST(id % 9 AS STRING) || '.safetensors"}}}},"sample":{{"class_type":"KSampler","inputs":{{"positive":["' || CAST(id AS STRING) || '",0],"negative":["n' || CAST(id AS STRING) || '",0]}}}}}}'"""
CHUNKS = {
    "parameters": f"CASE id % 7 WHEN 0 THEN {_TEXT} WHEN 1 THEN {_TEXT} || ', Version: f2.0.' || CAST(id % 10 AS STRING) || 'v1.10.1' WHEN 2 THEN {_TEXT} WHEN 4 THEN '{{\"sui_image_params\":{{\"prompt\":\"' || {_P} || '\",\"negativeprompt\":\"' || {_N} || '\",\"model\":\"' || {_M} || '\"}}}}' END",
    "Software": "CASE id % 7 WHEN 2 THEN 'stable-diffusion-webui-re_forge ' || CAST(id AS STRING) END",
    "Comment": f"CASE id % 7 WHEN 3 THEN '{{\"prompt\":\"' || {_P} || '\",\"uc\":\"' || {_N} || '\"}}' WHEN 5 THEN '{{\"prompt\":\"' || {_P} || '\",\"negative_prompt\":\"' || {_N} || '\",\"base_model\":\"' || {_M} || '.ckpt\",\"loras\":[\"Ink' || CAST(id % 8 AS STRING) || '.pt\"]}}' END",
    "prompt": f"CASE id % 7 WHEN 6 THEN {_NODES} END",
}


def _built(spark, sf):
    """Each item's chunks, read back."""
    pairs = [x for k, e in CHUNKS.items() for x in (F.lit(k), F.expr(e))]
    rows = dealt(I(spark, sf).select("id", "prompt", "width"), "id").select("id", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("meta")).withColumn("generator", records.generator(F.col("meta")))
    r = records.parsed(F.col("meta"), F.col("generator"))
    return rows.select("id", "generator", r.alias("r")).select("id", "generator", "r.prompt", "r.negative_prompt", "r.checkpoint", F.array_join("r.loras", ",").alias("loras"))


_BUILT = f"""SELECT id, CASE id % 7 WHEN 0 THEN 'webui' WHEN 1 THEN 'forge' WHEN 2 THEN 'reforge' WHEN 3 THEN 'nai' WHEN 4 THEN 'swarmui' WHEN 5 THEN 'fooocus' ELSE 'comfyui' END AS generator, trim(p) AS prompt, n AS negative_prompt, CASE WHEN id % 7 <> 3 THEN m END AS checkpoint,
CASE WHEN id % 7 < 3 THEN CASE WHEN starts_with(p, 'plain') THEN '' ELSE 'style' || id % 5 END WHEN id % 7 = 5 THEN 'ink' || id % 8 WHEN id % 7 = 6 THEN 'glow' || id % 9 ELSE '' END AS loras
FROM (SELECT id, {_P.replace('STRING', 'VARCHAR')} AS p, {_N.replace('STRING', 'VARCHAR')} AS n, {_M.replace('STRING', 'VARCHAR')} AS m FROM items)"""


def _answers(spark, sf):
    """A model's answer about every item, in four forms by turns, taken apart again."""
    prose = F.concat(F.lit("A "), F.coalesce("generator", F.lit("plain")), F.lit(" scene of "), F.col("width").cast("string"), F.lit("."))
    tags = [F.concat(F.lit("tone "), (F.col("id") % 7).cast("string")), F.lower(F.coalesce("checkpoint", F.lit("none"))), F.when(F.col("id") % 3 == 0, "Seen from afar, and said so.").otherwise("blue sky")]
    line, turn = F.array_join(F.array(*tags), ", "), F.col("id") % 4
    said = (
        F.when(turn == 0, F.to_json(F.struct(prose.alias("description"), line.alias("tags"))))
        .when(turn == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(prose.alias("caption"), F.array(*tags).alias("tags"))), F.lit("\n```")))
        .when(turn == 2, F.concat(F.lit("<nl>"), prose, F.lit("</nl> so <TAGS> "), line, F.lit("</TAGS>")))
        .otherwise(F.concat(F.lit("Caption: "), prose, F.lit("\nTags: "), line))
    )
    return I(spark, sf).select("id", records.answer(said).alias("a")).select("id", "a.prose", "a.tags", F.array_join(records.tag_list(F.col("a.tags")), "|").alias("listed"))


def _references(spark, sf):
    """Models that every item's document names, some of them twice or without an address."""
    n = F.col("id")
    of = lambda k: F.struct(F.when((n + k) % 5 > 0, F.concat(F.lit("urn:air:sd1:lora:civitai:"), (n % 100 + k).cast("string"), F.lit("@"), (n + k).cast("string"))).otherwise("none").alias("air"), F.concat(F.lit("Mod "), (n % 13).cast("string")).alias("modelName"), F.when(n % 4 > 0, F.concat(F.lit("v"), (n % 4).cast("string"))).alias("versionName"), ((n % 9 + 1) / 4).alias("weight"))
    text = F.concat(F.lit("a picture. Civitai resources: "), F.to_json(F.array(of(1), of(2), of(1))), F.lit(" and more"))
    held = records.model_references(F.to_json(F.struct(n.alias("number"), F.struct(text.alias("said")).alias("inner"))))
    return I(spark, sf).select("id", F.explode(held).alias("m")).select("id", "m.*")


_REFERENCES = "SELECT id, 'Mod ' || id % 13 AS model, CASE WHEN id % 4 > 0 THEN 'v' || id % 4 END AS version, (id % 9 + 1) / 4 AS weight, id % 100 + k AS model_id, id + k AS version_id FROM items, (VALUES (1), (2)) t(k) WHERE (id + k) % 5 > 0"


def _parameters(spark, sf):
    """Generation values of every item's comment under the names used here."""
    n = F.col("id")
    comment = F.to_json(F.struct((n % 50 + 1).alias("steps"), (n % 8 + 0.5).alias("scale"), F.when(n % 3 > 0, n * 7).alias("seed"), F.col("width"), F.when(n % 5 > 0, F.col("height")).alias("height"), F.lit("x").alias("mine"), (n % 2 == 0).alias("sm")))
    return I(spark, sf).select("id", F.explode(records.novel_params(comment)).alias("key", "value"))


_PARAMETERS = "SELECT id, unnest(['steps', 'cfg_scale', 'seed', 'size', 'sm']) AS key, unnest([CAST(id % 50 + 1 AS VARCHAR), CAST(id % 8 + 0.5 AS VARCHAR), CASE WHEN id % 3 > 0 THEN CAST(id * 7 AS VARCHAR) END, CASE WHEN id % 5 > 0 THEN width || 'x' || height END, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END]) AS value FROM items"


#: Texts that read like prompts or not, made of every item's own columns, in SQL of both engines.
_READ = "CASE id % 5 WHEN 0 THEN prompt WHEN 1 THEN 'worst quality, lowres, ' || CAST(width AS STRING) || ', ' || coalesce(generator, 'blurry') || ', blurry' WHEN 2 THEN 'one line of plain words about picture ' || CAST(id AS STRING) || ' and nothing else' WHEN 3 THEN 'smile, ' || coalesce(prompt, 'none') || ', (look' || CAST(id % 9 AS STRING) || ':1.3)' ELSE coalesce(checkpoint, '') || ', x' END"
_KNOWN = ("1girl", "Blue_Eyes", "smile", "model_3", "look4")


def _read_like(spark, sf):
    words = T(spark, sf).select("tag").distinct().union(spark.createDataFrame([(w,) for w in _KNOWN], "tag string"))
    found = records.prompt_likeness(I(spark, sf).selectExpr("id", f"{_READ} AS t"), "id", "t", words)
    return found.select("id", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"), "negative")


_LIKE = f"""known AS (SELECT DISTINCT replace(lower(tag), '_', ' ') AS w FROM (SELECT tag FROM utags UNION ALL SELECT unnest([{', '.join(f"'{w}'" for w in _KNOWN)}]))),
t AS (SELECT id, coalesce({_READ.replace('STRING', 'VARCHAR')}, '') AS t FROM items),
p AS (SELECT id, t, list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(t, '<[^<>]*>', ' ', 'g'), ':\\s*-?[0-9.]+\\s*\\)|[()\\[\\]{{}}]', ' ', 'g')), ','), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS k, len(list_filter([{', '.join(f"'{w}'" for w in records.NEGATIVE_WORDS)}], lambda w: contains(lower(t), w))) >= 3 AS negative, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS words FROM t),
m AS (SELECT id, negative, len(k) AS n, list_sum(list_transform(k, lambda x: length(x))) / len(k) AS mean, CASE WHEN len(k) >= 5 THEN 0.5 WHEN len(k) >= 3 THEN 0.42 WHEN words >= 8 THEN 0.4 END AS base FROM p),
h AS (SELECT id, count(w) / count(*) AS share FROM (SELECT id, replace(unnest(k), '_', ' ') AS x FROM p) LEFT JOIN known ON w = x GROUP BY 1),
r AS (SELECT id, negative, coalesce(share, 0) AS share, CASE WHEN n = 0 THEN 0.0 WHEN base IS NULL THEN 0.1 WHEN NOT mean BETWEEN 2 AND 60 THEN 0.15 ELSE least(0.55, base + least(0.05, n * 0.005)) END AS shape FROM m LEFT JOIN h USING (id))"""


def _assembled(spark, sf):
    """The training caption of every item that has tags, from its own."""
    of = lambda category, n: F.transform(F.sort_array(F.collect_set(F.when(F.col("category") == category, F.col("tag")))), lambda t: t).alias(n)
    held = T(spark, sf).groupBy(F.col("item_id").alias("id")).agg(of("character", "c"), of("general", "g"))
    return held.join(I(spark, sf).select("id", "nl_caption"), "id").select("id", captions.assembled("brand a1", F.col("c"), F.col("g"), F.col("nl_caption")).alias("x"))


_ASSEMBLED = """SELECT id, concat_ws(', ', CASE WHEN len(y) > 0 THEN array_to_string(y, ', ') END, CASE WHEN trim(nl_caption) <> '' THEN trim(nl_caption) END) AS x FROM (SELECT id, nl_caption, CASE WHEN list_contains(l, 'brand a1') THEN l ELSE list_prepend('brand a1', l) END AS y FROM (SELECT item_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS l FROM (SELECT item_id, list_transform(list_concat(coalesce(list(DISTINCT tag ORDER BY tag) FILTER (category = 'character'), []), coalesce(list(DISTINCT tag ORDER BY tag) FILTER (category = 'general'), [])), lambda t: trim(replace(lower(t), '_', ' '))) AS k FROM utags GROUP BY 1)) JOIN items ON id = item_id)"""


def _tree(spark, sf):
    """A tree of folders with the captions of every item, written and listed again: bytes of each folder."""
    path = activity.scratch(spark, "tree")
    rows = I(spark, sf).select(F.regexp_extract("path", r"^/lib/(\d+/sub\d+)/", 1).alias("f"), F.coalesce("ai_caption", F.lit("none")).alias("value"))
    rows = rows.select(F.substring_index("f", "/", 1).alias("lib"), F.substring_index("f", "/", -1).alias("sub"), "value")
    rows.repartition("lib", "sub").write.partitionBy("lib", "sub").text(path)
    listed = readers.files(spark, path, "*.txt")
    folder = lambda c: F.regexp_extract("path", f"/{c}=([^/]*)/", 1)
    return listed.groupBy(folder("lib").alias("lib"), folder("sub").alias("sub")).agg(F.sum("size").alias("bytes"))


def _branching(spark, sf):
    """Hops in a graph of each part: every node feeds on two later ones and on one that may lie before it."""
    one = lambda k: f"'[\"' || CAST({k} AS STRING) || '\",0]'"
    node = f"""'"' || CAST(k AS STRING) || '":{{"class_type":"' || CASE WHEN k = 0 THEN 'KSampler' ELSE 'Node' END || '","inputs":{{"a":' || {one('2 * k + 1')} || ',"b":' || {one('2 * k + 2')} || ',"c":' || {one('(7 * k + p_partkey) % m')} || '}}}}'"""
    rows = dealt(C(spark, sf, "part").select("p_partkey"), "p_partkey").selectExpr("p_partkey", "p_partkey % 12 + 1 AS m")
    graph = F.expr("'{' || array_join(transform(sequence(0L, m - 1), k -> " + node + "), ',') || '}'")
    return rows.select("p_partkey", F.explode(records.upstream(graph)).alias("node", "hops"))


_BRANCHING = """WITH RECURSIVE p AS (SELECT p_partkey, p_partkey % 12 + 1 AS m FROM part),
edges AS MATERIALIZED (SELECT p_partkey, k, j FROM (SELECT p_partkey, m, k, unnest([2 * k + 1, 2 * k + 2, (7 * k + p_partkey) % m]) AS j FROM (SELECT *, unnest(range(m)) AS k FROM p)) WHERE j < m),
walk AS (SELECT p_partkey, CAST(0 AS BIGINT) AS node, 0 AS hops FROM p UNION SELECT w.p_partkey, e.j, w.hops + 1 FROM walk w JOIN edges e ON e.p_partkey = w.p_partkey AND e.k = w.node WHERE w.hops < 12)
SELECT p_partkey, CAST(node AS VARCHAR) AS node, min(hops) AS hops FROM walk GROUP BY 1, 2"""


def _scoped(spark, sf, members):
    """The nearest of a collection's members to an uploaded vector: the sum of two stored ones."""
    rows = C(spark, sf, "embeddings")
    two = {r["vec_id"]: r["embedding"] for r in rows.where("vec_id IN (3, 4)").select("vec_id", "embedding").collect()}
    query = [a + b for a, b in zip(two[3], two[4])]
    return vectors.nearest(rows.where("embedding IS NOT NULL"), query, -1.0, 15, scope=C(spark, sf, "events").where(members).select((F.col("user_id") % 400).alias("vec_id")))


_SCOPED = "WITH u AS (SELECT list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE + z[2]::DOUBLE) AS e FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id = 4), s AS (SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), e), 4) AS similarity FROM embeddings, u WHERE embedding IS NOT NULL AND vec_id IN (SELECT user_id % 400 FROM events WHERE {})) SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 15"
#: Evidence: captions, files that are there, where fields were read, and losers, in SQL of both engines.
_SAID = "CASE id % 9 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'a picture' END"
_SOURCE = "CASE WHEN pos = 1 AND item_id % 8 = 0 THEN 'workflow_widget_fallback' WHEN pos = 2 AND item_id % 6 = 0 THEN 'global_graph_fallback' WHEN pos = 3 AND item_id % 5 = 0 THEN 'txt' WHEN pos = 4 AND item_id % 4 = 0 THEN 'xmp' ELSE 'explicit_metadata' END"
_FIELD = "CASE pos WHEN 1 THEN 'prompt' WHEN 2 THEN 'checkpoint' WHEN 3 THEN 'loras' ELSE 'negative_prompt' END"


def _gathered(spark, sf):
    items, tags = I(spark, sf), ALL(spark, sf)
    losers = items.where("id % 40 BETWEEN 1 AND 3").select("id", (F.col("id") - F.col("id") % 40).alias("keeper"))
    return evidence.gathered(items, tags, items.selectExpr("id", f"{_SAID} AS caption"), items.where("id % 33 <> 5").select("path"), tags.selectExpr("item_id AS id", f"{_FIELD} AS field", f"{_SOURCE} AS source"), losers, ("brand_N9", "brand_R9", "brand_A9"), 0.92, 600, 2.0)


_GATHERED = f"""t AS (SELECT * FROM tags JOIN items ON id = item_id), sources AS (SELECT id, {_FIELD} AS field, {_SOURCE} AS source FROM t), l AS (SELECT id, id - id % 40 AS keeper FROM items WHERE id % 40 BETWEEN 1 AND 3),
found AS (SELECT id, 'file_missing' AS kind, 0 AS severity, path AS detail FROM items WHERE path NOT IN (SELECT path FROM items WHERE id % 33 <> 5)
UNION ALL SELECT id, 'image_unreadable', 0, NULL FROM items WHERE coalesce(is_readable, 1) = 0 UNION ALL SELECT id, 'empty_caption', 1, NULL FROM items WHERE trim(coalesce({_SAID}, '')) = ''
UNION ALL SELECT id, 'rating_conflict', 1, string_agg(DISTINCT tag, ',' ORDER BY tag) FROM t WHERE tag IN ('brand_N9', 'brand_R9', 'brand_A9') GROUP BY 1 HAVING count(DISTINCT tag) > 1
UNION ALL SELECT id, 'low_tag_confidence', 2, CAST(count(*) AS VARCHAR) FROM t WHERE confidence < 0.92 GROUP BY 1
UNION ALL SELECT id, 'metadata_provenance_risk', 1, string_agg(DISTINCT field, ',' ORDER BY field) FROM sources WHERE contains(source, 'fallback') GROUP BY 1
UNION ALL SELECT id, 'sidecar_metadata_dependency', 2, string_agg(DISTINCT field, ',' ORDER BY field) FROM sources WHERE source IN ('txt', 'json', 'xmp') GROUP BY 1
UNION ALL SELECT id, 'small_image', 2, width || 'x' || height FROM items WHERE least(width, height) < 600 UNION ALL SELECT id, 'low_aesthetic', 2, CAST(CAST(round(aesthetic_score * 100) AS BIGINT) AS VARCHAR) FROM items WHERE aesthetic_score < 2.0
UNION ALL SELECT id, 'duplicate_group', 2, CAST(keeper AS VARCHAR) FROM l UNION ALL SELECT DISTINCT keeper, 'duplicate_group', 2, CAST(keeper AS VARCHAR) FROM l WHERE keeper IN (SELECT id FROM items))"""
_HASH = "coalesce(CAST(sum(CAST('0x' || substr({h}, 1, 12) AS HUGEINT)) AS VARCHAR), '0') || '-' || coalesce(CAST(sum(CAST('0x' || substr({h}, 13, 12) AS HUGEINT)) AS VARCHAR), '0')"

#: Tags of every part that reach each kind of rule, in SQL of both engines.
_AFFIXES = ("from_{}", "{}_background", "{} hair", "holding_{}", "{}_print", "rating:{}", "score_{}", "@{}", "no_{}", "{}_request", "{}girl", "own_hands_{}", "{}_raised", "{}_skirt", "{}_(medium)", "{}_view", "closed {} mouth", "{}", "old {} sky")
AFFIXED = f"CASE p_partkey % {len(_AFFIXES)} " + " ".join(f"WHEN {k} THEN '" + a.replace("{}", "' || p_name || '") + "'" for k, a in enumerate(_AFFIXES)) + " END"


def _ladder(t: str) -> str:
    """The ladder's rules in SQL, one after the other."""
    texts = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    test = {"is": lambda ws: f"{t} IN ({texts(ws)})", "token": lambda ws: f"list_has_any(regexp_split_to_array({t}, '[_\\-\\s]+'), [{texts(ws)}])"}
    for kind, f in (("starts", "starts_with"), ("ends", "ends_with"), ("holds", "contains"), ("matches", "regexp_matches")):
        test[kind] = lambda ws, f=f: "(" + " OR ".join(f"{f}({t}, {texts([w])})" for w in ws) + ")"
    return "CASE " + " ".join(f"WHEN {test[kind](words)} THEN '{category}'" for category, kind, words in categories.LADDER) + " ELSE 'unknown' END"


_IN_TURN = f"{_BY_WORDS.replace(TAGGED, AFFIXED).rsplit('SELECT w.tag, b.word', 1)[0]} SELECT tag, CASE told WHEN 'rule' THEN rule WHEN 'none' THEN 'unknown' ELSE category END AS category, told AS by FROM (SELECT *, CASE WHEN word = array_to_string(ws, '_') THEN 'word' WHEN rule <> 'unknown' THEN 'rule' WHEN category IS NOT NULL THEN 'words' ELSE 'none' END AS told FROM (SELECT w.tag, w.ws, b.word AS word, b.category AS category, {_ladder('k')} AS rule FROM (SELECT *, replace(lower(trim(tag)), ' ', '_') AS k FROM w) w LEFT JOIN best USING (tag)))"

#: name -> (query, SQL); None where the index decides which rows are found
ENTRIES = {
    "j15_index_candidates": (_candidates, None),
    "j15_index_recall": (_recall, f"SELECT count(*) AS searches, CAST(sum(least({NEAREST}, n - 1)) AS BIGINT) AS neighbours, true AS reached FROM embeddings, (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL) WHERE vec_id % 50 = 0 AND embedding IS NOT NULL"),
    "j15_exact_beside": (_exact, f"WITH {_UNITS} SELECT query_id, id, round(s, 4) AS similarity, CAST(place AS INTEGER) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS place FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE place <= {NEAREST}"),
    "t01_two_phase": (_two_phase, "SELECT event_id, CASE WHEN event_id % 7 > 0 AND event_type <> 'signup' THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_id % 7 = 0 OR json_extract_string(props, '$.k') IS NULL THEN 'error' ELSE 'complete' END AS status FROM events"),
    "s24_written": (_written, f"@{_FILES} SELECT id, path, file, CASE WHEN coalesce(is_readable, 1) = 0 THEN 'unreadable' WHEN id % 10 = 0 THEN 'no_caption' ELSE 'ok' END AS state, CASE WHEN coalesce(is_readable, 1) > 0 AND id % 10 > 0 THEN sha256(caption) END AS digest, CASE WHEN coalesce(is_readable, 1) > 0 AND id % 10 > 0 THEN caption END AS caption FROM files JOIN items USING (id)"),
    "x47_drawn_tags": (_prompts, f"{_drawn_sql()} SELECT seed, category, tag, CAST(place AS INTEGER) AS place FROM {_LAST}"),
    "x47_prompts": (lambda s, d: draws.prompts(_prompts(s, d), ["quality", "character", "general", "rating"]), f"{_drawn_sql()} SELECT seed, string_agg(tag, ', ' ORDER BY list_position(['quality', 'character', 'general', 'rating'], category), place) AS prompt FROM {_LAST} GROUP BY 1"),
    "s12_built_records": (_built, _BUILT),
    "x21_built_generators": (lambda s, d: _built(s, d).groupBy("generator").agg(F.count("*").alias("n"), F.min("id").alias("first")), f"SELECT generator, count(*) AS n, min(id) AS first FROM ({_BUILT}) GROUP BY 1"),
    "x22_built_programs": (lambda s, d: _built(s, d).where("generator IN ('fooocus', 'swarmui', 'nai')"), f"SELECT * FROM ({_BUILT}) WHERE generator IN ('fooocus', 'swarmui', 'nai')"),
    "x42_built_answers": (_answers, "SELECT id, prose, tags, CASE WHEN id % 3 = 0 THEN tone || '|' || model ELSE tone || '|' || model || '|blue sky' END || CASE WHEN id % 3 = 0 THEN '|Seen from afar' ELSE '' END AS listed FROM (SELECT id, 'A ' || coalesce(generator, 'plain') || ' scene of ' || width || '.' AS prose, tone || ', ' || model || ', ' || CASE WHEN id % 3 = 0 THEN 'Seen from afar, and said so.' ELSE 'blue sky' END AS tags, tone, model FROM (SELECT *, 'tone ' || id % 7 AS tone, lower(coalesce(checkpoint, 'none')) AS model FROM items))"),
    "x51_built_references": (_references, _REFERENCES),
    "x61_built_params": (_parameters, f"SELECT * FROM ({_PARAMETERS}) WHERE value IS NOT NULL"),
    "x24_built_likeness": (_read_like, f"@{_LIKE} SELECT id, round(greatest(CASE WHEN share >= 0.4 THEN 0.6 + 0.4 * share ELSE share END, shape), 6) AS score, round(share, 6) AS share, negative FROM r WHERE (SELECT count(*) FROM utags) > 0"),
    "x53_built_captions": (_assembled, _ASSEMBLED),
    "s11_tree": (_tree, "SELECT split_part(path, '/', 3) AS lib, split_part(path, '/', 4) AS sub, CAST(sum(length(coalesce(ai_caption, 'none')) + 1) AS BIGINT) AS bytes FROM items GROUP BY 1, 2"),
    "x23_branching_graphs": (_branching, _BRANCHING),
    "j22_members_only": (lambda s, d: _scoped(s, d, "event_type = 'purchase'"), _SCOPED.format("event_type = 'purchase'")),
    "j22_empty_scope": (lambda s, d: _scoped(s, d, "event_type = 'none'"), _SCOPED.format("event_type = 'none'")),
    "a27_evidence": (_gathered, f"@{_GATHERED} SELECT * FROM found"),
    "a27_evidence_page": (lambda s, d: review.review_page(_gathered(s, d), 60, (1, "empty_caption", 400)), f"@{_GATHERED} SELECT * FROM found WHERE (severity, kind, id) > (1, 'empty_caption', 400) ORDER BY severity, kind, id LIMIT 60"),
    "a46_readiness_report": (lambda s, d: evidence.report(I(s, d), _gathered(s, d)), f"@{_GATHERED} SELECT (SELECT count(*) FROM items) AS items, (SELECT {_HASH.format(h='md5(CAST(id AS VARCHAR))')} FROM items) AS scope_hash, count(*) AS evidence, count(*) FILTER (severity = 0) AS blockers, {_HASH.format(h='h')} AS input_hash, (SELECT count(*) FROM items WHERE id NOT IN (SELECT id FROM found WHERE severity = 0)) AS ready FROM (SELECT *, md5(concat_ws('|', CAST(id AS VARCHAR), kind, CAST(severity AS VARCHAR), coalesce(detail, '-'))) AS h FROM found)"),
    "x60_whole_records": (lambda s, d: pictures.records(_pixels(s, d)), _RECORDS),
    "x08_in_turn": (lambda s, d: categories.in_turn(C(s, d, "part").selectExpr(f"{AFFIXED} AS tag"), _words(s, d)), _IN_TURN),
    "x08_by_words": (lambda s, d: categories.by_words(C(s, d, "part").selectExpr(f"{TAGGED} AS tag"), _words(s, d)), _BY_WORDS),
}


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    from .record_queries import _whole

    return {name: _whole(sql) for name, (_, sql) in ENTRIES.items() if sql}
