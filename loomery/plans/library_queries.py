"""Lookups, joins, orders, upkeep and captions as queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import captions, colors, text
from loomery.operators import facets, filters, library, paging, scores, sessions, vectors
from loomery.sources import readers

from . import catalog
from .facet_queries import SEVERITY
from .filter_queries import BUSY, BUSY_SQL, ORDERED
from .filter_queries import library as filtered

C, I, T, S, ALL = catalog.table, catalog.items, catalog.unique_tags, catalog.scores, catalog.tags
RULES = [
    {"conditions": [("brand N1", "present"), ("r2", "absent")], "targets": ["Old Look"]},
    {"conditions": [("a1", "present")], "targets": ["new_look", "old look"]},
]
OVERRIDES = [("BRAND_N1", "mine"), ("brand_a2", "mine")]


def _files(frame):
    """Items as files: path, size and time."""
    return frame.select("path", F.col("file_size").alias("size"), F.unix_timestamp("created_at").alias("seconds"), "id")


def _listing(spark, sf):
    """What a new scan lists: every fourth item's file is gone, every fifth is of another size."""
    return I(spark, sf).where("id % 4 > 0").select(F.col("id").cast("string").alias("path"), (F.col("file_size") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("size"), F.col("created_at").alias("modified"))


def _index(spark, sf):
    return I(spark, sf).select(F.col("id").cast("string").alias("path"), F.col("file_size").alias("size"), F.col("created_at").alias("modified"))


def _lost(spark, sf):
    p = C(spark, sf, "part")
    return p.selectExpr("p_partkey AS id", "'f' || CAST(p_partkey % 400 AS STRING) AS name", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 3 END AS size", "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_partkey % 400 END AS seconds", "CASE WHEN p_partkey % 6 = 0 THEN 'p' || CAST(p_partkey AS STRING) END AS fingerprint")


def _found(spark, sf):
    p = C(spark, sf, "part").where("p_partkey % 3 > 0")
    return p.selectExpr("'/new/' || CAST(p_partkey AS STRING) AS path", "'f' || CAST(p_partkey % 400 AS STRING) AS name", "p_partkey % 3 AS size", "p_partkey % 400 + p_partkey % 5 AS seconds", "CASE WHEN p_partkey % 4 = 0 THEN 'p' || CAST(p_partkey AS STRING) END AS fingerprint")


_LOST = "lost AS (SELECT p_partkey AS id, 'f' || p_partkey % 400 AS name, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 3 END AS size, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 400 END AS seconds, CASE WHEN p_partkey % 6 = 0 THEN 'p' || p_partkey END AS fingerprint FROM part)"
_FOUND = "found AS (SELECT '/new/' || p_partkey AS path, 'f' || p_partkey % 400 AS name, p_partkey % 3 AS size, p_partkey % 400 + p_partkey % 5 AS seconds, CASE WHEN p_partkey % 4 = 0 THEN 'p' || p_partkey END AS fingerprint FROM part WHERE p_partkey % 3 > 0)"
_RECONNECT = f"""WITH {_LOST}, {_FOUND}, c AS (SELECT f.path, l.id, coalesce(abs(f.seconds - l.seconds) <= 2, false) AS st, coalesce(f.fingerprint = l.fingerprint, false) AS fp, l.id IS NOT NULL AND l.seconds IS NULL AND l.fingerprint IS NULL AS bare FROM found f LEFT JOIN lost l ON f.name = l.name AND (l.size IS NULL OR l.size = f.size)),
g AS (SELECT path, list(id) FILTER (st) AS a, list(id) FILTER (fp AND NOT st) AS b, list(id) FILTER (bare AND NOT st) AS n FROM c GROUP BY 1),
t AS (SELECT path, CASE WHEN len(a) = 1 THEN 'stat' WHEN len(a) > 1 THEN 'ambiguous' WHEN len(b) = 1 THEN 'fingerprint' WHEN len(b) > 1 THEN 'ambiguous' WHEN len(n) = 1 THEN 'name_size' WHEN len(n) > 1 THEN 'ambiguous' ELSE 'none' END AS how, CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) > 1 THEN NULL WHEN len(b) = 1 THEN b[1] WHEN len(b) > 1 THEN NULL WHEN len(n) = 1 THEN n[1] END AS id FROM g),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS k FROM t)"""


def _events(spark, sf):
    return C(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS path", "event_id AS moment", "CASE WHEN event_type IN ('view', 'click') THEN 'pending' WHEN event_type = 'purchase' THEN 'parsed' END AS kind", "event_id % 50 AS size").where("kind IS NOT NULL")


_EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS moment, CASE WHEN event_type IN ('view', 'click') THEN 'pending' WHEN event_type = 'purchase' THEN 'parsed' END AS kind, event_id % 50 AS size FROM events WHERE event_type IN ('view', 'click', 'purchase'))"


def _revisions(spark, sf):
    return C(spark, sf, "lineitem").selectExpr("l_orderkey AS subject", "l_linenumber AS generation", "l_returnflag || CAST(l_partkey AS STRING) AS content").groupBy("subject", "generation").agg(F.min("content").alias("content"))


_REVISIONS = "rev AS (SELECT l_orderkey AS subject, l_linenumber AS generation, min(l_returnflag || CAST(l_partkey AS VARCHAR)) AS content FROM lineitem GROUP BY 1, 2)"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _near(spark, sf, k, scope=None):
    rows = C(spark, sf, "embeddings")
    query = rows.where("vec_id = 1").select("embedding").first()["embedding"]
    rows = rows.where(scope) if scope else rows
    return vectors.nearest(rows, query, -1.0, k, exclude=1).withColumn("similarity", F.round("similarity", 4))


def _nearest_sql(k, scope="true"):
    cos = _COS.format(a="e.embedding", b="q.embedding")
    return f"SELECT vec_id, round({cos}, 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.vec_id <> 1 AND {scope} ORDER BY similarity DESC, vec_id LIMIT {k}"


def _scored(spark, sf):
    return scores.rethreshold(S(spark, sf), 0.5, 0.5, 0.5, keys=("item_id", "model"))


def _pages(spark, sf):
    """Groups of duplicate names by size: the second page of ten."""
    return facets.duplicate_names(I(spark, sf)).orderBy(F.desc("n"), F.lower("filename")).offset(10).limit(10).select("filename", "n")


def _cursors(spark, sf):
    """The cursor of every item's place in the order of time, and what is read back from it; by turns
    the cursor is whole, a bare number, cut short, or of another version."""
    key = F.date_format("order_time", "yyyy-MM-dd HH:mm:ss")
    whole = I(spark, sf).select("id", paging.cursors(F.col("id"), key).alias("cursor"))
    other = F.base64(F.encode(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"sort_value":null,"v":2}')), "utf-8"))
    turn = F.col("id") % 8
    given = F.when(turn == 5, F.col("id").cast("string")).when(turn == 6, F.substring("cursor", 1, 9)).when(turn == 7, other).otherwise(F.col("cursor"))
    return whole.withColumn("r", paging.read_cursors(given)).select("id", "cursor", F.col("r.id").alias("read_id"), F.col("r.sort_value").alias("read_value"))


def _vocabulary(spark, sf):
    """Tags set by hand at least as often as the average one."""
    counts = ALL(spark, sf).where("source = 'manual'").groupBy(F.lower("tag").alias("low")).agg(F.count("*").alias("held"))
    return counts.join(F.broadcast(counts.agg(F.avg("held").alias("average")))).where("held >= average").select("low")  # one row is sent


def _bundle(spark, sf):
    """Totals and facets as one table of names and counts."""
    items = I(spark, sf)
    row = lambda name, frame: frame.select(F.lit(name).alias("kind"), "value", "n")
    by = lambda c: items.groupBy(F.coalesce(c, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    total = items.agg(F.count("*").alias("n")).select(F.lit("all").alias("value"), "n")
    return row("total", total).unionByName(row("generator", by("generator"))).unionByName(row("rating", by("ai_rating"))).unionByName(row("status", by("metadata_status")))


_BUNDLE = "SELECT 'total' AS kind, 'all' AS value, count(*) AS n FROM items" + "".join(f" UNION ALL SELECT '{k}', coalesce({c}, 'unknown'), count(*) FROM items GROUP BY 2" for k, c in (("generator", "generator"), ("rating", "ai_rating"), ("status", "metadata_status")))
_TRAITS_JSON = "'[{\"hex\":\"#' || substr('ff0000ffffff00ff000000ff202020', 1 + 6 * CAST(id % 5 AS INT), 6) || '\",\"pct\":' || CAST(id % 40 AS STRING) || '},{\"hex\":\"#ff0000\",\"pct\":30}]'"
_TEMPLATE = "{trigger}, {generator} , {rating},,  by {checkpoint}"

#: name -> (query, SQL)
CASES = {
    "s01_full_scan": (lambda s, d: I(s, d).select("id", "width", "height", "generator"), "SELECT id, width, height, generator FROM items"),
    "s04_by_path": (lambda s, d: library.by_path(I(s, d), "\\lib\\\\3\\sub1/Img_21.png").select("id", "path"), "SELECT id, path FROM items WHERE path = '/lib/3/sub1/Img_21.png'"),
    "s06_tags_of_item": (lambda s, d: library.tags_of(T(s, d), 1).select("tag", F.round("confidence", 6).alias("confidence")), "SELECT tag, round(confidence, 6) AS confidence FROM utags WHERE item_id = 1"),
    "s08_filtered_ids": (lambda s, d: filters.apply(filtered(s, d), BUSY).select("id"), f"SELECT id FROM items WHERE {BUSY_SQL}"),
    "s09_distinct_ids": (lambda s, d: ALL(s, d).where("confidence > 0.95").select("item_id").dropDuplicates(), "SELECT DISTINCT item_id FROM tags WHERE confidence > 0.95"),
    "s10_snapshot_ids": (lambda s, d: filters.apply(filtered(s, d), BUSY).agg(F.count("id").alias("n"), F.max("id").alias("newest"), F.bit_xor("id").alias("digest")), f"SELECT count(*) AS n, max(id) AS newest, bit_xor(id) AS digest FROM items WHERE {BUSY_SQL}"),
    "s13_unseen_files": (lambda s, d: readers.unseen(_listing(s, d), _index(s, d)).select("path", "size"), "SELECT CAST(id AS VARCHAR) AS path, file_size + 1 AS size FROM items WHERE id % 4 > 0 AND id % 5 = 0"),
    "s14_vanished_files": (lambda s, d: readers.vanished(_index(s, d), _listing(s, d), "1").select("path"), "SELECT CAST(id AS VARCHAR) AS path FROM items WHERE id % 4 = 0 AND starts_with(CAST(id AS VARCHAR), '1')"),
    "s20_import_tags": (
        lambda s, d: library.import_tags(I(s, d).unionByName(I(s, d).withColumn("id", F.col("id") + 100_000_000)).selectExpr("id", "CASE WHEN id % 2 = 0 THEN '/a/' ELSE '/b/' END || CAST(id AS STRING) || '.png' AS path"), ALL(s, d), I(s, d).where("id % 5 = 0").unionByName(I(s, d).where("id % 5 = 1").withColumn("id", F.col("id") + 100_000_000)).selectExpr("'/a/' || CAST(id AS STRING) || '.png' AS path", "explode(array('Fresh', 'fresh', 'new')) AS tag", "0.5D AS confidence")).groupBy("item_id").agg(F.count("*").alias("n"), F.max("tag").alias("last")),
        "WITH old AS (SELECT * FROM tags), given AS (SELECT id FROM items WHERE id % 5 = 0 UNION ALL SELECT id + 100000000 FROM items WHERE id % 5 = 1) SELECT item_id, count(*) AS n, max(tag) AS last FROM (SELECT item_id, tag FROM old UNION ALL SELECT id, unnest(['fresh', 'new']) FROM given WHERE id NOT IN (SELECT item_id FROM old)) GROUP BY 1",
    ),
    "s30_replace_rows": (
        lambda s, d: library.replace_rows(ALL(s, d), ALL(s, d).where("item_id % 2 = 0 AND pos = 1").select("item_id", F.upper("tag").alias("tag"), F.lit(0.5).alias("confidence"), F.lit("tagger").alias("source"))).groupBy("item_id").agg(F.count("*").alias("n"), F.min("tag").alias("first"), F.round(F.sum("confidence"), 6).alias("total")),
        "WITH f AS (SELECT item_id, upper(tag) AS tag, 0.5 AS confidence, 'tagger' AS source FROM tags WHERE item_id % 2 = 0 AND pos = 1), b AS (SELECT item_id, tag, confidence, source FROM tags WHERE source = 'manual' AND item_id IN (SELECT item_id FROM f) UNION ALL SELECT * FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(tag) ORDER BY source <> 'manual', confidence DESC, tag) AS r FROM b) SELECT item_id, count(*) AS n, min(tag) AS first, round(sum(confidence), 6) AS total FROM (SELECT item_id, tag, confidence FROM tags WHERE item_id NOT IN (SELECT item_id FROM f) UNION ALL SELECT item_id, tag, confidence FROM k WHERE r = 1) GROUP BY 1",
    ),
    "s36_score_purge": (lambda s, d: S(s, d).where("model <> 'model_O'").groupBy("model").agg(F.count("*").alias("n")), "SELECT model, count(*) AS n FROM scores WHERE model <> 'model_O' GROUP BY 1"),
    "s38_result_page": (lambda s, d: I(s, d).where("metadata_json IS NOT NULL").orderBy("id").offset(40).limit(20).select("id", F.get_json_object("metadata_json", "$.seed").alias("seed")), "SELECT id, CASE WHEN id % 10 NOT IN (1, 3) THEN CAST(id % 50 AS VARCHAR) END AS seed FROM items WHERE metadata_json IS NOT NULL ORDER BY id LIMIT 20 OFFSET 40"),
    "s39_sidecar_tags": (lambda s, d: library.sidecar_tags(I(s, d).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'A, b' || chr(10) || 'a,, c' WHEN id % 3 = 1 THEN prompt END AS caption")).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), "|").alias("tags")), "SELECT id, CASE WHEN id % 3 = 0 THEN 'A|b|c' ELSE array_to_string(list_filter(list_transform(string_split(prompt, ','), lambda t: trim(t)), lambda t: t <> ''), '|') END AS tags FROM items WHERE id % 3 = 0 OR (id % 3 = 1 AND trim(coalesce(prompt, '')) <> '')"),
    "s42_mark_unreadable": (lambda s, d: library.mark_unreadable(I(s, d).select("id", "is_readable", "metadata_status"), I(s, d).where("id % 5 = 0").select("id", F.lit("broken").alias("error"))), "SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE is_readable END AS is_readable, CASE WHEN id % 5 = 0 AND lower(metadata_status) = 'pending' THEN 'error' ELSE metadata_status END AS metadata_status, CASE WHEN id % 5 = 0 THEN 'broken' END AS error FROM items"),
    "s43_export_page": (lambda s, d: filters.apply(filtered(s, d), BUSY).select("id", "prompt").orderBy("id").offset(20).limit(50).join(facets.child_lists(T(s, d)), F.col("id") == F.col("item_id"), "left").select("id", "tags"), f"SELECT id, tags FROM (SELECT id FROM items WHERE {BUSY_SQL} ORDER BY id LIMIT 50 OFFSET 20) LEFT JOIN (SELECT item_id, string_agg(tag, '|' ORDER BY confidence DESC, tag) AS tags FROM utags GROUP BY 1) ON id = item_id"),
    "s44_export_preview": (lambda s, d: I(s, d).orderBy("id").limit(500).select("id", text.caption("trig", text.prompt_tokens(F.col("prompt")), F.col("nl_caption")).alias("x")), f"SELECT id, array_to_string(list_prepend('trig', {ORDERED}), ', ') || CASE WHEN nl_caption IS NULL THEN '' ELSE '. ' || nl_caption END AS x FROM (SELECT * FROM items ORDER BY id LIMIT 500)"),
    "f36_literal_marks": (lambda s, d: I(s, d).where(F.concat("filename", F.when(F.col("id") % 3 == 0, "_100%").otherwise("x100x")).contains("_100%")).select("id"), "SELECT id FROM items WHERE contains(filename || CASE WHEN id % 3 = 0 THEN '_100%' ELSE 'x100x' END, '_100%')"),
    "j01_inner": (lambda s, d: I(s, d).where("width > 1400").join(ALL(s, d), F.col("id") == F.col("item_id")).select("id", "tag", "pos"), "SELECT id, tag, pos FROM items JOIN tags ON id = item_id WHERE width > 1400"),
    "j02_division": (lambda s, d: T(s, d).where(F.lower("tag").isin("brand_n1", "brand_n2")).groupBy("item_id").agg(F.count_distinct(F.lower("tag")).alias("n")).where("n = 2").select("item_id"), "SELECT DISTINCT a.item_id FROM utags a JOIN utags b ON a.item_id = b.item_id WHERE lower(a.tag) = 'brand_n1' AND lower(b.tag) = 'brand_n2'"),
    "j03_semi": (lambda s, d: I(s, d).join(T(s, d).where("category = 'rating'").select(F.col("item_id").alias("id")), "id", "left_semi").select("id"), "SELECT id FROM items WHERE EXISTS (SELECT 1 FROM utags WHERE item_id = id AND category = 'rating')"),
    "j04_anti": (lambda s, d: I(s, d).join(T(s, d).where("category = 'rating'").select(F.col("item_id").alias("id")), "id", "left_anti").select("id"), "SELECT id FROM items WHERE NOT EXISTS (SELECT 1 FROM utags WHERE item_id = id AND category = 'rating')"),
    "j05_not_in": (lambda s, d: I(s, d).where(F.col("generator").isNull() | ~F.col("generator").isin("O", "P")).select("id"), "SELECT id FROM items WHERE generator IS NULL OR generator NOT IN ('O', 'P')"),
    "j06_left_counts": (lambda s, d: paging.with_tag_count(I(s, d), T(s, d)).select("id", "n_tags"), "SELECT id, coalesce(n, 0) AS n_tags FROM items LEFT JOIN (SELECT item_id, count(DISTINCT tag) AS n FROM utags GROUP BY 1) ON id = item_id"),
    "j08_library_counts": (lambda s, d: s.createDataFrame([("main",), ("second",), ("empty",)], "library string").join(I(s, d).groupBy(F.col("library_id").alias("library")).agg(F.count("*").alias("n")), "library", "left").select("library", F.coalesce("n", F.lit(0)).alias("n")), "SELECT library, (SELECT count(*) FROM items WHERE library_id = library) AS n FROM (VALUES ('main'), ('second'), ('empty')) v(library)"),
    "j10_in_union": (lambda s, d: I(s, d).join(I(s, d).where("user_rating = 5").select("id").union(ALL(s, d).where("confidence > 0.99").select("item_id")), "id", "left_semi").select("id"), "SELECT id FROM items WHERE id IN (SELECT id FROM items WHERE user_rating = 5 UNION SELECT item_id FROM tags WHERE confidence > 0.99)"),
    "j12_reconnect": (lambda s, d: library.reconnect(_lost(s, d), _found(s, d)).groupBy("how").agg(F.count("*").alias("n")), f"{_RECONNECT} SELECT how, count(*) AS n FROM (SELECT CASE WHEN id IS NOT NULL AND k > 1 THEN 'used' ELSE how END AS how FROM w) GROUP BY 1"),
    "j24_reconnect_driver": (lambda s, d: library.reconnect(_lost(s, d), _found(s, d)).where("id IS NOT NULL"), f"{_RECONNECT} SELECT path, how, id FROM w WHERE id IS NOT NULL AND k = 1"),
    "j15_top_k": (lambda s, d: _near(s, d, 12), _nearest_sql(12)),
    "j17_resolve_folder": (lambda s, d: library.resolve_folder(I(s, d), C(s, d, "part").where("p_partkey <= 40").selectExpr("'IMG_' || CAST(p_partkey AS STRING) || '.png' AS name")), "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(DISTINCT lower(filename)) AS votes FROM items WHERE lower(filename) IN (SELECT 'img_' || p_partkey || '.png' FROM part WHERE p_partkey <= 40) GROUP BY 1"),
    "j21_pair_cosine": (lambda s, d: vectors.pair_cosine(C(s, d, "embeddings"), 1, 2), f"SELECT round({_COS.format(a='a.embedding', b='b.embedding')}, 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id = 2"),
    "j22_scoped_nearest": (lambda s, d: _near(s, d, 10, "label IN (1, 2, 3)"), _nearest_sql(10, "label IN (1, 2, 3)")),
    "j25_revision_heads": (lambda s, d: library.heads(_revisions(s, d), 100, 60), f"WITH {_REVISIONS} SELECT subject, max(generation) AS generation, arg_max(content, generation) AS content FROM rev WHERE subject > 100 GROUP BY 1 ORDER BY 1 LIMIT 60"),
    "a16_stats_bundle": (_bundle, _BUNDLE),
    "a19_artist_stats": (lambda s, d: S(s, d).where("category = 'character' AND score >= 0.3").groupBy(F.col("tag").alias("artist")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("decimal(20,8)")).cast("double") / F.count("*"), 4).alias("mean"), F.max("score").alias("highest")), "SELECT tag AS artist, count(*) AS n, round(sum(score::DECIMAL(20,8))::DOUBLE / count(*), 4) AS mean, max(score) AS highest FROM scores WHERE category = 'character' AND score >= 0.3 GROUP BY 1"),
    "a28_ratings": (lambda s, d: scores.rating_verdict(S(s, d)), "SELECT item_id, arg_min(tag, (-score, model, tag)) AS rating, max(score) AS score FROM scores WHERE category = 'rating' GROUP BY 1"),
    "a31_consensus_rethreshold": (lambda s, d: scores.consensus(_scored(s, d), {"model_F": 1.0}, 2).groupBy("category").agg(F.count("*").alias("n"), F.sum("votes").alias("votes")), "SELECT category, count(*) AS n, CAST(sum(v) AS BIGINT) AS votes FROM (SELECT item_id, lower(tag) AS t, count(*) AS v, arg_min(category, (model <> 'model_F', model, list_position(['general', 'copyright', 'character'], category))) AS category FROM scores WHERE category <> 'rating' AND score >= 0.5 GROUP BY 1, 2) WHERE v >= 2 OR category IN ('character', 'copyright') GROUP BY 1"),
    "a32_run_stats": (lambda s, d: T(s, d).agg(F.count("*").alias("tags"), F.count_distinct("item_id").alias("items")).select("tags", "items", F.round(F.col("tags") / F.col("items"), 2).alias("per_item")), "SELECT count(*) AS tags, count(DISTINCT item_id) AS items, round(count(*) / count(DISTINCT item_id), 2) AS per_item FROM utags"),
    "a41_projects": (lambda s, d: C(s, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("project")).join(C(s, d, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey", (F.col("o_orderkey") % 7 == 0).alias("gone")), "project", "left").groupBy("project").agg(F.count("o_orderkey").alias("items"), F.count_if("gone").alias("missing")), "SELECT c_custkey AS project, count(o_orderkey) AS items, count(*) FILTER (o_orderkey % 7 = 0) AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey < 20 GROUP BY 1"),
    "a42_rating_duplicates": (lambda s, d: library.rating_duplicates(ALL(s, d), SEVERITY[::-1]).groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("tag").isin(*SEVERITY), F.col("tag"))).alias("rating")), f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, list_position({SEVERITY[::-1]}, tag) DESC, pos) AS k FROM tags WHERE tag IN {tuple(SEVERITY)}) SELECT item_id, count(*) AS n, max(rating) AS rating FROM (SELECT item_id, NULL AS rating FROM tags WHERE tag NOT IN {tuple(SEVERITY)} UNION ALL SELECT item_id, tag FROM r WHERE k = 1) GROUP BY 1"),
    "a43_category_pools": (lambda s, d: library.category_pools(T(s, d).groupBy("tag").agg(F.count("*").alias("n"), F.min("category").alias("category")), 2, 4).select("category", "tag", "n", "place"), "SELECT category, tag, n, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, tag) AS place FROM (SELECT tag, count(*) AS n, min(category) AS category FROM utags GROUP BY 1) WHERE n >= 2) WHERE place <= 4"),
    "a44_overrides": (lambda s, d: library.with_overrides(T(s, d).groupBy("tag").agg(F.min("category").alias("own")), F.col("own"), s.createDataFrame(OVERRIDES, "tag string, category string")).select("tag", "category"), "SELECT tag, CASE WHEN lower(tag) IN ('brand_n1', 'brand_a2') THEN 'mine' ELSE min(category) END AS category FROM utags GROUP BY 1"),
    "w01_best_row": (lambda s, d: ALL(s, d).groupBy("item_id").agg(F.min_by("tag", F.struct((-F.col("confidence")).alias("c"), "tag")).alias("tag")), "SELECT item_id, arg_min(tag, (-confidence, tag)) AS tag FROM tags GROUP BY 1"),
    "w02_top_per_group": (lambda s, d: facets.top_per_group(I(s, d), "generator", "checkpoint", 3).where("generator IS NOT NULL AND checkpoint IS NOT NULL"), "SELECT generator, checkpoint, n, place FROM (SELECT generator, checkpoint, count(*) AS n, row_number() OVER (PARTITION BY generator ORDER BY count(*) DESC, checkpoint NULLS FIRST) AS place FROM items GROUP BY 1, 2) WHERE place <= 3 AND generator IS NOT NULL AND checkpoint IS NOT NULL"),
    "w04_relevance": (lambda s, d: T(s, d).select("tag").distinct().select("tag", facets.relevance(F.col("tag"), "n1").alias("bucket")).where("bucket IS NOT NULL"), "SELECT DISTINCT tag, CASE WHEN lower(tag) = 'n1' THEN 0 WHEN starts_with(lower(tag), 'n1') THEN 1 WHEN contains(lower(tag), '_n1') THEN 2 ELSE 3 END AS bucket FROM utags WHERE contains(lower(tag), 'n1')"),
    "w06_streaks": (lambda s, d: facets.streaks(C(s, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.to_date("ts").alias("day"))).select("key", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), "days"), "SELECT key, strftime(min(day), '%Y-%m-%d') AS first_day, count(*) AS days FROM (SELECT key, day, day - CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT user_id || '/' || event_type AS key, CAST(ts AS DATE) AS day FROM events)) GROUP BY key, g"),
    "w10_brackets": (
        lambda s, d: sessions.brackets(C(s, d, "events").selectExpr("user_id AS session", "event_id AS seq", "CASE event_type WHEN 'click' THEN 'challenger' WHEN 'view' THEN 'champion' WHEN 'signup' THEN 'skip' WHEN 'error' THEN 'undo' ELSE 'redo' END AS action", "CAST(20 + user_id % 30 AS INT) AS total")),
        """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS a, 20 + user_id % 30 AS total FROM events),
w AS (SELECT s, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS champ, CAST(1 AS BIGINT) AS chal, CAST([] AS BIGINT[]) AS hist, CAST([] AS BIGINT[]) AS redo FROM (SELECT DISTINCT s FROM e)
  UNION ALL SELECT w.s, w.n + 1, CASE WHEN u THEN hist[-1] WHEN r THEN redo[-1] WHEN f AND a = 'click' THEN chal ELSE champ END, chal + CASE WHEN u THEN -1 WHEN r OR f THEN 1 ELSE 0 END,
    CASE WHEN u THEN hist[:-2] WHEN r OR f THEN list_append(hist, champ) ELSE hist END, CASE WHEN u THEN list_append(redo, champ) WHEN r THEN redo[:-2] WHEN f THEN [] ELSE redo END
  FROM (SELECT w.*, e.a, e.a = 'error' AND len(hist) > 0 AS u, e.a = 'purchase' AND len(redo) > 0 AS r, e.a IN ('click', 'view', 'signup') AND chal < e.total AS f FROM w JOIN e ON e.s = w.s AND e.n = w.n + 1) w)
SELECT s AS session, CAST(champ AS INTEGER) AS champion, CAST(chal AS INTEGER) AS challenger, chal >= 20 + s % 30 AS done, CAST(len(hist) AS INTEGER) AS undoable, CAST(len(redo) AS INTEGER) AS redoable FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC) = 1""",
    ),
    "w10_last_decisions": (lambda s, d: library.last_decisions(C(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"))), "SELECT user_id AS id, arg_max(event_type, event_id) AS action FROM events GROUP BY 1"),
    "o05_random_order": (lambda s, d: I(s, d).orderBy(*paging.order("random")).limit(25).select("id"), "SELECT id FROM items ORDER BY (id * 1103515245 + 12345) & 2147483647, id LIMIT 25"),
    "o07_cursor": (_cursors, """WITH c AS (SELECT id, strftime(order_time, '%Y-%m-%d %H:%M:%S') AS k FROM items) SELECT id, rtrim(translate(base64(encode('{"id":' || id || ',"sort_value":' || coalesce('"' || k || '"', 'null') || ',"v":1}')), '+/', '-_'), '=') AS cursor, CASE WHEN id % 8 < 6 THEN id END AS read_id, CASE WHEN id % 8 < 5 THEN k END AS read_value FROM c"""),
    "o10_group_page": (_pages, "SELECT min(filename) AS filename, count(*) AS n FROM items GROUP BY lower(filename) HAVING count(*) > 1 ORDER BY n DESC, lower(min(filename)) LIMIT 10 OFFSET 10"),
    "o12_hero_pool": (lambda s, d: I(s, d).orderBy(F.desc(F.col("user_rating") == 5), F.desc("created_at"), F.desc("id")).limit(24).select("id"), "SELECT id FROM items ORDER BY user_rating = 5 DESC, created_at DESC, id DESC LIMIT 24"),
    "u01_union_all": (lambda s, d: I(s, d).where("user_rating = 5").select("id").unionByName(I(s, d).where("width > 1200").select("id")), "SELECT id FROM items WHERE user_rating = 5 UNION ALL SELECT id FROM items WHERE width > 1200"),
    "u05_membership": (
        lambda s, d: library.membership(library.membership(I(s, d).where("user_rating = 5").select((F.col("id") % 3).alias("collection"), "id"), I(s, d).where("width > 1400").select("id"), 1), I(s, d).where("height > 1200").select("id"), 1, add=False),
        "SELECT id % 3 AS collection, id FROM items WHERE user_rating = 5 AND NOT (id % 3 = 1 AND height > 1200) UNION SELECT 1, id FROM items WHERE width > 1400 AND height <= 1200",
    ),
    "x03_lora_name": (lambda s, d: C(s, d, "part").select("p_partkey", text.lora_name(F.concat(F.lit("Styles\\My/"), F.col("p_name"), F.lit(".SafeTensors:0.75"))).alias("x")), "SELECT p_partkey, lower(p_name) AS x FROM part"),
    "x07_prefix": (lambda s, d: I(s, d).where(F.col("path").startswith("/lib/1")).select("id"), "SELECT id FROM items WHERE path >= '/lib/1' AND path < '/lib/2'"),
    "x11_dominant_names": (lambda s, d: I(s, d).selectExpr("id", f"{_TRAITS_JSON} AS c").select("id", colors.dominant_names(F.col("c")).alias("x")), "SELECT id, CASE WHEN id % 40 < 15 OR id % 5 = 0 THEN ',red,' ELSE ',' || ['white', 'green', 'blue', 'black'][id % 5] || ',red,' END AS x FROM items"),
    "x13_brightness_shape": (lambda s, d: colors.brightness_shape(C(s, d, "lineitem").selectExpr("l_suppkey AS key", "CAST((CASE l_suppkey % 4 WHEN 0 THEN l_partkey % 64 WHEN 1 THEN 200 + l_partkey % 56 WHEN 2 THEN 70 + l_partkey % 100 ELSE (l_partkey % 2) * 240 END) AS INT) AS level"), "key", "level").select("key", "n", F.round("skew", 4).alias("skew"), "shape"), "SELECT key, count(*) AS n, round(CASE WHEN stddev_pop(level) > 0 THEN avg(pow(level - m, 3)) / pow(stddev_pop(level), 3) ELSE 0 END, 4) AS skew, CASE WHEN avg(CASE WHEN level < 32 THEN 1 ELSE 0 END) > 0.2 AND avg(CASE WHEN level >= 224 THEN 1 ELSE 0 END) > 0.2 AND avg(CASE WHEN level < 32 OR level >= 224 THEN 1 ELSE 0 END) > 0.5 THEN 'edge_heavy' WHEN avg(CASE WHEN level < 64 THEN 1 ELSE 0 END) > 0.5 THEN 'left_heavy' WHEN avg(CASE WHEN level >= 192 THEN 1 ELSE 0 END) > 0.5 THEN 'right_heavy' WHEN avg(CASE WHEN level >= 64 AND level < 192 THEN 1 ELSE 0 END) > 0.5 THEN 'middle_heavy' ELSE 'balanced' END AS shape FROM (SELECT *, avg(level) OVER (PARTITION BY key) AS m FROM (SELECT l_suppkey AS key, CASE l_suppkey % 4 WHEN 0 THEN l_partkey % 64 WHEN 1 THEN 200 + l_partkey % 56 WHEN 2 THEN 70 + l_partkey % 100 ELSE (l_partkey % 2) * 240 END AS level FROM lineitem)) GROUP BY 1"),
    "x19_fingerprint": (lambda s, d: C(s, d, "documents").select("doc_id", F.sha2(F.concat_ws(":", F.char_length("text").cast("string"), "text").cast("binary"), 256).alias("x")), "SELECT doc_id, sha256(concat_ws(':', CAST(length(text) AS VARCHAR), text)) AS x FROM documents"),
    "x25_compact_json": (lambda s, d: I(s, d).select("id", F.to_json(F.struct(F.get_json_object("metadata_json", "$.seed").alias("seed"))).alias("x")), "SELECT id, CASE WHEN metadata_json IS NULL OR id % 10 IN (1, 3) THEN '{}' ELSE '{\"seed\":\"' || (id % 50) || '\"}' END AS x FROM items"),
    "x26_generation_params": (lambda s, d: I(s, d).select("id", F.coalesce(F.get_json_object("metadata_json", "$.seed"), F.get_json_object("metadata_json", "$.noise_seed")).alias("seed"), F.col("checkpoint").alias("model"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("size")), "SELECT id, CASE WHEN id % 10 NOT IN (1, 2) THEN CAST(id % 50 AS VARCHAR) END AS seed, checkpoint AS model, width || 'x' || height AS size FROM items"),
    "x27_parameters_text": (lambda s, d: I(s, d).select("id", captions.parameters_text(F.col("prompt"), F.when(F.col("id") % 4 == 0, "blurry"), {"Model": F.col("checkpoint"), "Size": F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))}).alias("x")), "SELECT id, concat_ws(chr(10), CASE WHEN trim(coalesce(prompt, '')) <> '' THEN trim(prompt) END, CASE WHEN id % 4 = 0 THEN 'Negative prompt: blurry' END, concat_ws(', ', 'Model: ' || checkpoint, 'Size: ' || width || 'x' || height)) AS x FROM items"),
    "x30_template": (lambda s, d: I(s, d).select("id", captions.rendered(_TEMPLATE, {"trigger": F.lit("trig"), "generator": F.col("generator"), "rating": F.col("ai_rating"), "checkpoint": F.col("checkpoint")}).alias("x")), "SELECT id, concat_ws(', ', 'trig', generator, ai_rating, trim('by ' || coalesce(checkpoint, ''))) AS x FROM items"),
    "x32_rating_words": (lambda s, d: C(s, d, "part").select("p_partkey", captions.rating_word(F.element_at(F.array(*(F.lit(w) for w in ("G", "rating:safe", "Rating: explicit", "q", "smile"))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("x")), "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'general' WHEN 1 THEN 'general' WHEN 2 THEN 'explicit' WHEN 3 THEN 'questionable' END AS x FROM part"),
    "x34_transforms": (lambda s, d: I(s, d).select("id", captions.transformed(F.concat(F.lit("Solo, blue_eyes,solo, , look"), (F.col("id") % 3).cast("string")), ["Blue Eyes", "look2"], ["trig", "SOLO"], ["end"]).alias("x")), "SELECT id, 'trig, SOLO' || CASE WHEN id % 3 = 2 THEN '' ELSE ', look' || (id % 3) END || ', end' AS x FROM items"),
    "x36_with_prose": (lambda s, d: I(s, d).select("id", captions.with_prose(F.col("generator"), "both", F.concat("nl_caption", F.lit("\n  more"))).alias("both"), captions.with_prose(F.col("generator"), "nl", F.col("nl_caption")).alias("nl")), "SELECT id, concat_ws(', ', generator, CASE WHEN nl_caption IS NOT NULL THEN nl_caption || ' more' END) AS both, coalesce(nl_caption, generator, '') AS nl FROM items"),
    "x38_training_purpose": (lambda s, d: T(s, d).where("category <> 'character'").groupBy("item_id").agg(F.count("*").alias("n")), "SELECT item_id, count(*) AS n FROM utags WHERE category <> 'character' GROUP BY 1"),
    "x40_noise": (lambda s, d: C(s, d, "part").select("p_partkey", captions.is_noise(F.element_at(F.array(*(F.lit(w) for w in ("Score_9_up", "year 2024", "smile", " ", "Best_Quality", "2019", "^_^", "score up"))), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("x")), "SELECT p_partkey, p_partkey % 8 IN (0, 1, 3, 4, 5) AS x FROM part"),
    "x54_noise_filter": (lambda s, d: I(s, d).select("id", captions.without_noise(F.array(F.lit("smile"), F.lit("score_7"), F.when(F.col("id") % 2 == 0, "highres").otherwise("hat"))).alias("f")).select("id", F.array_join("f.kept", ",").alias("kept"), "f.stripped"), "SELECT id, CASE WHEN id % 2 = 0 THEN 'smile' ELSE 'smile,hat' END AS kept, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS stripped FROM items"),
    "x41_vocabulary_gate": (lambda s, d: T(s, d).where("category <> 'rating'").join(_vocabulary(s, d), F.lower("tag") == F.col("low"), "left_semi").groupBy("item_id").agg(F.count_distinct(F.lower("tag")).alias("n")), "SELECT item_id, count(DISTINCT lower(tag)) AS n FROM utags WHERE category <> 'rating' AND lower(tag) IN (SELECT lower(tag) FROM tags WHERE source = 'manual' GROUP BY 1 HAVING count(*) >= (SELECT count(*) / count(DISTINCT lower(tag)) FROM tags WHERE source = 'manual')) GROUP BY 1"),
    "x43_file_names": (lambda s, d: I(s, d).select("id", captions.file_stem("{trigger}/{generator}_{index:04}", {"trigger": F.lit("trig"), "generator": F.col("generator")}, F.col("id")).alias("x")), "SELECT id, 'trig_' || coalesce(generator, '') || '_' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS x FROM items"),
    "x46_exclusions": (lambda s, d: library.exclusion_targets(T(s, d), RULES), "WITH h AS (SELECT item_id, list(lower(tag)) AS t FROM utags GROUP BY 1) SELECT DISTINCT item_id, target FROM (SELECT item_id, 'old_look' AS target FROM h WHERE len(list_filter(t, lambda x: contains(x, 'brand_n1'))) > 0 AND len(list_filter(t, lambda x: contains(x, 'r2'))) = 0 UNION ALL SELECT item_id, unnest(['new_look', 'old_look']) FROM h WHERE len(list_filter(t, lambda x: contains(x, 'a1'))) > 0)"),
    "x48_suggestions": (lambda s, d: library.suggestions(T(s, d).groupBy("tag").agg(F.count("*").alias("n")), C(s, d, "part").select(F.col("p_name").alias("tag"), F.lit(1).cast("long").alias("n")).distinct(), "brand_n", 15), "WITH b AS (SELECT trim(replace(lower(tag), '_', ' ')) AS tag, count(*) AS n, 0 AS base FROM utags GROUP BY tag UNION ALL SELECT DISTINCT trim(replace(lower(p_name), '_', ' ')), 1, 3 FROM part), r AS (SELECT tag, n, base + CASE WHEN tag = 'brand n' THEN 0 WHEN starts_with(tag, 'brand n') THEN 1 ELSE 2 END AS bucket FROM b WHERE contains(tag, 'brand n')) SELECT tag, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY bucket, n DESC) AS k FROM r) WHERE k = 1 ORDER BY bucket, n DESC, tag LIMIT 15"),
    "x49_tag_info": (lambda s, d: T(s, d).where(F.lower("tag") == "brand_n1").agg(F.count("*").alias("uses"), F.count_distinct("item_id").alias("items"), F.count_distinct("tag").alias("spellings"), F.max("category").alias("category")), "SELECT count(*) AS uses, count(DISTINCT item_id) AS items, count(DISTINCT tag) AS spellings, max(category) AS category FROM utags WHERE lower(tag) = 'brand_n1'"),
    "x50_percent": (lambda s, d: I(s, d).groupBy("library_id").agg(F.count("*").alias("n"), F.count("prompt").alias("p")).select("library_id", facets.percent(F.col("p"), F.col("n")).alias("x")), "SELECT library_id, round(100.0 * count(prompt) / count(*), 2) AS x FROM items GROUP BY 1"),
    "x56_suppression": (lambda s, d: T(s, d).groupBy("item_id").agg(F.sort_array(F.collect_set(F.lower("tag"))).alias("t")).select("item_id", captions.suppression(F.col("t")).alias("x")), "SELECT item_id, 'Never mention: ' || string_agg(DISTINCT replace(lower(tag), '_', ' '), ', ' ORDER BY replace(lower(tag), '_', ' ')) || '.' AS x FROM utags GROUP BY 1"),
    "x59_upright_size": (lambda s, d: I(s, d).select("id", captions.upright_size(F.col("width"), F.col("height"), F.col("id") % 10).alias("u")).select("id", F.col("u.width").cast("long").alias("w"), F.col("u.height").cast("long").alias("h")), "SELECT id, CASE WHEN id % 10 BETWEEN 5 AND 8 THEN height WHEN id % 10 BETWEEN 1 AND 4 THEN width END AS w, CASE WHEN id % 10 BETWEEN 5 AND 8 THEN width WHEN id % 10 BETWEEN 1 AND 4 THEN height END AS h FROM items"),
    "b09_move_library": (lambda s, d: I(s, d).withColumn("library_id", F.when(F.col("id") % 6 == 0, "third").otherwise(F.col("library_id"))).groupBy("library_id").agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 6 = 0 THEN 'third' ELSE library_id END AS library_id, count(*) AS n FROM items GROUP BY 1"),
    "b10_append_revisions": (lambda s, d: library.append_revisions(_revisions(s, d), C(s, d, "orders").selectExpr("o_orderkey AS subject", "o_orderkey % 5 AS expected", "o_orderstatus AS content")), f"WITH {_REVISIONS}, h AS (SELECT subject, max(generation) AS head FROM rev GROUP BY 1) SELECT o_orderkey AS subject, o_orderstatus AS content, CASE WHEN coalesce(head, 0) = o_orderkey % 5 THEN 'appended' ELSE 'conflict' END AS state, CASE WHEN coalesce(head, 0) = o_orderkey % 5 THEN coalesce(head, 0) + 1 END AS generation FROM orders LEFT JOIN h ON subject = o_orderkey"),
    "b11_claim_paths": (lambda s, d: library.claim_paths(I(s, d), I(s, d).where("id % 4 = 0").select(F.translate("path", "/", "\\").alias("path")), "main").groupBy("moved").agg(F.count("*").alias("n"), F.count_if(F.col("library_id") == "main").alias("main")), "SELECT moved, count(*) AS n, count(*) FILTER (moved OR library_id = 'main') AS main FROM (SELECT library_id, path IN (SELECT path FROM items WHERE id % 4 = 0) AND library_id IS DISTINCT FROM 'main' AS moved FROM items) GROUP BY 1"),
    "b12_clear_library": (lambda s, d: I(s, d).where(~F.col("library_id").eqNullSafe("second")).select("id").join(ALL(s, d).select(F.col("item_id").alias("id"), "tag"), "id").groupBy("id").agg(F.count("*").alias("n")), "SELECT id, count(*) AS n FROM items JOIN tags ON item_id = id WHERE library_id IS DISTINCT FROM 'second' GROUP BY 1"),
    "b13_favourites": (lambda s, d: library.membership(I(s, d).where("user_rating = 5").select(F.lit(0).cast("long").alias("collection"), F.lower("path").alias("id")), I(s, d).where("width > 1300").select(F.lower("path").alias("id")), 0, add=False).select("id").distinct(), "SELECT DISTINCT lower(path) AS id FROM items WHERE user_rating = 5 AND lower(path) NOT IN (SELECT lower(path) FROM items WHERE width > 1300)"),
    "b14_newest_operations": (lambda s, d: library.newest_operations(C(s, d, "orders").groupBy(F.col("o_custkey").alias("op")).agg(F.count("*").alias("items")), 20, 9), "SELECT o_custkey AS op, count(*) AS items, count(*) <= 9 AS can_undo FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 20"),
    "t07_scan_guard": (lambda s, d: library.scan_guard(C(s, d, "events").selectExpr("CAST(user_id AS STRING) AS path").distinct().selectExpr("path", "7 AS size", "'complete' AS status"), _events(s, d)), f"WITH {_EVENTS} SELECT path, coalesce(z, 7) AS size, CASE WHEN p IS NOT NULL AND (q IS NULL OR p > q) THEN 'pending' ELSE 'complete' END AS status, coalesce(z <> 7, false) AS changed FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events) LEFT JOIN (SELECT path, arg_max(size, moment) FILTER (kind = 'parsed') AS z, max(moment) FILTER (kind = 'pending') AS p, max(moment) FILTER (kind = 'parsed') AS q FROM ev GROUP BY 1) USING (path)"),
    "t09_signature": (lambda s, d: C(s, d, "embeddings").where("embedding IS NOT NULL").agg(F.count("*").alias("n"), F.max("vec_id").alias("newest")), "SELECT count(*) AS n, max(vec_id) AS newest FROM embeddings WHERE embedding IS NOT NULL"),
}


def queries():
    return {name: q for name, (q, _) in CASES.items()}


def oracle_sql():
    out = {}
    for name, (_, sql) in CASES.items():
        framed = catalog.with_frames(sql)
        if sql.startswith("WITH "):
            own = [f for n, f in (("items", catalog.ITEMS_SQL), ("tags", catalog.TAGS_SQL), ("scores", catalog.SCORES_SQL)) if n in sql.replace("n_items", "")]
            framed = f"WITH {', '.join([*own, sql[5:]])}" if own else sql
        out[name] = framed
    return out
