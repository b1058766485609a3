"""Near vectors and hashes, duplicate groups and medoids as queries, each beside its SQL.

The vectors of the tables are far apart, so the library of these queries holds them once as they are
and some again as copies: shifted a little in one of two ways, or the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import neighbours, vectors

from . import catalog

C, I = catalog.table, catalog.items
NEAR = 0.9
#: Copies: which ids have one, what is added to the id, and the step of the shift (0: none).
COPIES = ((3, 1_000_000, 7), (6, 2_000_000, 3), (10, 3_000_000, 0))


def _library(spark, sf):
    """Vectors and their copies: ``vec_id``, ``label``, ``embedding``."""
    rows = C(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    out = rows.select("vec_id", "label", F.col("e").alias("embedding"))
    for every, far, step in COPIES:
        shifted = F.transform("e", lambda x, i: x + F.lit(0.03) * ((F.col("vec_id") + step * i) % 5 - 2)) if step else F.col("e")
        out = out.union(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id") + far, "label", shifted))
    return out


def _facts(spark, sf):
    """What is known of each vector's picture; many share what decides but the id."""
    known = I(spark, sf).select(F.col("id").alias("item"), "user_rating", "aesthetic_score", "width", "height", "file_size")
    held = _library(spark, sf).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 90).alias("item"))
    return held.join(known, "item").drop("item")


def _pairs(spark, sf, *scope):
    found = neighbours.classes(_library(spark, sf), *scope).checkpoint()
    pairs = neighbours.near_pairs(found, NEAR, *scope)
    n = lambda c: found.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"))
    return pairs.join(n("a"), "a").join(n("b"), "b").select("a", "b", F.round("similarity", 6).alias("similarity"), (F.col("na") * F.col("nb")).alias("links"))


def _groups(spark, sf):
    return neighbours.duplicate_groups(_library(spark, sf), _facts(spark, sf), NEAR)


def _hashes(spark, sf):
    """Hashes of 64 bits: runs of five parts share one but for the bits that their place in the run sets."""
    base = F.conv(F.substring(F.md5(F.floor(F.col("p_partkey") / 5).cast("string")), 1, 15), 16, 10).cast("long")
    return C(spark, sf, "part").select(F.col("p_partkey").alias("id"), base.bitwiseXOR(F.expr("shiftleft(1L, CAST(p_partkey % 5 AS INT)) - 1")).alias("h"))


_SHIFTED = "".join(f" UNION ALL SELECT vec_id + {far}, label, {f'list_transform(e, lambda x, i: x + 0.03::DOUBLE * ((vec_id + {step} * (i - 1)) % 5 - 2))' if step else 'e'} FROM v WHERE vec_id % {every} = 0" for every, far, step in COPIES)
_LIB = f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL), lib AS MATERIALIZED (SELECT vec_id, label, e FROM v{_SHIFTED})"
_FACTS = "facts AS MATERIALIZED (SELECT l.vec_id AS id, user_rating, aesthetic_score, width, height, file_size FROM lib l JOIN items i ON i.id = l.vec_id % 90)"
_PAIRED = f"pairs AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS s FROM lib x JOIN lib y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {NEAR})"
#: Turn by turn: the k-th node, unless it is lost, takes those beside it that come later and aren't lost.
_WALK = """near AS MATERIALIZED (SELECT k, list(j) FILTER (j > k) AS js FROM links GROUP BY 1),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS lost, CAST([] AS BIGINT[]) AS taker
  UNION ALL SELECT k, list_concat(lost, new), list_concat(taker, list_transform(new, lambda j: k))
  FROM (SELECT w.k + 1 AS k, w.lost, w.taker, CASE WHEN list_contains(w.lost, w.k + 1) THEN CAST([] AS BIGINT[]) ELSE list_filter(coalesce(near.js, CAST([] AS BIGINT[])), lambda j: NOT list_contains(w.lost, j)) END AS new FROM walk w JOIN near ON near.k = w.k + 1)),
ends AS (SELECT unnest(lost) AS k, unnest(taker) AS o FROM (SELECT lost, taker FROM walk ORDER BY k DESC LIMIT 1)),
lost AS (SELECT n.id, m.id AS keeper FROM ends JOIN nodes n USING (k) JOIN nodes m ON m.k = ends.o)"""
_GROUPS = f"""WITH RECURSIVE {catalog.ITEMS_SQL}, {_LIB}, {_FACTS}, {_PAIRED},
nodes AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY coalesce(user_rating, 0) DESC, coalesce(aesthetic_score, 0) DESC, coalesce(width, 0) * coalesce(height, 0) DESC, coalesce(file_size, 0) DESC, id) AS k FROM facts WHERE id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)),
links AS (SELECT x.k, y.k AS j FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) p JOIN nodes x ON x.id = p.a JOIN nodes y ON y.id = p.b), {_WALK}"""
_CLASSES = "c AS MATERIALIZED (SELECT {scope}e, min(vec_id) AS cls, count(*) AS n FROM lib GROUP BY ALL)"
_CLASS_PAIRS = f"SELECT x.cls AS a, y.cls AS b, round(list_cosine_similarity(x.e, y.e), 6) AS similarity, x.n * y.n AS links FROM c x JOIN c y ON x.cls < y.cls {{on}} WHERE list_cosine_similarity(x.e, y.e) >= {NEAR}"
_HASHES = "rows AS (SELECT p_partkey AS id, xor(CAST('0x' || substr(md5(CAST(p_partkey // 5 AS VARCHAR)), 1, 15) AS BIGINT), (1::BIGINT << CAST(p_partkey % 5 AS INTEGER)) - 1) AS h FROM part)"
_UNITS = "units AS MATERIALIZED (SELECT label, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM lib WHERE label IS NOT NULL)"

#: name -> (query, SQL)
ENTRIES = {
    "j13_all_pairs": (_pairs, f"WITH {_LIB}, {_CLASSES.format(scope='')} {_CLASS_PAIRS.format(on='')}"),
    "j13_similar_pairs": (lambda s, d: _pairs(s, d, "label"), f"WITH {_LIB}, {_CLASSES.format(scope='label, ')} {_CLASS_PAIRS.format(on='AND x.label IS NOT DISTINCT FROM y.label')}"),
    "a34_keeper_groups": (lambda s, d: _groups(s, d).select("id", "keeper", F.round("similarity", 6).alias("similarity")), f"{_GROUPS} SELECT id, keeper, round(s, 6) AS similarity FROM lost JOIN pairs ON a = least(id, keeper) AND b = greatest(id, keeper)"),
    "a35_duplicate_summary": (lambda s, d: neighbours.summary(_library(s, d), _groups(s, d), _facts(s, d)), f"{_GROUPS} SELECT (SELECT count(*) FROM lib) AS embedded, count(DISTINCT keeper) AS groups, count(*) AS redundant, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS reclaimable_bytes FROM lost JOIN facts USING (id)"),
    "j18_hash_links": (lambda s, d: neighbours.hash_pairs(_hashes(s, d), 2), f"WITH {_HASHES} SELECT DISTINCT x.h AS a, y.h AS b FROM rows x JOIN rows y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 2"),
    "j18_hash_groups": (lambda s, d: neighbours.hash_groups(_hashes(s, d), 1), f"WITH RECURSIVE {_HASHES}, nodes AS MATERIALIZED (SELECT id, h, row_number() OVER (ORDER BY id) AS k FROM rows), links AS (SELECT x.k, y.k AS j FROM nodes x JOIN nodes y ON x.k <> y.k AND bit_count(xor(x.h, y.h)) <= 1), {_WALK} SELECT id, keeper FROM lost"),
    "a33_medoids": (lambda s, d: vectors.medoids(_library(s, d), "label", 0.9), f"""WITH {_LIB}, {_UNITS}, sums AS (SELECT label, list(t ORDER BY k) AS m FROM (SELECT label, k, sum(x) AS t FROM (SELECT label, unnest(range(len(u))) AS k, unnest(u) AS x FROM units) GROUP BY 1, 2) GROUP BY 1),
best AS (SELECT label, arg_min({{'id': vec_id, 'u': u}}, (-round(list_inner_product(u, m), 9), vec_id)) AS b FROM units JOIN sums USING (label) GROUP BY 1)
SELECT label AS scope, vec_id, b.id AS medoid, round(1 - list_inner_product(u, b.u), 6) + 0.0 AS distance, 1 - list_inner_product(u, b.u) > 0.9 AS outlier FROM units JOIN best USING (label)"""),
}


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items()}
