"""Dataset reports and given word lists as queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import consistency
from loomery.sources import readers

from . import catalog

C, I, ALL = catalog.table, catalog.items, catalog.tags
#: Tags of a training set, in SQL of both engines: shots, ratings and rare words among the brands.
NAMED = "CASE WHEN item_id % 401 = 7 AND pos = 1 THEN 'only ' || CAST(item_id AS STRING) WHEN pos = 2 AND item_id % 11 < 4 THEN 'Full_Body' WHEN pos = 3 AND item_id % 3 = 0 THEN 'upper  body' WHEN pos = 4 AND item_id % 23 = 0 THEN 'wide shot' WHEN pos = 1 AND item_id % 5 > 0 THEN 'General' WHEN pos = 5 AND item_id % 7 = 0 THEN 'explicit' WHEN pos IN (6, 7) THEN 'twin ' || CAST(pos AS STRING) WHEN pos = 3 AND item_id % 29 = 0 THEN ' ' ELSE tag END"
SAID = "CASE id % 6 WHEN 0 THEN 'a picture, Old_Look' || chr(10) || 'more' WHEN 1 THEN NULL WHEN 2 THEN 'old looks' ELSE prompt || ',  old   look' END"
WORDS = "CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) ELSE p_name END"


def _report(trigger, purpose):
    def query(spark, sf):
        tags = ALL(spark, sf).selectExpr("item_id", f"{NAMED} AS tag", "pos")
        captions = I(spark, sf).selectExpr("id", f"{SAID} AS caption")
        words = C(spark, sf, "part").selectExpr(f"{WORDS} AS tag")
        return consistency.report(I(spark, sf), tags, captions, words, trigger, purpose, jaccard=0.3)

    return query


_FOLD = "trim(regexp_replace(replace(lower(coalesce({c}, '')), '_', ' '), '\\s+', ' ', 'g'))"
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)


def _report_sql(trigger: str, purpose: str) -> str:
    """Each finding counted by itself."""
    duck = lambda e: e.replace("AS STRING", "AS VARCHAR")
    frames = f"""{catalog.ITEMS_SQL}, {catalog.TAGS_SQL}, raw AS (SELECT item_id, {duck(NAMED)} AS tag, pos FROM tags),
f AS MATERIALIZED (SELECT item_id, tag, pos, {_FOLD.format(c='tag')} AS key FROM raw WHERE {_FOLD.format(c='tag')} <> ''),
per AS MATERIALIZED (SELECT id, coalesce((SELECT count(*) FROM f WHERE item_id = id AND key IN ({_LIST(consistency.RATINGS)})), 0) AS ratings, (SELECT arg_min(key, pos) FROM f WHERE item_id = id AND key IN ({_LIST(consistency.SHOTS)})) AS shot FROM items),
tag_counts AS MATERIALIZED (SELECT key, count(DISTINCT item_id) AS n, count(DISTINCT lower(trim(tag))) AS spellings FROM f GROUP BY 1),
said AS (SELECT id, list_transform(regexp_split_to_array(coalesce({duck(SAID)}, ''), '[,\\r\\n]'), lambda t: {_FOLD.format(c='t')}) AS s FROM items),
top AS (SELECT key, n FROM tag_counts WHERE n >= 3 AND key <> '{trigger}' ORDER BY n DESC, key LIMIT 150),
held AS (SELECT DISTINCT item_id, key FROM f SEMI JOIN top USING (key)),
twins AS (SELECT x.key AS a, y.key AS b, count(*) AS ab FROM held x JOIN held y ON x.item_id = y.item_id AND x.key < y.key GROUP BY 1, 2)"""
    cases = [
        "SELECT 'rating-duplicates' AS code, CAST(id AS VARCHAR) AS what, id AS place FROM per WHERE ratings > 1",
        "SELECT 'rating-missing', CAST(id AS VARCHAR), id FROM per WHERE ratings = 0",
        "SELECT 'low-frequency-tags', key, 0 FROM tag_counts WHERE n = 1",
        "SELECT 'spelling-variants', key, 0 FROM tag_counts WHERE spellings > 1",
        "SELECT 'cooccurring-duplicates', a || ' + ' || b, 0 FROM twins JOIN top x ON x.key = a JOIN top y ON y.key = b WHERE round(ab / (x.n + y.n - ab), 6) >= 0.3",
    ]
    if trigger:
        cases += [f"SELECT 'trigger-coverage', CAST(id AS VARCHAR), id FROM said WHERE NOT list_contains(s, '{trigger}')", f"SELECT DISTINCT 'trigger-collision', {WORDS}, 0 FROM part WHERE {_FOLD.format(c=WORDS)} = '{trigger}'"]
    elif purpose in ("character", "concept"):
        cases.append("SELECT 'trigger-missing', 'none', 0")
    union = " UNION ALL ".join(cases)
    whole = _LIST(consistency.WHOLE_FIGURE)
    extra = f" UNION ALL SELECT 'composition-fullbody', count(*) FILTER (shot IN ({whole})), '' FROM per HAVING count(*) >= 10 AND count(*) FILTER (shot IN ({whole})) < greatest(1, round_even(count(*) * 0.1, 0))" if purpose == "character" else ""
    places = " ".join(f"WHEN '{c}' THEN {k}" for c, k in consistency.SEVERITY.items())
    return f"""WITH {frames}, cases AS ({union}), turns AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY place, what) AS t FROM cases),
listed AS (SELECT code, count(*) AS n, array_to_string(list(what ORDER BY t) FILTER (t <= 5), ', ') AS examples FROM turns GROUP BY 1{extra})
SELECT code, CASE CASE code {places} END WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'info' END AS severity, CAST(CASE code {places} END AS INTEGER) AS place, n, total, examples
FROM listed, (SELECT count(*) AS total FROM items) WHERE code <> 'rating-missing' OR n < total"""


#: Lines of a word list, of edges and of translations made of every part, in SQL of both engines: some
#: have bad numbers, no word, a comment, a loop, a header, or the translation first.
VOCABULARY = "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END || ',' || CASE WHEN p_partkey % 5 = 0 THEN 'x' || CAST(p_size AS STRING) ELSE CAST(p_size AS STRING) END || ',' || CASE WHEN p_partkey % 7 = 0 THEN '1.5' ELSE CAST(p_partkey * 3 AS STRING) END || CASE WHEN p_partkey % 3 = 0 THEN ',' || p_brand ELSE '' END"
EDGES = "CASE WHEN p_partkey % 11 = 0 THEN '# ' ELSE '' END || p_brand || ' , ' || CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END"
SAYINGS = "CASE WHEN p_partkey % 9 = 0 THEN 'tag,translation' WHEN p_partkey % 2 = 0 THEN '猫' || CAST(p_partkey AS STRING) || ', ' || p_brand ELSE p_brand || ',中' || CAST(p_size AS STRING) END"


def _lines(lines):
    return lambda spark, sf: C(spark, sf, "part").selectExpr(f"{lines} AS value")


#: name -> (query, SQL)
ENTRIES = {
    "a25_consistency_report": (_report("old look", "character"), _report_sql("old look", "character")),
    "a25_without_trigger": (_report("", "concept"), _report_sql("", "concept")),
    "a25_shots": (lambda s, d: consistency.shots(I(s, d), ALL(s, d).selectExpr("item_id", f"{NAMED} AS tag", "pos")), f"WITH {catalog.ITEMS_SQL}, {catalog.TAGS_SQL}, f AS (SELECT item_id, pos, {_FOLD.format(c='tag')} AS key FROM (SELECT item_id, pos, {NAMED.replace('AS STRING', 'AS VARCHAR')} AS tag FROM tags)), per AS (SELECT id, coalesce((SELECT arg_min(key, pos) FROM f WHERE item_id = id AND key IN ({_LIST(consistency.SHOTS)})), 'unspecified') AS shot FROM items) SELECT shot, (SELECT count(*) FROM per p WHERE p.shot = s.shot) AS n FROM (SELECT unnest([{_LIST((*consistency.SHOTS, 'unspecified'))}]) AS shot) s"),
    "s17_vocabulary": (lambda s, d: readers.vocabulary_lines(_lines(VOCABULARY)(s, d)), "SELECT p_name AS tag, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS category, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 3 END AS count, p_name || CASE WHEN p_partkey % 3 = 0 THEN ',' || p_brand ELSE '' END AS search FROM part WHERE p_partkey % 13 > 0"),
    "s18_implications": (lambda s, d: readers.implication_lines(_lines(EDGES)(s, d)), "SELECT DISTINCT p_brand AS child, p_name AS parent FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 4 > 0 AND p_partkey % 17 > 0 AND p_brand <> p_name"),
    "s19_translations": (lambda s, d: readers.translations(_lines(SAYINGS)(s, d)), "SELECT p_brand AS tag, min(CASE WHEN p_partkey % 2 = 0 THEN '猫' || p_partkey ELSE '中' || p_size END) AS translation FROM part WHERE p_partkey % 9 > 0 GROUP BY 1"),
}


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items()}
