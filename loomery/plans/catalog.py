"""The library's frames, mapped onto the driver's star-schema tables.

Expressions are plain SQL that Spark and DuckDB read alike, so the same mapping stands before a
query and before its oracle. Only the mapping is shared; operators are DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.dealing import dealt

ITEM = (
    "o_orderkey AS id",
    "'/lib/' || CAST(o_orderkey % 9 AS STRING) || '/sub' || CAST(o_orderkey % 4 AS STRING) || '/Img_' || CAST(o_orderkey % 997 AS STRING) || '.png' AS path",
    "'Img_' || CAST(o_orderkey % 997 AS STRING) || '.png' AS filename",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS generator",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS ai_rating",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS tagged_at",
    "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'Model_' || CAST(o_custkey % 10 AS STRING) END AS checkpoint",
    "512 + 64 * (o_orderkey % 17) AS width",
    "512 + 64 * (o_orderkey % 13) AS height",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 50000 END AS aesthetic_score",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS saturation",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 256 AS DOUBLE) END AS brightness",
    "CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE CAST(o_orderkey % 41 - 20 AS DOUBLE) / 10 END AS brightness_skew",
    "CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'warm' WHEN o_orderkey % 3 = 1 THEN 'cool' ELSE 'neutral' END AS color_temperature",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'high' END AS brightness_distribution",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'red,white' WHEN o_orderkey % 3 = 1 THEN 'blue' ELSE 'green,red' END AS hues",
    "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'a picture' END AS ai_caption",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'words' ELSE NULL END AS nl_caption",
    "CASE WHEN o_orderkey % 10 = 1 THEN 'not json' WHEN o_orderkey % 10 = 2 THEN NULL WHEN o_orderkey % 10 = 3 THEN '{\"noise_seed\": ' || CAST(o_orderkey % 50 AS STRING) || '}' ELSE '{\"seed\": ' || CAST(o_orderkey % 50 AS STRING) || '}' END AS metadata_json",
    "o_orderkey % 6 AS user_rating",
    "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0 ELSE 1 END AS is_readable",
    "CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'main' ELSE 'second' END AS library_id",
    "CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 12 = 1 THEN ' ' ELSE '1girl, Blue_Eyes, (smile:1.2), look' || CAST(o_orderkey % 8 AS STRING) || ' <lora:style' || CAST(o_orderkey % 5 AS STRING) || ':0.8>' END AS prompt",
    "CASE WHEN o_orderkey % 15 = 0 THEN NULL WHEN o_orderkey % 15 = 1 THEN 'Pending' ELSE 'complete' END AS metadata_status",
    "CAST(floor(o_totalprice) AS BIGINT) AS file_size",
    "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_orderdate END AS order_time",
    "o_orderdate AS created_at",
)

TAG = (
    "l_orderkey AS item_id",
    "CASE WHEN l_suppkey % 5 = 0 THEN 'Brand_' ELSE 'brand_' END || l_returnflag || CAST(l_partkey % 10 AS STRING) AS tag",
    "1 - l_discount AS confidence",
    "CASE WHEN l_linestatus = 'O' THEN 'manual' ELSE 'tagger' END AS source",
    "CASE WHEN l_partkey % 10 < 2 THEN 'character' WHEN l_partkey % 10 = 9 THEN 'rating' ELSE 'general' END AS category",
    "l_linenumber AS pos",
)

SCORE = (
    "l_orderkey AS item_id",
    "'model_' || l_linestatus AS model",
    "'tag_' || l_returnflag || CAST(l_partkey % 5 AS STRING) AS tag",
    "CASE WHEN l_partkey % 5 = 0 THEN 'character' WHEN l_partkey % 5 = 1 THEN 'copyright' WHEN l_partkey % 5 = 2 THEN 'rating' ELSE 'general' END AS category",
    "l_discount * 10 AS score",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item."""
    return table(spark, sf_dir, "orders").selectExpr(*ITEM)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of items; an item may repeat a tag in another case or with other confidence."""
    return table(spark, sf_dir, "lineitem").selectExpr(*TAG)


def unique_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, tag) once, with its highest confidence and, at ties, the least other columns."""
    return tags(spark, sf_dir).groupBy("item_id", "tag").agg(F.max("confidence").alias("confidence"), F.min("source").alias("source"), F.min("category").alias("category"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, model, tag) once with its highest score."""
    rows = dealt(table(spark, sf_dir, "lineitem").selectExpr(*SCORE), "item_id")  # groups by item need no further shuffle
    return rows.groupBy("item_id", "model", "tag", "category").agg(F.max("score").alias("score"))


def _duck(columns) -> str:
    return ", ".join(columns).replace("AS STRING", "AS VARCHAR")


ITEMS_SQL = f"items AS (SELECT {_duck(ITEM)} FROM orders)"
TAGS_SQL = f"tags AS (SELECT {_duck(TAG)} FROM lineitem), utags AS (SELECT item_id, tag, max(confidence) AS confidence, min(source) AS source, min(category) AS category FROM tags GROUP BY 1, 2)"
SCORES_SQL = f"scores AS (SELECT item_id, model, tag, category, max(score) AS score FROM (SELECT {_duck(SCORE)} FROM lineitem) GROUP BY 1, 2, 3, 4)"


def with_frames(sql: str) -> str:
    """``sql`` after the frames that it names."""
    held = [f for name, f in (("items", ITEMS_SQL), ("tags", TAGS_SQL), ("scores", SCORES_SQL)) if name in sql]
    return f"WITH {', '.join(held)} {sql}" if held else sql
