"""Steps whose work must grow with their input: what they compute, and how many rows they make for it."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import records
from loomery.operators import consistency, evidence, library, pictures, vectors
from loomery.plans import record_queries, registry


def most_rows(frame):
    """The most rows that any step of a frame's plan puts out, once it is collected."""
    frame.collect()
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        found = p.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_reconnection_pairs_no_files_of_one_name(spark):
    """files and lost items of one name and size are counted, not paired."""
    lost = spark.range(3000).selectExpr("id", "'a' AS name", "CASE WHEN id % 7 > 0 THEN 5L END AS size", "id * 10 AS seconds", "'f' || id AS fingerprint")
    found = spark.range(3000).selectExpr("'/' || id AS path", "'a' AS name", "5L AS size", "CASE WHEN id % 2 = 0 THEN id * 10 + 2 ELSE -9L END AS seconds", "'f' || id AS fingerprint")
    out = library.reconnect(lost, found)
    assert most_rows(out) < 100_000
    assert {(r["how"], r["n"], r["same"]) for r in out.groupBy("how").agg(F.count("*").alias("n"), F.count_if(F.expr("path = '/' || id")).alias("same")).collect()} == {("stat", 1500, 1500), ("fingerprint", 1500, 1500)}


def test_reconnection_of_a_path_listed_twice(spark):
    """rows of one path are judged together, each once; an item of unknown size is met once."""
    lost = spark.createDataFrame([(1, "a", None, 100, None), (2, "a", 5, None, None), (3, None, 5, None, None)], "id long, name string, size long, seconds long, fingerprint string")
    found = spark.createDataFrame([("/x", "a", 5, 101, None), ("/x", "a", 5, 900, None), ("/y", "a", None, None, None), ("/z", None, 5, 1, None)], "path string, name string, size long, seconds long, fingerprint string")
    assert {tuple(r) for r in library.reconnect(lost, found).collect()} == {("/x", "stat", 1), ("/y", "none", None), ("/z", "none", None)}


@pytest.mark.parametrize("name", ["x23_branching_graphs", "x23_graph_hops", "s12_built_records", "x35_caption_modes"])
def test_small_files_are_dealt_over_tasks(spark, sf, name):
    """what is computed on the rows of one small file isn't one task's work."""
    assert registry.queries()[name](spark, sf).select(F.spark_partition_id()).distinct().count() > 1


def test_graph_of_odd_names(spark):
    """nodes are read once; a number in a list is no reference to a node without a name."""
    graph = '{"s":{"class_type":"XSampler","inputs":{"a":["a, b ",0],"n":[7 ,1],"t":["alone"],"o":{"x":[["in",0],["no]te","[q\\"",1]]}}},"":{"class_type":"N"},"7":{"class_type":"N"},"a, b ":{"class_type":"N"},"in":{"class_type":"N","inputs":{"s":["s",0]}},"alone":{"class_type":"N"},"text":"x","none":{"inputs":{}}}'
    out = spark.createDataFrame([(graph,)], "g string").select(records.upstream(F.col("g")).alias("h"))
    assert out.first()["h"] == {"s": 0, "a, b ": 1, "7": 1, "in": 1}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") < 4


def test_pixels_are_dealt_by_picture(spark, sf, monkeypatch):
    """a task holds the bins of a bounded number of pictures, and pixels aren't sent."""
    monkeypatch.setattr(record_queries, "PICTURES", 10)
    pixels = record_queries._pixels(spark, sf)
    n = pixels.select("id").distinct().count()
    assert pixels.rdd.getNumPartitions() >= n // 10
    out = pictures.records(pixels)
    assert most_rows(out.select("id")) <= 64 * n and out.count() == n


def test_blocks_grow_before_they_multiply():
    """Six times the vectors are sent to no more tasks each."""
    assert vectors.blocks_for(82_000) == 21
    assert vectors.blocks_for(100_000) == vectors.blocks_for(600_000) == 24
    assert vectors.blocks_for(10**7) == 153
    assert vectors.blocks_for(0) == 0


def test_grown_blocks_find_all_pairs(spark, monkeypatch):
    """A vector is dealt to BLOCKS tasks, and each pair is found once."""
    monkeypatch.setattr(vectors, "BLOCKS", 3)
    x = np.random.default_rng(5).normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(k, v.tolist(), 7) for k, v in enumerate(x)], "vec_id long, u array<double>, scope long")
    out = vectors.block_pairs(rows, 0.9, 5)
    assert sorted((r.a, r.b) for r in out.collect()) == [(a, b) for a in range(60) for b in range(a + 1, 60) if x[a] @ x[b] >= 0.9]
    assert most_rows(out.select("a")) <= 180


def test_small_files_are_not_sent_through_the_driver(spark, sf):
    """The sides of a join by bands grow with the table, whatever its file's size."""
    for name in ("j18_hash_links", "j18_hash_groups"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") >= 1
        assert "BroadcastHashJoin [band" not in plan or "LeftAnti" in plan


def test_scores_are_shuffled_once(spark, sf):
    """what groups scores by item keeps one partitioning of a fixed number of parts."""
    plan = registry.queries()["a30_rethreshold_diff"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2


def test_variants_of_a_crowded_path_are_paired_by_many_tasks(spark):
    """the pairs of one path are dealt over tasks; null ids, null paths and items without variants stay as they were."""
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with variants too many to be sent whole
    items = own.range(2400).selectExpr(
        "CASE WHEN id NOT IN (4, 7) THEN id END AS id",
        "CASE WHEN id = 8 THEN NULL WHEN id >= 2000 THEN '/b.c/y' || id || '.png' WHEN id % 4 = 3 THEN '/a/x_censored.png' ELSE '/a/x.png' END AS path",
    )
    out = library.variant_pairs(items, "_censored").select("id", "other")
    first, second = [None if k == 4 else k for k in range(2000) if k % 4 != 3 and k != 8], [None if k == 7 else k for k in range(3, 2000, 4)]
    expected = Counter((a, b) for a in first for b in second) + Counter((k, None) for k in range(2000, 2400))
    assert Counter(tuple(r) for r in out.collect()) == expected
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < expected.total() / 4


def test_evidence_meets_items_in_bounded_parts(spark, monkeypatch):
    """more items make more tasks, and what comes from items isn't joined with them again."""
    monkeypatch.setattr(evidence, "ITEMS", 50)
    items = spark.range(1000).selectExpr("CASE WHEN id < 990 THEN id END AS id", "'/' || id AS path", "0 AS is_readable", "1 AS width", "1 AS height", "1.0D AS aesthetic_score")
    tags = spark.range(2000).selectExpr("id AS item_id", "'x' AS tag", "0.1D AS confidence")
    none = spark.range(0)
    found = lambda *kinds: evidence.gathered(items, tags, none.selectExpr("id", "'' AS caption"), none.selectExpr("'' AS path"), none.selectExpr("id", "'' AS field", "'' AS source"), none.selectExpr("id", "id AS keeper"), ("x",), 0.5, 9, 2.0, kinds)
    own = found(*evidence.OWN)
    assert own.count() == 5 * 990
    assert found("low_tag_confidence").count() == 990
    assert found("low_tag_confidence").rdd.getNumPartitions() >= 20
    assert found("small_image")._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_report_counts_each_item_of_a_tag_once(spark, monkeypatch):
    """tags are counted from distinct rows of bounded parts."""
    monkeypatch.setattr(consistency, "ITEMS", 50)
    items, tags = spark.range(1000), spark.range(3000).selectExpr("id % 1500 AS item_id", "CASE WHEN id % 2 = 0 THEN 'Long_Hair' ELSE 'long hair' END AS tag", "id AS pos")
    none = spark.range(0).selectExpr("id", "'' AS caption", "'' AS tag")
    out = {r["code"]: (r["n"], r["examples"]) for r in consistency.report(items, tags, none, none, "", "concept").collect()}
    assert out == {"trigger-missing": (1, "none"), "spelling-variants": (1, "long hair")}
    counted = consistency.by_tag(consistency._folded(tags))
    assert [tuple(r) for r in counted.collect()] == [("long hair", 1500, 2)]
    assert "Expand" not in counted._jdf.queryExecution().sparkPlan().toString()
