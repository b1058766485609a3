"""Records, reviews and sinks against plain versions."""

import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from loomery.functions import captions, categories, records
from loomery.operators import review, vectors


def hops(nodes):
    """Breadth-first hops of a plain walk."""
    front = [k for k, v in nodes.items() if "sampler" in v["class_type"].lower()] or list(nodes)
    seen = dict.fromkeys(front, 0)
    while front:
        fed = [ref for name in front for v in nodes[name]["inputs"].values() if isinstance(v, list) for ref in [str(v[0])] if ref in nodes and ref not in seen]
        depth = seen[front[0]] + 1
        seen.update(dict.fromkeys(fed, depth))
        front = list(dict.fromkeys(fed))
    return seen


def test_graph_hops(spark):
    draw = random.Random(3)
    graphs = []
    for _ in range(40):
        n = draw.randint(1, 12)
        graphs.append({str(k): {"class_type": draw.choice(["KSampler", "Node", "Node"]), "inputs": {f"i{j}": draw.choice([[str(draw.randint(0, n)), 0], "text [1, 0", 5]) for j in range(3)}} for k in range(n)})
    rows = [(i, json.dumps(g)) for i, g in enumerate(graphs)] + [(98, None), (99, "no json")]
    got = {r.id: r.h for r in spark.createDataFrame(rows, "id int, g string").select("id", records.upstream(F.col("g")).alias("h")).collect()}
    assert [got[i] for i in range(len(graphs))] == [hops(g) for g in graphs]
    assert got[98] is None and got[99] is None


def test_signature_is_hmac(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        for message in ("", "1:small:7", "é漢"):
            got = spark.range(1).select(review.signature(F.lit(message), key)).first()[0]
            assert got == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def test_vectors_survive_bytes(spark):
    rows = spark.createDataFrame([(1, [1.5, -0.0]), (2, []), (3, None)], "id int, v array<float>")
    got = {r.id: (r.b, r.w) for r in vectors.unpacked(vectors.packed(rows, "v", "b"), "b", "w").collect()}
    assert got[1][0] == b"\0\0\xc0\x3f\0\0\0\x80" and got[1][1] == [1.5, -0.0]
    assert got[2][1] == [] and got[3] == (None, None)


def test_sidecars_are_written_each_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A.png", "one"), (2, "a.PNG", "two"), (3, "b", "")], "id long, filename string, caption string")
    files = review.sidecars(rows)
    assert sorted((r.id, r.file) for r in files.collect()) == [(1, "a.txt"), (2, "a_2.txt"), (3, "b.txt")]
    review.write_sidecars(files, str(tmp_path / "out"))
    back = {(r.file, r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert back == {("a.txt", "one"), ("a_2.txt", "two"), ("b.txt", "")}


def test_draws_follow_the_weights(spark):
    counts = spark.createDataFrame([("a", "c", 900), ("b", "c", 100), ("only", "d", 1), ("gone", "d", 10**9)], "tag string, category string, n long")
    gone = spark.createDataFrame([("gone",)], "tag string")
    picks = [{r.category: r.tag for r in review.weighted_picks(counts, seed, gone).collect()} for seed in range(30)]
    assert all(p["d"] == "only" for p in picks)
    assert 20 <= sum(p["c"] == "a" for p in picks) <= 30


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([(None,), ("",)], "t string")
    assert [tuple(r) for r in none.select(records.answer(F.col("t")).alias("a")).select("a.*").collect()] == [("", ""), ("", "")]
    assert [r[0] for r in none.select(records.tag_list(F.col("t"))).collect()] == [[], []]
    tags = spark.createDataFrame([(None,), ("smile",)], "tag string")
    assert [r[0] for r in categories.categorized(tags).select("category").collect()] == [None, "expression"]
    meta = spark.createDataFrame([({},), (None,)], "m map<string,string>")
    assert [r[0] for r in meta.select(records.generator(F.col("m"))).collect()] == ["unknown", "unknown"]
    empty = spark.createDataFrame([], "id long, t string")
    words = spark.createDataFrame([], "tag string")
    assert records.prompt_likeness(empty, "id", "t", words).count() == 0
    assert spark.range(1).select(captions.assembled("", F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(None).cast("string"))).first()[0] == ""
