"""Library operators on small literal frames."""

from pyspark.sql import functions as F

from loomery.functions import captions
from loomery.operators import datasets, library, scores


def test_reconnect_steps(spark):
    lost = [(1, "a", 5, 100, None), (2, "b", 5, 900, "p"), (3, "c", None, None, None), (4, "d", 1, 7, None), (5, "d", 1, 8, None), (6, "a", 6, 100, None)]
    found = [("/1", "a", 5, 101, None), ("/2", "b", 5, 1, "p"), ("/3", "c", 9, 1, None), ("/4", "d", 1, 7, None), ("/5", "e", 1, 1, None), ("/6", "a", 5, 100, None)]
    columns = "name string, size long, seconds long, fingerprint string"
    got = library.reconnect(spark.createDataFrame(lost, f"id long, {columns}"), spark.createDataFrame(found, f"path string, {columns}")).collect()
    assert {r.path: (r.how, r.id) for r in got} == {"/1": ("stat", 1), "/2": ("fingerprint", 2), "/3": ("name_size", 3), "/4": ("ambiguous", None), "/5": ("none", None), "/6": ("used", None)}


def test_revisions_need_the_expected_head(spark):
    old = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "subject long, generation long, content string")
    new = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 1, "c"), (2, 0, "d")], "subject long, expected long, content string")
    got = {r.content: (r.state, r.generation) for r in library.append_revisions(old, new).collect()}
    assert got == {"a": ("appended", 3), "b": ("conflict", None), "c": ("conflict", None), "d": ("appended", 1)}


def test_votes(spark):
    rows = [(1, "m", "Cat", "general", 0.5), (1, "n", "cat", "character", 0.9), (1, "m", "dog", "general", 0.9), (1, "n", "who", "copyright", 0.2), (1, "m", "safe", "rating", 0.9)]
    frame = spark.createDataFrame(rows, "item_id long, model string, tag string, category string, score double")
    got = {r.tag: (r.weight, r.votes, r.confidence, r.category) for r in scores.consensus(frame, {"m": 0.5}, 0).collect()}
    assert got == {"cat": (1.5, 2, 0.9, "general"), "who": (1.0, 1, 0.2, "copyright")}
    assert scores.rating_verdict(frame).first().rating == "safe"


def test_closure_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n0", "n0")], "child string, parent string")
    assert datasets.closure(edges).count() == 45


def test_captions(spark):
    row = spark.range(1).select(
        captions.transformed(F.lit("Solo, blue_eyes, solo,, x"), ["Blue Eyes"], ["trig"], ["END"]).alias("a"),
        captions.rendered("{t}, {none} , by {a},,", {"t": F.lit("trig"), "a": F.lit("me")}).alias("b"),
        captions.file_stem("{t}/{index:03}", {"t": F.lit("a:b")}, F.lit(7)).alias("c"),
        captions.with_prose(F.lit(" tags "), "both", F.lit("one\n two")).alias("d"),
        captions.suppression(F.array(F.lit("Long_Hair"), F.lit("long hair"), F.lit(""))).alias("e"),
    ).first()
    assert tuple(row) == ("trig, Solo, x, END", "trig, by me", "a_b_007", "tags, one two", "Never mention: long hair.")
