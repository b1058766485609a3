"""Indexes, staged writes, draws, colour records and word categories against plain versions."""

import json
import math
import tempfile
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import categories, records
from loomery.operators import consistency, draws, paging, pictures, vector_index
from loomery.sources import packages
from loomery.streaming import two_phase


def vectors_of(spark, x):
    return spark.createDataFrame([(k, [float(a) for a in v] if v is not None else None) for k, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_index_finds_nine_in_ten_and_scores_exactly(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    draw = np.random.default_rng(1)
    x = [*(draw.normal(size=(900, 12)) + 3 * draw.normal(size=(20, 12))[draw.integers(0, 20, 900)]), None, [0.0] * 12]
    rows = vectors_of(spark, x)
    index = vector_index.build(rows, tempfile.mkdtemp(prefix="index-") + "/i", k=10)
    assert index.table(spark).count() == 900 and index.recall >= 0.95 and index.probes < len(index.centres)
    asks = rows.where("vec_id % 50 = 0")
    u = np.array([np.float32(v) for v in x[:900]], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {q: sorted((i for i in range(900) if i != q), key=lambda i: (-(u[q] @ u[i]), i))[:10] for q in range(0, 900, 50)}
    exact = vector_index.exact(rows, asks, 10).collect()
    assert {q: [r.id for r in sorted(exact, key=lambda r: r.place) if r.query_id == q] for q in want} == want
    got = vector_index.search(index, asks, 10).collect()
    assert all(r.similarity == pytest.approx(u[r.query_id] @ u[r.id], abs=1e-9) for r in got)
    assert sum(r.id in want[r.query_id] for r in got) >= 0.9 * 10 * len(want)
    every = vector_index.search(index, asks, 10, probes=len(index.centres)).collect()
    assert {(r.query_id, r.id) for r in every} == {(q, i) for q, ids in want.items() for i in ids}


def test_index_of_nothing(spark):
    none = vectors_of(spark, [None, [0.0, 0.0]])
    index = vector_index.build(none, tempfile.mkdtemp(prefix="index-") + "/i")
    assert index.table(spark).count() == 0


def test_ingest_that_stops_between_its_phases(spark):
    top = tempfile.mkdtemp(prefix="stages-")
    rows = spark.range(300).select(F.col("id").alias("path"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("raw"))
    for part in range(3):
        rows.where(F.col("path") % 3 == part).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    parse = lambda seen: seen.select("path", F.upper("raw").alias("value"))

    def stop(number):
        if number == 1:
            raise RuntimeError("stopped between the phases")

    with pytest.raises(Exception, match="stopped between"):
        two_phase.start(stream(), f"{top}/out", f"{top}/state", "path", parse, between=stop).awaitTermination()
    half = Counter(r.status for r in two_phase.state(spark, f"{top}/out", "path", "value").collect())
    assert half == {"complete": 80, "error": 20, "pending": 100}
    given_up = Counter(r.status for r in two_phase.state(spark, f"{top}/out", "path", "value", interrupted=True).collect())
    assert given_up == {"complete": 80, "error": 120}
    two_phase.start(stream(), f"{top}/out", f"{top}/state", "path", parse).awaitTermination()
    two_phase.start(stream(), f"{top}/once", f"{top}/state-once", "path", parse).awaitTermination()
    ends = [sorted(map(tuple, two_phase.state(spark, f"{top}/{t}", "path", "value").collect())) for t in ("out", "once")]
    assert ends[0] == ends[1] and len(ends[0]) == 300 and Counter(r[2] for r in ends[0]) == {"complete": 240, "error": 60}


def package_rows(spark):
    rows = [(k, f"/p/{k}.png", f"{k}.txt", "ok" if k % 4 else "unreadable", f"say \"{k}\"\n猫" if k % 4 else None) for k in range(40)]
    frame = spark.createDataFrame(rows, "id long, path string, file string, state string, caption string")
    return frame.withColumn("digest", F.when(F.col("state") == "ok", F.sha2("caption", 256)))


def test_package_read_back_equals_the_plan(spark):
    rows, target = package_rows(spark), tempfile.mkdtemp(prefix="package-") + "/p"
    packages.write(rows, target, files=3)
    pairs, manifest = packages.read(spark, target)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, rows.select("id", "path", "file", "state", "digest").collect()))
    assert sorted(map(tuple, pairs.select("id", "caption").collect())) == sorted(map(tuple, rows.where("state = 'ok'").select("id", "caption").collect()))
    assert packages.problems(spark, target).collect() == []
    with pytest.raises(packages.Unfinished):
        packages.write(rows, target)
    assert packages.read(spark, target)[1].count() == 40


def test_failed_package_leaves_nothing(spark):
    top = tempfile.mkdtemp(prefix="package-")
    wrong = package_rows(spark).withColumn("digest", F.when(F.col("id") == 5, F.lit("other")).otherwise(F.col("digest")))
    same = package_rows(spark).withColumn("file", F.lit("one.txt"))
    torn = package_rows(spark).withColumn("caption", F.when(F.col("id") == 5, F.raise_error(F.lit("disk gone"))).otherwise(F.col("caption")))
    import os

    for rows in (wrong, same, torn):
        with pytest.raises(packages.Unfinished):
            packages.write(rows, f"{top}/p")
        assert os.listdir(top) == []


def test_draws_follow_the_weights_and_the_rules(spark):
    tags = [(f"a{k}", "x", k + 1) for k in range(6)] + [(f"b{k}", "y", 1) for k in range(4)] + [("zero", "y", 0), ("a0", "y", 5)]
    rules = [("a5", "b0"), ("a5", "b1"), ("always", "b2")]
    seeds = list(range(400))
    counts = spark.createDataFrame(tags, "tag string, category string, n long")
    order = [("x", 2), ("y", 5)]
    picked = draws.drawn(counts, seeds, order, spark.createDataFrame(rules, "condition string, target string"), spark.createDataFrame([("always", "set")], "tag string, category string")).cache()
    chance = lambda s, t: (int(md5(f"{s}:{t}".encode()).hexdigest()[:12], 16) + 1) / (2**48 + 1)
    want = []
    for s in seeds:
        prompt = [("set", "always", 1)]
        for category, k in order:
            barred = {t for c, t in rules if c in [p[1] for p in prompt]} | {p[1] for p in prompt}
            pool = sorted((-math.log(chance(s, t)) / n, t) for t, c, n in tags if c == category and n and t not in barred)
            prompt += [(category, t, i + 1) for i, (_, t) in enumerate(pool[:k])]
        want += [(s, *p) for p in prompt]
    assert sorted((r.seed, r.category, r.tag, r.place) for r in picked.collect()) == sorted(want)
    first = Counter(t for s, c, t, i in want if c == "x" and i == 1)
    for k in range(6):
        assert abs(first[f"a{k}"] / 400 - (k + 1) / 21) < 0.08
    line = draws.prompts(picked, ["y", "x"]).where("seed = 7").first().prompt.split(", ")
    of = lambda c: [t for s, k, t, _ in want if s == 7 and k == c]
    assert line == of("y") + of("x") + of("set")


def test_colour_records_of_pictures(spark):
    draw = np.random.default_rng(4)
    pictures_of = {k: draw.integers(0, 256, (90, 3)) // (1 + k) for k in range(4)} | {9: np.array([[250, 10, 10]] * 60 + [[255, 255, 255]] * 40)}
    rows = [(k, *map(int, p)) for k, x in pictures_of.items() for p in x] + [(50, None, 1, 1)]
    got = {r.id: r for r in pictures.records(spark.createDataFrame(rows, "id long, r int, g int, b int").repartition(3)).collect()}
    assert got.keys() == pictures_of.keys()
    for k, x in pictures_of.items():
        bins = {}
        for p in x:
            bins.setdefault(tuple(int(c) // 64 for c in p), []).append(p)
        best = sorted(bins.items(), key=lambda e: (-len(e[1]), e[0]))[:5]
        half_up = lambda v: int(math.floor(v + 0.5))
        want = [{"hex": "#" + "".join(f"{half_up(c):02X}" for c in np.mean(ps, axis=0)), "pct": pytest.approx(100 * len(ps) / len(x), abs=0.051)} for _, ps in best]
        assert json.loads(got[k].dominant_colors) == want
        level = [half_up(0.299 * r + 0.587 * g + 0.114 * b) for r, g, b in x.tolist()]
        assert json.loads(got[k].brightness_histogram) == [sum(v // 16 == s for v in level) for s in range(16)]
        assert got[k].avg_brightness == pytest.approx(x.max(axis=1).mean(), abs=1e-5)
    assert got[9].dominant_color_tags == ",red,white," and got[9].color_temperature == "warm"


def test_categories_by_the_longest_run_of_words(spark):
    words = [("hair", "body"), ("blue hair", "colour"), ("Long", "size"), ("sky", "place"), ("sky", "air"), (None, "x"), ("of the", "none")]
    tags = ["long_Blue_hair", "hair", "blue hair", "long sleeves", "night sky", "tall tower", "", None, "__", "hair of the dog", "of_the_hill"]
    got = {r.tag: (r.word, r.category) for r in categories.by_words(spark.createDataFrame([(t,) for t in tags * 2], "tag string"), spark.createDataFrame(words, "word string, category string")).collect()}
    none = (None, None)
    assert got == {"long_Blue_hair": ("blue_hair", "colour"), "hair": ("hair", "body"), "blue hair": ("blue_hair", "colour"), "long sleeves": ("long", "size"), "night sky": ("sky", "air"), "tall tower": none, "": none, "__": none, "hair of the dog": ("hair", "body"), "of_the_hill": ("of_the", "none")}


def test_words_come_before_rules_and_rules_before_runs(spark):
    words = spark.createDataFrame([("night sky", "mine"), ("tower", "place"), ("hair", "other")], "word string, category string")
    want = {"Night_Sky": ("mine", "word"), "blue_hair": ("body", "rule"), "tall tower": ("place", "words"), "zzz": ("unknown", "none"), "": ("unknown", "none"), "hair": ("other", "word"), "from_tower": ("angle", "rule")}
    got = categories.in_turn(spark.createDataFrame([(t,) for t in [*want, None]], "tag string"), words).collect()
    assert {r.tag: (r.category, r.by) for r in got} == want


def test_evidence_of_all_kinds(spark):
    from loomery.operators import evidence

    items = spark.createDataFrame([(1, "/a", 1, 900, 900, 5.0), (2, "/b", 0, 500, 900, 1.234), (3, "/c", None, 900, 900, None)], "id long, path string, is_readable int, width int, height int, aesthetic_score double")
    tags = spark.createDataFrame([(1, "general", 0.5), (1, "explicit", 0.9), (1, "general", 0.9), (2, "general", 0.1), (9, "x", 0.1)], "item_id long, tag string, confidence double")
    said = spark.createDataFrame([(1, "a"), (2, "  "), (9, "z")], "id long, caption string")
    there = spark.createDataFrame([("/a",), ("/b",), ("/b",)], "path string")
    sources = spark.createDataFrame([(1, "prompt", "workflow_widget_fallback"), (1, "loras", "global_graph_fallback"), (1, "prompt", "global_graph_fallback"), (2, "prompt", "txt"), (3, "prompt", "explicit_metadata"), (9, "x", "txt")], "id long, field string, source string")
    groups = spark.createDataFrame([(3, 1), (2, 1)], "id long, keeper long")
    run = lambda **more: evidence.gathered(items, tags, said, there, sources, groups, ("general", "explicit"), 0.6, 600, 2.0, **more)
    assert sorted((r.kind, r.id, r.detail) for r in run().collect()) == sorted([
        ("file_missing", 3, "/c"), ("image_unreadable", 2, None), ("empty_caption", 2, None), ("empty_caption", 3, None), ("rating_conflict", 1, "explicit,general"), ("low_tag_confidence", 1, "1"), ("low_tag_confidence", 2, "1"),
        ("metadata_provenance_risk", 1, "loras,prompt"), ("sidecar_metadata_dependency", 2, "prompt"), ("small_image", 2, "500x900"), ("low_aesthetic", 2, "123"), ("duplicate_group", 1, "1"), ("duplicate_group", 2, "1"), ("duplicate_group", 3, "1"),
    ])
    assert {r.kind for r in run(kinds=("small_image", "file_missing")).collect()} == {"small_image", "file_missing"}
    whole, part = evidence.report(items, run()).first(), evidence.report(items, run(kinds=("small_image",))).first()
    assert (whole["items"], whole.evidence, whole.blockers, whole.ready) == (3, 14, 2, 1) and (part.blockers, part.ready) == (0, 3)
    assert whole.scope_hash == part.scope_hash and whole.input_hash != part.input_hash
    assert evidence.report(items.repartition(5), run().repartition(7)).first() == whole
    assert evidence.report(items.where("false"), run().where("false")).first()["items"] == 0


def test_names_of_forks(spark):
    names = {
        "reForge": "reforge", "Re-Forge 1.2": "reforge", "sdwebuireforge": "reforge", "SD_WebUI-reForge": "reforge", "stable diffusion webui reforge": "reforge", "sd-webui-forge": "forge", "StableDiffusionWebUIForge": "forge",
        "webui  forge": "forge", "forge-webui": "forge", "f2.0.1v1.10.1-previous-313": "forge", "f0.0.17v1.8.0rc": "webui", "forge": "webui", "forgery of sd webui": "webui", "webuiforge": "webui", "prereforge": "webui", "webui forged": "webui", "1.10.1": "webui",
    }
    rows = spark.createDataFrame([(n, {"parameters": "a cat\nSteps: 20, Sampler: Euler", "Software": n}) for n in names], "name string, meta map<string,string>")
    assert {r.name: r.g for r in rows.select("name", records.generator(F.col("meta")).alias("g")).collect()} == names


def test_cursors_are_read_back(spark):
    rows = [(1, None), (2, "2024-01-02 03:04:05"), (-7, 'quo"te ü'), (2**53 + 1, "")]
    frame = spark.createDataFrame(rows, "id long, k string").withColumn("c", paging.cursors(F.col("id"), F.col("k")))
    for r in frame.withColumn("r", paging.read_cursors(F.col("c"))).collect():
        assert (r.r.id, r.r.sort_value) == (r.id, r.k)
        assert paging.decode_cursor(r.c) == (r.id, r.k)
        if r.k is None or r.k.isascii():
            assert paging.encode_cursor(r.id, r.k) == r.c
    odd = ["", "12", "x", "e30", "bm90IGpzb24", None, "{}", "====", "eyJpZCI6MX0"]
    got = spark.createDataFrame([(c,) for c in odd], "c string").withColumn("r", paging.read_cursors(F.col("c"))).collect()
    assert {r.c: r.r and r.r.id for r in got} == {c: 12 if c == "12" else None for c in odd}


def test_consistency_at_the_edges(spark):
    items = spark.createDataFrame([(k,) for k in range(4)], "id long")
    tags = spark.createDataFrame([(0, "General", 1), (0, "explicit", 2), (1, "Blue_Eyes", 1), (2, "blue eyes", 1), (2, " ", 2), (2, None, 3), (9, "general", 1)], "item_id long, tag string, pos int")
    said = spark.createDataFrame([(0, "Old_Look, x"), (1, None), (2, "old looks")], "id long, caption string")
    words = spark.createDataFrame([("OLD look",), ("old_look",)], "tag string")
    run = lambda i, t, p: {r.code: (r.n, r.examples) for r in consistency.report(i, tags, said, words, t, p).collect()}
    assert run(items, " old  look", "character") == {
        "rating-duplicates": (1, "0"), "rating-missing": (3, "1, 2, 3"), "spelling-variants": (1, "blue eyes"), "trigger-coverage": (3, "1, 2, 3"), "trigger-collision": (2, "OLD look, old_look"),
    }
    assert run(items, "", "concept")["trigger-missing"] == (1, "none") and "trigger-missing" not in run(items, "", "style")
    assert run(items.where("false"), "", "concept") == {}
    assert sum(r.n for r in consistency.shots(items, tags).collect()) == 4
