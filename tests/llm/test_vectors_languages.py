"""Clustering, vector codes and language identification against plain versions, and at their edges."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import centroids, language_id, quantised, registry, vector_codes

from . import brute


def floors(v):
    return tuple(math.floor(1024 * float(x)) for x in v)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(rows, dim, k, rounds, seed=3):
    """rows: (id, vector) -> sorted results of the clustering, by plain loops over all rows."""
    kept = [(i, floors(v)) for i, v in rows if whole(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    book = [q for _, q in order[:k]]
    near = lambda q: min((squared(q, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(book)):
            held = [q for c, (_, q) in zip(own, kept) if c == j]
            if held:
                book[j] = tuple(sum(x) // len(held) for x in zip(*held))
    last = [(i, *near(q)) for i, q in kept]
    sums = {j: sum(d for _, d, c in last if c == j) for j in range(len(book))}
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, book[c])).encode()).hexdigest()) for i, d, c in last), key=repr)


def codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, vector) of one length."""
    kept = [(i, label, floors(v)) for i, label, v in rows if whole(v)]
    width = len(kept[0][2]) // parts
    cut = lambda q: [q[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(q)[p] for _, _, q in first] for p in range(parts)]
    near = lambda x, p: min((squared(x, c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            xs = [cut(q)[p] for _, _, q in kept]
            own = [near(x, p)[1] for x in xs]
            for j in range(len(books[p])):
                held = [x for x, c in zip(xs, own) if c == j]
                if held:
                    books[p][j] = tuple(sum(y) // len(held) for y in zip(*held))
    found = [(i, label, [near(x, p) for p, x in enumerate(cut(q))]) for i, label, q in kept]
    sums = {}
    for _, label, f in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), sums[label], digest) for i, label, f in found), key=repr)


def drawn(n=300, dim=8, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, dim)).astype(np.float32)
    base[n // 3 :: 3] = base[0]  # a third of the rows are one vector
    rows = [(int(i), int(i % 3) if i % 7 else None, [float(x) for x in base[i]]) for i in range(n)]
    odd = [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1)]
    return rows + rows[:5] + [(None, None, rows[1][2])] + [(n + k, 0, v) for k, v in enumerate(odd)]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in rows], f"vec_id long, label int, embedding array<{kind}>, n int, cluster string").repartition(4)


def test_clusters_equal_plain_rounds(spark):
    rows = drawn()
    got = centroids.cluster(frame(spark, rows), dim=8, clusters=5, rounds=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lloyd([(i, v) for i, _, v in rows], 8, 5, 4)


def test_clusters_of_large_components(spark):
    draw = np.random.default_rng(2)
    rows = [(i, 0, [float(x) for x in draw.integers(-130_000, 130_000, 4)]) for i in range(60)]
    got = centroids.cluster(frame(spark, rows, "double"), dim=4, clusters=3, rounds=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lloyd([(i, v) for i, _, v in rows], 4, 3, 3)
    with pytest.raises(Exception, match="or larger in size"):
        centroids.cluster(frame(spark, [(1, 0, [2.0**17, 0.0])], "double"), dim=2).collect()


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, 0, [0.5, 0.0]), (2, 0, [0.5, 0.0]), (3, 0, [-0.5, 0.25])]
    got = centroids.cluster(frame(spark, rows), dim=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lloyd([(i, v) for i, _, v in rows], 2, 8, 10)
    assert centroids.cluster(frame(spark, rows).where("false"), dim=2).collect() == []
    assert centroids.cluster(frame(spark, rows), dim=3).collect() == []


def test_codes_equal_plain_rounds(spark):
    rows = [(i, label, v) for i, label, v in drawn(120) if v != []]
    got = vector_codes.compress(frame(spark, rows), entries=16, rounds=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == codes(rows, entries=16, rounds=3)


def test_codes_of_few_and_of_large_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, None, [float(x) for x in draw.integers(-130_000, 130_000, 8)]) for i in range(20)]
    got = vector_codes.compress(frame(spark, rows, "double")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == codes(rows)
    assert vector_codes.compress(frame(spark, rows, "double").where("false")).collect() == []


def test_codes_of_several_lengths(spark):
    """Each length has codebooks of its own; a length that four doesn't divide is filled with zeros."""
    rows = [(i, i % 2, [0.1 * i] * (8 if i % 2 else 3)) for i in range(20)] + [(99, None, [])]
    got = {r.vec_id: r for r in vector_codes.compress(frame(spark, rows, "double"), entries=4).collect()}
    for half, label in ((1, 8), (0, 3)):
        own = [(i, lab, v + [0.0] * (-len(v) % 4)) for i, lab, v in rows if len(v) == label]
        assert sorted((tuple(r) for i, r in got.items() if i % 2 == half and i < 99), key=repr) == codes(own, entries=4)
    assert (got[99].code, got[99].error, got[99].label_error) == ("00000000", 0, 0)


def test_labels_of_any_type(spark):
    rows = [(i, [0.1 * i, 0.0, 0.3, 0.2], "a" if i % 2 else None) for i in range(12)] + [(20, [1.0, 1.0, 1.0, 1.0], "")]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), entries=2).collect()
    want = codes([(i, label, v) for i, v, label in rows], entries=2)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_distances_are_exact():
    draw = np.random.default_rng(3)
    for most in (5, 1 << 20, (1 << 27) - 1):
        x, c = draw.integers(-most, most, (40, 16)), draw.integers(-most, most, (7, 16))
        want = [[squared(a, b) for b in c.tolist()] for a in x.tolist()]
        assert quantised.distances(x, c).tolist() == want
        index, error = vector_codes.nearest(np.ascontiguousarray(x.T), np.ascontiguousarray(c.T))
        assert error.tolist() == [min(w) for w in want] and index.tolist() == [w.index(min(w)) for w in want]


def test_queries_equal_plain_rounds(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = registry.queries()["op13_vector_codes"](spark, sf).collect()
    assert len(got) == len(rows) and len({r.codebooks_sha256 for r in got}) == 1
    assert {(r.vec_id, len(r.code)) for r in got} == {(i, 8) for i, _, _ in rows}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 5, 6, 12, 60])
def test_codewords(k):
    code = language_id.codewords(k)
    assert len(code) == k
    for j in range(code.shape[1]):
        assert len(set(code[:, j])) == 2
        for i in range(j):
            assert abs(int(code[:, i] @ code[:, j])) < k
    if k > 1:
        assert len({tuple(r) for r in code}) == k


def test_languages_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.queries()["op12_language_id"](spark, sf).collect()
    assert len(got) == len(true)
    for r in got:
        assert r.held_out == (brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang_pred == true[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.98


TEXTS = {"aa": "lorem ipsum dolor", "bb": "xyzzy plugh qwerty", "cc": "ананас яблоко груша"}


def languages(spark):
    rows = [(i, f"{TEXTS[x]} {i}", x, 7, "b") for i, x in enumerate([*TEXTS] * 30)]
    rows += [(1000, None, "aa", 7, "b"), (1001, "", "bb", 7, "b"), (1002, "12 ² _ !", None, 7, "b"), (None, "lorem dolor ipsum", None, 7, "b"), (1003, "xyzzy qwerty", None, 7, "b"), (1003, "xyzzy qwerty", None, 7, "b"), (1004, "lorem xyzzy ipsum plugh dolor qwerty", None, 7, "b"), (1005, "ГРУША " * 50_000, None, 7, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int, bits string").repartition(3)


def test_languages_at_the_edges(spark):
    got = language_id.identify(languages(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 98 and sum(r.doc_id == 1003 for r in got) == 2
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].ambiguous for i in (1000, 1001, 1002))
    assert (by[None].lang_pred, by[1003].lang_pred, by[1005].lang_pred) == ("aa", "bb", "cc")
    assert all(by[i].lang_pred == x for i, x in enumerate([*TEXTS] * 30))
    assert by[1004].ambiguous and not by[1003].ambiguous
    assert language_id.identify(languages(spark).where("false")).collect() == []
    nothing = language_id.identify(languages(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = language_id.identify(languages(spark).where("lang = 'aa'")).collect()
    assert {(r.lang_pred, r.score) for r in one if r.doc_id < 1000} == {("aa", 1.0)}


def test_bit_scores_by_hand(spark):
    """A bit's score is the mean weight of a text's n-grams, taken one by one."""
    rows = [(TEXTS[x], x) for x in TEXTS for _ in range(5)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.names == ["aa", "bb", "cc"]
    words = language_id.letters("Lorem, 5 QWERTY!")
    assert words == " lorem qwerty "
    grams = [words[k : k + n] for n in language_id.ORDERS for k in range(len(words) - n + 1)]
    counts = {x: [language_id.gram_buckets(language_id.letters(t)) for t in [TEXTS[x]]][0] for x in TEXTS}
    share = {x: lambda b, x=x: np.mean(counts[x] == b) for x in TEXTS}
    for j in range(model.code.shape[1]):
        total = 0.0
        for g in grams:
            b = [v for v in language_id.gram_buckets(g)][-1]
            sides = [np.mean([share[x](b) for i, x in enumerate(model.names) if model.code[i, j] == s]) + language_id.UNSEEN for s in (1, -1)]
            total += math.log(sides[0] / sides[1])
        assert model.bits(words)[j] == pytest.approx(total / len(grams), abs=1e-6)
