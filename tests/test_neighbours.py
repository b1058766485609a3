"""Exact neighbours, keeper groups and hash clusters against plain walks; brackets and medoids."""

import itertools

import numpy as np
import pytest

from loomery.operators import neighbours, sessions, vectors


def frame(spark, x, labels=None):
    rows = [(k, [float(a) for a in v] if v is not None else None, labels[k] if labels else None) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def cosines(x, threshold):
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    return {(i, j): float(u[i] @ u[j]) for i, j in itertools.combinations(range(len(u)), 2) if u[i] @ u[j] >= threshold}


def walk(ids, near):
    """ids: best first -> loser: keeper."""
    left, lost = set(ids), {}
    for i in ids:
        if i in left:
            left.discard(i)
            taken = near.get(i, set()) & left
            lost |= {j: i for j in taken}
            left -= taken
    return lost


@pytest.mark.parametrize("blocks", [0, 2, 5])
@pytest.mark.parametrize("dim, threshold", [(5, 0.95), (16, 0.9), (40, 0.8)])
def test_pairs_equal_all_pairs(spark, monkeypatch, dim, threshold, blocks):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    draw = np.random.default_rng(dim)
    base = draw.normal(size=(60, dim)) + draw.normal(size=dim)  # off the origin, so sides aren't even
    x = [base[k % 60] + draw.normal(size=dim) * 0.25 * (k % 4 > 0) * base.std() for k in range(300)]
    x = [v for k, v in enumerate(x) if k % 4 or k < 60]
    want = cosines(x, threshold)
    got = neighbours.near_pairs(neighbours.classes(frame(spark, x)).checkpoint(), threshold, blocks=blocks).collect()
    assert {(r.a, r.b): pytest.approx(r.similarity, abs=1e-9) for r in got} == want and want


def test_copies_are_one_class_and_odd_vectors_none(spark):
    x = [[1.0, 0.0], [1.0, -0.0], [2.0, 0.1], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0, 0.0]]
    found = neighbours.classes(frame(spark, x))
    assert sorted((r.cls, r.n) for r in found.collect()) == [(0, 2), (2, 1), (7, 1)]
    assert [(r.a, r.b) for r in neighbours.near_pairs(found, 0.9).collect()] == [(0, 2)]
    assert neighbours.near_pairs(found.where("false"), 0.9).collect() == []


def test_names_are_taken_where_they_cost_less():
    draw = np.random.default_rng(0)
    sample = draw.normal(size=(30, 64))
    sample = list(sample / np.linalg.norm(sample, axis=1)[:, None])
    mean = {64: np.zeros(64)}
    assert neighbours.best_blocks(sample, mean, 10_000, 0.1) == 0
    assert neighbours.best_blocks(sample, mean, 10**8, 0.02) > 1
    assert neighbours.best_blocks([], {}, 0, 0.1) == 0


def test_vectors_near_the_mean_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_NAMES", 3)
    draw = np.random.default_rng(0)
    x = draw.normal(size=(80, 12))
    x[40:] = x[:40] + 0.2 * draw.normal(size=(40, 12))
    got = neighbours.near_pairs(neighbours.classes(frame(spark, x)).checkpoint(), 0.9, blocks=2).collect()
    assert {(r.a, r.b) for r in got} == set(cosines(x, 0.9)) and len(got) == len(set(got))


def test_hot_names_are_dealt_to_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 8)
    x = np.random.default_rng(1).normal(size=(90, 10)) * 0.05 + np.eye(10)[0]
    got = neighbours.near_pairs(neighbours.classes(frame(spark, x)).checkpoint(), 0.985, blocks=2).collect()
    assert {(r.a, r.b) for r in got} == set(cosines(x, 0.985))


def test_pairs_stay_in_their_scope(spark):
    x = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.2], [1.0, 0.3], [1.0, 0.1]]
    found = neighbours.classes(frame(spark, x, [0, 1, 0, None, None]), "label").checkpoint()
    for blocks in (0, 1, 2, None):
        assert {(r.a, r.b) for r in neighbours.near_pairs(found, 0.9, "label", blocks=blocks).collect()} == {(0, 2), (3, 4)}


@pytest.mark.parametrize("last", [0, 40, 100_000])
def test_keepers_equal_the_walk(spark, monkeypatch, last):
    monkeypatch.setattr(neighbours, "LAST_LINKS", last)
    draw = np.random.default_rng(5)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in draw.integers(0, 60, (90, 2)) if a != b})
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(60)}
    rank = {i: (float(draw.integers(0, 4)), float(i)) for i in range(60)}
    got = neighbours.keepers(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i, list(r)) for i, r in rank.items()], "id long, rank array<double>"))
    assert {r.id: r.keeper for r in got.collect()} == walk(sorted(near, key=rank.get), near)


@pytest.mark.parametrize("last", [0, 100_000])
def test_equal_ranks_and_large_ids(spark, monkeypatch, last):
    monkeypatch.setattr(neighbours, "LAST_LINKS", last)
    big = 2**60
    pairs = [(big + k, big + k + 1) for k in range(6)]
    ranks = spark.createDataFrame([(big + k, [0.0]) for k in range(7)], "id long, rank array<double>")
    got = neighbours.keepers(spark.createDataFrame(pairs, "a long, b long"), ranks)
    assert {r.id - big: r.keeper - big for r in got.collect()} == {1: 0, 3: 2, 5: 4}
    hashes = spark.createDataFrame([(big + k, (1 << k) - 1) for k in range(7)], "id long, h long")
    assert {r.id - big: r.keeper - big for r in neighbours.hash_groups(hashes, 1).collect()} == {1: 0, 3: 2, 5: 4}


def test_groups_with_ties_copies_and_missing_facts(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(12, 6))
    x = [list(base[k % 12] + draw.normal(size=6) * 0.25 * (k % 5)) for k in range(70)] + [list(base[0])] * 4 + [list(base[3])] * 2
    facts = {k: (int(draw.integers(0, 2)) or None, None if k % 3 else 1.5, 100 * int(draw.integers(1, 3)), 100, int(draw.integers(0, 2))) for k in range(len(x)) if k % 11}
    rows = spark.createDataFrame([(k, *f) for k, f in facts.items()], "id long, user_rating int, aesthetic_score double, width int, height int, file_size long")
    near, sim = {}, cosines(x, 0.9)
    for a, b in sim:
        if a in facts and b in facts:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    best = sorted(facts, key=lambda k: (-(facts[k][0] or 0), -(facts[k][1] or 0.0), -facts[k][2] * facts[k][3], -facts[k][4], k))
    want = walk(best, near)
    groups = neighbours.duplicate_groups(frame(spark, x), rows, 0.9).cache()
    assert {r.id: r.keeper for r in groups.collect()} == want and len(want) > 20
    for r in groups.collect():
        assert r.similarity == pytest.approx(sim[min(r.id, r.keeper), max(r.id, r.keeper)], abs=1e-9)
    total = neighbours.summary(frame(spark, x), groups, rows).first()
    assert (total.embedded, total.groups, total.redundant, total.reclaimable_bytes) == (len(x), len(set(want.values())), len(want), sum(facts[k][4] for k in want))
    none = neighbours.duplicate_groups(frame(spark, x), rows.where("false"), 0.9)
    assert none.collect() == [] and neighbours.summary(frame(spark, x), none, rows).first().groups == 0


@pytest.mark.parametrize("most, chunk", [(0, 8), (3, 8), (6, 1024), (70, 1024)])
def test_hash_clusters_equal_the_walk(spark, monkeypatch, most, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    draw = np.random.default_rng(most)
    seeds = [int(s) for s in draw.integers(-(1 << 63), (1 << 63) - 1, 12)]
    flip = lambda s: int(np.int64(s) ^ np.int64(sum(1 << int(b) for b in draw.choice(62, int(draw.integers(0, 5)), replace=False))))
    rows = [(k, flip(seeds[k % 12])) for k in range(100)] + [(200, None), (201, None)]
    close = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= most
    near = {i: {j for j, g in rows if g is not None and j != i and close(h, g)} for i, h in rows if h is not None}
    got = neighbours.hash_groups(spark.createDataFrame(rows, "id long, h long"), most).collect()
    assert {r.id: r.keeper for r in got} == walk(sorted(near), near)


def test_medoids_and_outliers(spark):
    draw = np.random.default_rng(2)
    x, labels = draw.normal(size=(60, 7)) + 1, [k % 3 if k % 10 else None for k in range(60)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = {r.vec_id: r for r in vectors.medoids(frame(spark, x, labels), "label", 0.4).collect()}
    assert len(got) == 54
    for label in range(3):
        own = [k for k in range(60) if labels[k] == label]
        medoid = min(own, key=lambda k: (round(sum(1 - u[k] @ u[j] for j in own), 9), k))
        for k in own:
            assert got[k].medoid == medoid and got[k].distance == pytest.approx(1 - u[k] @ u[medoid], abs=1e-6)
            assert got[k].outlier == (1 - u[k] @ u[medoid] > 0.4)


def test_brackets_equal_a_stored_history(spark):
    """Against a session that keeps whole entries, one to undo from and one to redo from."""
    draw = np.random.default_rng(3)
    rows = [(int(draw.integers(0, 9)), k, ["champion", "challenger", "skip", "undo", "redo", "nonsense"][int(draw.integers(0, 6))], 3 + k % 2) for k in range(900)]
    rows = [(s, k, a, 2 + s * 4) for s, k, a, _ in rows] + [(None, 1, "undo", 5)]
    want = {}
    for s in range(9):
        champion, challenger, history, redo = 0, 1, [], []
        for _, _, action, total in (r for r in rows if r[0] == s):
            if action == "undo" and history:
                redo.append(e := history.pop())
                champion, challenger = e["champion"], e["challenger"]
            elif action == "redo" and redo:
                history.append(e := redo.pop())
                champion, challenger = (e["challenger"] if e["action"] == "challenger" else e["champion"]), e["challenger"] + 1
            elif action in ("champion", "challenger", "skip") and challenger < total:
                history.append({"action": action, "champion": champion, "challenger": challenger})
                champion, challenger, redo = challenger if action == "challenger" else champion, challenger + 1, []
        want[s] = (champion, challenger, challenger >= 2 + s * 4, len(history), len(redo))
    events = spark.createDataFrame(rows, "session long, seq long, action string, total int").repartition(4)
    assert {r[0]: tuple(r)[1:] for r in sessions.brackets(events).collect()} == want
    assert sessions.brackets(events.where("false")).collect() == []
