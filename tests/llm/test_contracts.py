"""The registered queries over whole small tables, against plain versions of the same results."""

import math
import zlib

import numpy as np
import pytest

from loomery.llm import registry

from . import brute

@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def test_licenses(spark, sf, docs):
    got = {r.doc_id: r for r in run(spark, sf, "op1_license_scan")}
    assert len(got) == len(docs)
    for i, text in docs:
        r, want = got[i], brute.licences(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in run(spark, sf, "op2_toxicity")}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (brute.crc(i) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(labels[i], r.score) for i, r in got.items() if r.held_out and i in labels]
    bad, good = [s for y, s in known if y], [s for y, s in known if not y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95, auc


def test_language_model(spark, sf, docs):
    got = {r.doc_id: r for r in run(spark, sf, "op3_lm_scoring")}
    want = brute.base_scores(docs)
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark, sf, docs):
    got = {r.doc_id: r for r in run(spark, sf, "op4_quality_rules")}
    for i, text in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), i
        assert not (r.base_failed and r.kept)


def test_packing(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs}
    rows = run(spark, sf, "op5_packing")
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == ids.keys()
    for i, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(seq) * 2048 < total * 1.02 + 2048


def test_simhash(spark, sf, docs):
    fps, root = brute.simhash_groups(docs)
    got = run(spark, sf, "op7_simhash_dedup")
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == root[r.doc_id]


def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute.embedding_links(rows)
    got = run(spark, sf, "op8_embedding_dedup")
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id]
        assert r.kept == (r.vec_id == r.component_id)


def test_pieces(spark, sf, docs):
    got = run(spark, sf, "op9_sentencepiece")
    assert len(got) == len(docs)
    assert all(r.lossless for r in got)
    again = {r.doc_id: r.ids_crc32 for r in run(spark, sf, "op9_sentencepiece")}
    assert again == {r.doc_id: r.ids_crc32 for r in got}


def test_chat(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    want = brute.chats(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = run(spark, sf, "op10_chat_formatting")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    got = run(spark, sf, "op6_html_extraction")
    assert len(got) == pages
    assert all(r.n_chars == len(r.text) for r in got)


def test_pipeline(spark, sf, docs):
    """Each stage, held against the plain version on what its predecessor kept."""
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs)
    clean = corpus_pipeline.drop_toxic(spark, d, sf).persist()
    assert clean.columns == d.columns
    good = corpus_pipeline.drop_low_quality(spark, clean, sf)
    kept = {r.doc_id for r in good.collect()}
    for r in clean.select("doc_id").collect():
        if brute.quality(texts[r.doc_id])[5]:
            assert r.doc_id not in kept
    _, root = brute.simhash_groups([(i, texts[i]) for i in sorted(kept)])
    single = corpus_pipeline.drop_near_duplicates(spark, good, sf)
    assert {r.doc_id for r in single.collect()} == {i for i, c in root.items() if i == c}
    last = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert last == {i for i, c in root.items() if i == c}


SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    """Against DuckDB on the same tables."""
    from pathlib import Path

    import duckdb

    from tests.test_oracle import rows

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_toxicity_scores(spark, sf, docs):
    """Each score, from the model's weights and the n-grams of the text taken one by one."""
    from loomery.llm import toxicity

    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(d, labels, ~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()}
    for i, text in docs[:40]:
        text = (text or "").lower()
        found = {int(b) for n in toxicity.ORDERS for k in range(len(text) - n + 1) for b in toxicity.gram_buckets(text[k : k + n])[-1:]}
        z = model.intercept + sum(model.weight[model.feature[b]] for b in found if model.feature[b] >= 0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_class_scores_by_hand(spark):
    """The language model's score of a text is the sum over all paths of states."""
    import itertools

    from loomery.llm import language_model as lm

    p = lm.initial(np.full(lm.CLASSES, 1 / lm.CLASSES))
    classes = lm.word_classes(lm.tokens(b"One two\x0bthree"))
    assert classes.tolist() == lm.word_classes([b"one", b"two", b"three", b""]).tolist() and classes[-1] == 0
    total = sum(p.start[s[0]] * np.prod([p.move[a, b] for a, b in zip(s, s[1:])]) * np.prod([p.emit[a, c] for a, c in zip(s, classes)]) for s in itertools.product(range(lm.STATES), repeat=len(classes)))
    assert lm.log_likelihoods([classes], p)[0] == pytest.approx(math.log(total), abs=1e-9)
    runs = lm.expected_counts([classes[:2], classes[2:]], p, [True, False])
    assert runs[0].sum() == pytest.approx(1) and runs[2].sum() == pytest.approx(4)


def test_language_model_scores_by_hand(spark, monkeypatch):
    """Whole scores, from the counts to two iterations of training and the sum over paths, in blocks of a few texts."""
    from loomery.llm import language_model as lm

    draw = np.random.default_rng(5)
    words = ["the", "The", "a", "café", "run\u00a0on", "x" * 9, "end.", "σίγμα", "zip"]
    docs = [(i, sep.join(draw.choice(words, draw.integers(0, 14)))) for i, sep in zip(range(40), [" ", "\n", "\t ", " \x0c"] * 10)] + [(40, None), (41, ""), (41, "the the"), (None, "a zip"), (2**60 + 1, "the end.")]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100)
    monkeypatch.setattr(lm, "SEQUENCE", 10**9)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm.score(frame, iterations=2).collect())
    learnt = [(0 if i is None else brute.crc(i)) % 7 != 2 for i, _ in docs]
    want = brute.hidden_scores([t for _, t in docs], learnt, lambda w: int(lm.word_classes([w])[0]), lm.CLASSES, lm.initial, 2)
    for (i, n, score), (j, m, plain) in zip(got, sorted((i or -1, m, x) for (i, _), (m, x) in zip(docs, want)), strict=True):
        assert (i, n) == (j, m) and score == pytest.approx(plain, abs=1e-8)


def test_numbers_in_halves():
    from loomery.llm import language_model as lm

    x = np.array([0, 1, 65535, 65536, 70000, 2**31 - 1], np.int64)
    assert lm._of_halves(lm._in_halves(x)).tolist() == x.tolist()


def test_segmentation_probabilities_by_enumeration():
    """The sampled segmentation's probability, against all segmentations of the word."""
    from loomery.llm import pieces

    s = pieces.Segmenter()
    known = {s.raw[i].decode(): s.weight[i] for i in range(len(s.raw)) if s.weight[i] > 0}

    def ways(word):
        if not word:
            return [((), 1.0)]
        return [((word[:k], *rest), known[word[:k]] * w) for k in range(1, len(word) + 1) if word[:k] in known for rest, w in ways(word[k:])]

    every = dict(ways(" hello"))
    ids, chance = s.encode(["hello"] * 50, np.arange(50))
    for x, c in zip(ids, chance):
        assert math.exp(c) == pytest.approx(every[tuple(s.raw[i].decode() for i in x)] / sum(every.values()), rel=1e-9)
